"""Globs and whole-word regular expressions as Java patterns for ``rlike``."""

from __future__ import annotations

import re

from corvane.errors import QuerySyntaxError


def glob_to_regex(glob: str) -> str:
    """A word pattern: ``*`` any run, ``?`` one character; anchored."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def glob_mask(glob: str, word: str) -> list[bool] | None:
    """For each letter of a matched word, whether the glob names it; None for a word that does not match."""
    parts = [(c, c not in "*?") for c in glob]
    pattern = "".join(f"({re.escape(c)})" if named else "(.*?)" if c == "*" else "(.)" for c, named in parts)
    m = re.fullmatch(pattern, word)
    if not m:
        return None
    mask = [False] * len(word)
    for k, (_, named) in enumerate(parts, 1):
        if named:
            for i in range(*m.span(k)):
                mask[i] = True
    return mask


def path_glob_to_regex(glob: str) -> str:
    """A path pattern: ``*``, ``?`` and ``[..]`` stop at slashes, ``**`` crosses folders; anchored at both ends."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            body = "^" + body[1:] if body[0] == "!" else body
            out.append("(?!/)[" + body.replace("\\", "\\\\").replace("[", "\\[") + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def word_regex(pattern: str) -> str:
    """A whole-word, case-insensitive pattern in the dialect that needs no backtracking: no look-around and
    no back references. It runs over the distinct words of an index only."""
    if re.search(r"\(\?[=!<]|\\[1-9]|\(\?P=", pattern):
        raise QuerySyntaxError("a pattern can hold neither look-around nor back references", pattern)
    try:
        re.compile(pattern)
    except re.error as e:
        raise QuerySyntaxError(f"not a regular expression: {e}", pattern) from None
    return f"(?i)^(?:{pattern})$"


def literal_prefixes(pattern: str) -> list[str]:
    """Literal heads of a pattern's alternatives; none if one of them has no head of letters."""
    heads = []
    for part in pattern.split("|") if "(" not in pattern else [pattern]:
        m = re.match(r"[a-z0-9]*", part.lower())
        head = m[0]
        if len(head) < len(part) and part[len(head)] in "*?{":
            head = head[:-1]
        if not head:
            return []
        heads.append(head)
    return heads


def names_hidden(glob: str) -> bool:
    """Whether a path pattern names a hidden part itself."""
    return any(p.startswith(".") and p not in (".", "..") for p in glob.split("/"))


class IgnoreRules:
    """Ignore files: the last matching rule of the deepest file decides; ``!`` takes a path back, a trailing slash
    means folders, a slash inside anchors the rule at its file's folder."""

    def __init__(self):
        self.rules: list[tuple[str, re.Pattern, bool, bool]] = []

    def add(self, folder: str, text: str) -> "IgnoreRules":
        base = folder.strip("/")
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            taken = line.startswith("!")
            line = line[1:] if taken else line.removeprefix("\\")
            only_folders = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            line = line.lstrip("/")
            glob = line if anchored else f"**/{line}"
            self.rules.append((base, re.compile(path_glob_to_regex(glob)), only_folders, taken))
        return self

    def _own(self, path: str, is_folder: bool) -> bool | None:
        verdict = None
        for base, pattern, only_folders, taken in self.rules:
            inner = path[len(base) + 1 :] if base and path.startswith(base + "/") else path if not base else None
            if inner and (is_folder or not only_folders) and pattern.match(inner):
                verdict = not taken
        return verdict

    def ignores(self, path: str, is_folder: bool = False) -> bool:
        """A path under an ignored folder is ignored, whatever its own rules say."""
        parts = path.strip("/").split("/")
        for i in range(1, len(parts)):
            if self._own("/".join(parts[:i]), True):
                return True
        return bool(self._own("/".join(parts), is_folder))
