"""The engine: one object per index, queries in, DataFrames out."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.errors import QueryError, UnknownValueError
from corvane.functions import scoring
from corvane.functions.tags import TagFilter
from corvane.functions.text import strip_stopwords
from corvane.functions.text import words as words_column
from corvane.operators import evidence, facets, ranking
from corvane.operators.index import SearchIndex, overlap_free, scope, write_index
from corvane.operators.widening import Synonyms, closest, compound_tree, corrections, fuzzy_tree, notice, number_groups, rare_spellings, respelt
from corvane.plans import language as q
from corvane.plans import predicates
from corvane.plans.compile import Compiler, Leaf, leaf_scores, scored
from corvane.sources.kinds import CATEGORIES, CATEGORY_OF_KIND, NOTE_KINDS

KEYS = ["parent_id", "chunk_seq"]
LIMIT, PER_FILE, WINDOW = 50, 5, 10
#: Passes of a cascade after the literal one, in order.
WIDER = ("fuzzy", "syn", "compound")


@dataclass(frozen=True)
class Profile:
    """How hits are re-ranked."""

    recency_boost: float = 0.0
    half_life: float = 90 * 86_400.0
    kind_boosts: dict = field(default_factory=dict)
    proximity_boost: float = 0.0
    proximity_most: int = 100


@dataclass(frozen=True)
class Trace:
    """What a search did. The flags are counted when they are asked for."""

    query: str
    intent: str | None
    regime: str
    strong_signal: dict
    respelt: dict[str, str]
    widened: dict[str, str]
    _files: DataFrame
    _sections: DataFrame
    limit: int
    per_file: int

    @property
    def files_truncated(self) -> bool:
        return self._files.limit(self.limit + 1).count() > self.limit

    @property
    def sections_truncated(self) -> bool:
        return not self._sections.groupBy("parent_id").count().filter(F.col("count") > self.per_file).isEmpty()


@dataclass
class Engine:
    index: SearchIndex
    synonyms: Synonyms = field(default_factory=lambda: Synonyms.of(number_groups()))

    @classmethod
    def build(cls, chunks: DataFrame, path: str, stems: bool = True, **more) -> "Engine":
        return cls(write_index(chunks, path, stems=stems), **more)

    @classmethod
    def open(cls, spark: SparkSession, path: str, **more) -> "Engine":
        return cls(SearchIndex.open(spark, path), **more)

    def _compiler(self) -> Compiler:
        return Compiler(self.index, "body", "words") if self.index.stemmed_fields else Compiler(self.index)

    def _filters(self, query: q.Query, arms, tags: TagFilter | None, metadata: str | None) -> DataFrame:
        """Keys of the chunks that pass all filters; conditions reach the scan of ``chunks``."""
        rows = scope(self.index.chunks, arms)
        for clause in query.filters:
            inner = clause.node if isinstance(clause, q.Not) else clause
            if inner.field in ("kind", "collection"):
                self._known(inner)
            rows = rows.filter(self.index.predicate(clause))
        for rule in (query.metadata, metadata):
            if rule:
                tree = predicates.parse(rule)
                rows = rows.filter(F.col("kind").isin(*NOTE_KINDS) & predicates.column(tree, self.index.chunks.schema))
        if tags is not None:
            rows = rows.filter(tags.column(*(F.col(c) for c in ("tags_fm", "tags_os", "tags") if c in rows.columns)))
        return rows

    def _known(self, clause: q.FieldClause) -> None:
        """A collection that no chunk has, or a kind that neither a chunk has nor any file can, is an error with the nearest names."""
        known = set(self.index.named_values(clause.field))
        if clause.field == "kind":
            known |= set(CATEGORY_OF_KIND) | set(CATEGORIES)
        for v in self.index._exact(clause.field, clause.value):
            if v not in known:
                raise UnknownValueError(clause.field, v, closest(v, sorted(known)))

    def hits(self, query: str | q.Query, *, arms=None, tags: TagFilter | None = None, metadata: str | None = None, secondary: bool = True, tree=None) -> DataFrame:
        """(parent_id, chunk_seq, score) of every chunk that matches and passes all filters."""
        parsed = q.parse(strip_stopwords(query)) if isinstance(query, str) else query
        compiler = self._compiler()
        wanted = parsed.tree if tree is None else tree
        filtered = bool(parsed.filters or parsed.metadata or metadata or arms is not None or tags is not None)
        if wanted is None:
            if not filtered:
                return self.index.chunks.limit(0).select(*KEYS, F.lit(0.0).alias("score"))
            return self._filters(parsed, arms, tags, metadata).select(*KEYS, F.lit(1.0).alias("score"))
        found = scored(self.index, compiler.compile(wanted))
        plain = q.plain_terms(wanted)
        if secondary and plain and not any(isinstance(n, (q.Wildcard, q.Pattern, q.Fuzzy)) for n in q.walk(wanted)):
            found = self._secondary(found, plain)
        if filtered:
            found = found.join(self._filters(parsed, arms, tags, metadata).select(*KEYS), KEYS, "left_semi")
        return found

    def _secondary(self, found: DataFrame, words: list[str]) -> DataFrame:
        """Matches of the same words in title and path add a quarter of their score; they retrieve nothing."""
        for fld, boost in (("title", scoring.TITLE_BOOST), ("path", scoring.PATH_BOOST)):
            if fld in self.index.field_stats():
                more = scored(self.index, Compiler(self.index, fld).compile(q.Or(tuple(q.Term(w) for w in words)))).withColumnRenamed("score", "_more")
                found = found.join(more, KEYS, "left").select(*KEYS, (F.col("score") + boost * F.coalesce("_more", F.lit(0.0))).alias("score"))
        return found

    def fused(self, query: str, fixes: dict[str, str] | None = None, **filters) -> DataFrame:
        """Phrase, plain, synonym and compound passes of a bag of words, by reciprocal ranks. ``fixes``: respellings of words that no chunk has."""
        parsed = q.parse(strip_stopwords(query))
        passes = [("lex", self.hits(parsed, **filters), 1.0)]
        words = q.plain_terms(parsed.tree) if parsed.tree is not None else []
        if q.is_bag_of_words(parsed.text):
            if len(words) > 1:
                passes.append(("phrase", self.hits(parsed, tree=q.Phrase(" ".join(words)), **filters), scoring.PHRASE_WEIGHT))
            if (wide := self.synonyms.expand(parsed.text)) is not None:
                passes.append(("syn", self.hits(parsed, tree=wide, **filters), scoring.SYNONYM_WEIGHT))
            if len(words) == 1 and (wide := compound_tree(words[0])) is not None:
                passes.append(("compound", self.hits(parsed, tree=wide, **filters), scoring.COMPOUND_WEIGHT))
            if respell := self.respellings(words) if fixes is None else fixes:
                passes.append(("typo", self.hits(q.parse(respelt(parsed.text, respell)), **filters), scoring.TYPO_WEIGHT))
        return ranking.fuse(passes)

    def respellings(self, words: list[str]) -> dict[str, str]:
        rows = corrections(self.index.dictionary("words"), words).filter("place = 1").collect() if words else []
        return {r["word"]: r["term"] for r in rows}

    def rarer(self, words: list[str]) -> dict[str, str]:
        """Very much commoner neighbours of words that few chunks have."""
        return {r["word"]: r["term"] for r in self.rare(words).collect()} if words else {}

    def cascaded(self, query: str, least: int, wider: tuple[str, ...] = WIDER, **filters) -> DataFrame:
        """Literal, near, synonym and compound passes, each only while there are fewer than ``least`` hits. ``wider``: which passes may follow the literal one."""
        return ranking.cascade([rows for _, rows in self._passes(query, least, wider, **filters)])

    def _passes(self, query: str, least: int, wider: tuple[str, ...] = WIDER, **filters) -> list[tuple[str, DataFrame]]:
        parsed = q.parse(strip_stopwords(query))
        passes = [("literal", self.hits(parsed, **filters))]
        if q.states_intent(parsed.text) or parsed.tree is None:
            return passes
        words = q.plain_terms(parsed.tree)
        later = (("fuzzy", lambda: fuzzy_tree(parsed.tree, self._compiler())), ("syn", lambda: self.synonyms.expand(parsed.text)), ("compound", lambda: compound_tree(words[0]) if len(words) == 1 else None))
        for name, make in later:
            if name not in wider:
                continue
            if ranking.cascade([rows for _, rows in passes]).limit(least).count() >= least:
                break
            if (tree := make()) is not None:
                passes.append((name, self.hits(parsed, tree=tree, **filters)))
        return passes

    def search(self, query: str, **more) -> DataFrame:
        """The best sections of the best files; see ``searched``."""
        return self.searched(query, **more)[0]

    def searched(
        self, query: str, *, limit: int = LIMIT, per_file: int = 1, profile: Profile | None = None, now: int = 0, intent: str | None = None, as_typed: bool = False, collapse_copies: bool = False, **filters
    ) -> tuple[DataFrame, Trace]:
        """(parent_id, chunk_seq, file_place, place, pass_index, rank_key, score, section_score, copies) of the best sections of the best files, and
        what the search did.

        Every hit counts: files are ranked by their best hit, then cut to ``limit``; sections of those files are ordered by their own
        score, then cut to ``per_file``. So a long file takes one place, however many of its chunks match.
        """
        parsed = q.parse(strip_stopwords(query))
        words = q.plain_terms(parsed.tree) if parsed.tree is not None else []
        probe = self.hits(parsed, **filters)
        fixes = {} if as_typed else self.respellings(words)
        signal = ranking.strong_signal(probe).first().asDict()
        signal["fired"] = bool(signal["fired"]) and not intent and not fixes
        if signal["fired"]:
            regime, rows = "strong-signal", probe.withColumn("pass_index", F.lit(0))
            if len(words) == 1 and (tree := compound_tree(words[0])) is not None and q.is_bag_of_words(parsed.text):
                other = self.hits(parsed, tree=tree, **filters).join(probe.select(*KEYS), KEYS, "left_anti")
                rows = rows.unionByName(other.withColumn("pass_index", F.lit(1)))
            rows = rows.withColumn("rank_key", F.col("score"))
        else:
            regime, rows = "fusion", self.fused(query, fixes, **filters).select(*KEYS, "score", F.col("rank_score").alias("rank_key"), F.lit(0).alias("pass_index"))
            few = max(1, limit // 4)
            n = rows.limit(few).count()
            if n < few:
                passes = self._passes(query, WINDOW * max(1, limit), **filters)
                wide = ranking.cascade([r for _, r in passes])
                if wide.count() > n:
                    regime = "cascade(" + "".join(f"+{name}" for name, _ in passes[1:]) + ")"
                    rows = wide.withColumn("rank_key", F.col("score"))
            if len(words) == 1 and regime == "fusion":
                rows = rows.withColumn("rank_key", F.col("score"))
        rows = self.reranked(rows, profile, now, words).withColumn("file_key", F.col("parent_id"))
        if collapse_copies and "content_hash" in self.index.chunks.columns:
            hashes = self.index.chunks.select(*KEYS, "content_hash")
            rows = rows.drop("file_key").join(hashes, KEYS).withColumn("file_key", F.coalesce(F.when(F.col("content_hash") != "", F.col("content_hash")), F.col("parent_id"))).drop("content_hash")
        widened = {}
        if not as_typed and words:
            exact = rows.filter("pass_index = 0").select("file_key").distinct().limit(limit).count()
            widened = self.rarer(words) if exact < limit else {}
            if widened:
                # Hits of the commoner spelling in files that have none: under all exact ones, over what a cascade found.
                fill = self.hits(q.parse(respelt(parsed.text, widened)), **filters).join(rows.filter("pass_index = 0").select("parent_id").distinct(), "parent_id", "left_anti")
                fill = fill.select(*KEYS, "score", F.col("score").alias("rank_key"), F.lit(1).alias("pass_index"), F.col("parent_id").alias("file_key"))
                later = rows.filter("pass_index > 0").join(fill.select(*KEYS), KEYS, "left_anti").withColumn("pass_index", F.col("pass_index") + 1)
                rows = rows.filter("pass_index = 0").unionByName(fill).unionByName(later.select(*fill.columns))
                regime += "(+respelt)"
        order = F.struct("pass_index", (-F.col("rank_key")).alias("k"), "parent_id", "chunk_seq")
        files = rows.groupBy("file_key").agg(F.min(order).alias("best"), F.sort_array(F.collect_set("parent_id")).alias("all"))
        # ``limit`` rows at most, so they are broadcast.
        chosen = files.orderBy("best").limit(limit)
        chosen = chosen.select("file_key", F.row_number().over(Window.orderBy("best")).alias("file_place"), F.col("best.parent_id").alias("parent_id"), F.array_except("all", F.array("best.parent_id")).alias("copies"))
        shown = rows.join(F.broadcast(chosen), ["file_key", "parent_id"]).drop("file_key").withColumn("order", F.struct("pass_index", (-F.col("rank_key")).alias("k"), "chunk_seq"))
        if "body" in self.index.chunks.columns and parsed.tree is not None:
            shown = overlap_free(shown, self.index.chunks, evidence.Matcher.of(parsed.tree)).select(*shown.columns)
        shown = self.sectioned(shown, [*words, *(w for w in {**fixes, **widened}.values())])
        inside = Window.partitionBy("parent_id").orderBy(*([F.col("pass_index")] if regime.startswith("cascade") else []), F.desc("section_score"), F.desc("rank_key"), "chunk_seq")
        out = shown.withColumn("place", F.row_number().over(inside)).filter(F.col("place") <= per_file)
        out = out.select(*KEYS, "file_place", "place", "pass_index", "rank_key", "score", "section_score", "copies").orderBy("file_place", "place")
        return out, Trace(query, intent, regime, signal, fixes, widened, files, shown, limit, per_file)

    def sectioned(self, shown: DataFrame, words: list[str]) -> DataFrame:
        """``section_score``: what a section's heading adds to its score beyond the body, by the share of the words' rarity that it holds."""
        words, fields = list(dict.fromkeys(words)), self.index.field_stats()
        if not words or "words" not in fields or len(words) < 2 and "heading" not in fields:
            return shown.withColumn("section_score", F.col("rank_key"))
        leaves = [Leaf(2 * i, "words", [[w]]) for i, w in enumerate(words)]
        leaves += [Leaf(2 * i + 1, "heading", [[w]]) for i, w in enumerate(words)] if "heading" in fields else []
        found = leaf_scores(self.index, leaves)
        texts = [c for c in ("heading_path", "title") if c in self.index.chunks.columns]
        rows = shown.join(found, KEYS, "left").join(self.index.chunks.select(*KEYS, *texts), KEYS)
        path = F.split(F.coalesce("heading_path", F.lit("")), " > ") if "heading_path" in texts else F.array(F.lit(""))
        lead = F.element_at(path, 1)
        file = Window.partitionBy("parent_id")
        rows = rows.withColumn("_shared", F.when(F.min(lead).over(file) == F.max(lead).over(file), lead).otherwise(F.lit("")))
        own = F.array_union(words_column(F.element_at(path, -1)), words_column(F.col("_shared")))
        title = words_column(F.coalesce("title", F.lit(""))) if "title" in texts else F.array().cast("array<string>")
        n = fields["words"][0]
        df = self.index.frequencies({("words", w) for w in words})
        zero, slots = F.lit(0.0), []
        for i, w in enumerate(words):
            body, heading = F.coalesce(F.col(f"s{2 * i}"), zero), F.coalesce(F.col(f"s{2 * i + 1}"), zero) if "heading" in fields else zero
            share = F.when(F.array_contains(own, w), 1.0).otherwise(scoring.OTHER_HEADING)
            slots.append({"body": body, "heading": heading, "share": share, "rarity": F.lit(scoring.idf_value(n, df.get(("words", w), 0))), "held": (body > 0) | (heading > 0) | F.array_contains(title, w)})
        total = F.lit(sum(scoring.idf_value(n, df.get(("words", w), 0)) for w in words))
        return rows.withColumn("section_score", ranking.section_score(F.col("score"), slots, total)).select(*shown.columns, "section_score")

    def reranked(self, rows: DataFrame, profile: Profile | None, now: int, words: list[str] | None = None) -> DataFrame:
        if profile is None:
            return rows
        facts = self.index.chunks.select(*KEYS, *(c for c in ("mtime", "kind") if c in self.index.chunks.columns))
        rows = rows.join(facts, KEYS)
        key = F.col("rank_key")
        if profile.recency_boost and "mtime" in facts.columns:
            key = scoring.recency(key, now, F.col("mtime"), profile.recency_boost, profile.half_life)
        if profile.kind_boosts and "kind" in facts.columns:
            key = scoring.kind_boost(key, F.col("kind"), profile.kind_boosts)
        rows = rows.withColumn("rank_key", key).drop("mtime", "kind")
        if profile.proximity_boost and len(set(words or ())) > 1:
            places = self.index.postings.filter((F.col("field") == "words") & F.col("term").isin(words)).groupBy(*KEYS).pivot("term", list(dict.fromkeys(words))).agg(F.first("positions"))
            width = ranking.covering_window([F.col(f"`{w}`") for w in dict.fromkeys(words)])
            near = places.select(*KEYS, scoring.closeness(width, len(set(words)), profile.proximity_most).alias("_near"))
            rows = rows.join(near, KEYS, "left").withColumn("rank_key", F.col("rank_key") * (1 + profile.proximity_boost * F.coalesce("_near", F.lit(0.0)))).drop("_near")
        return rows

    def search_grouped(self, query: str, *, sections_per_file: int = PER_FILE, **more) -> DataFrame:
        return self.search(query, per_file=sections_per_file, **more)

    def with_snippets(self, hits: DataFrame, query: str) -> DataFrame:
        return evidence.with_snippets(evidence.materialised(hits, self.index.chunks, "body", "path"), q.parse(query).tree)

    def facets(self, query: str | None = None, **filters) -> DataFrame:
        rows = self.index.chunks
        if query:
            rows = rows.join(self.hits(query, **filters).select(*KEYS), KEYS, "left_semi")
        return facets.tag_catalogue(rows)

    def explain(self, query: str, **more) -> str:
        """What a search did, as JSON: its regime, the strong signal, respellings, and whether it shows all it found."""
        parsed = q.parse(strip_stopwords(query))
        words = q.plain_terms(parsed.tree) if parsed.tree is not None else []
        _, trace = self.searched(query, **more)
        said = {"regime": trace.regime, "intent": trace.intent, "files_truncated": trace.files_truncated, "sections_truncated": trace.sections_truncated}
        return json.dumps({"query": query, "words": words, "filters": [str(f) for f in parsed.filters], "strong_signal": trace.strong_signal, "respelt": notice(trace.respelt), "widened": notice(trace.widened), **said, "generation": self.index.generation}, ensure_ascii=False)

    def rare(self, words: list[str]) -> DataFrame:
        return rare_spellings(self.index.dictionary("words"), words)


def multi(text: str) -> dict:
    """Sub-queries of a block: ``lex:``, ``phrase:``, ``syn:`` lines and the last ``intent:``; ``#`` comments; other prefixes are ignored."""
    out: dict = {"subqueries": [], "intent": None}
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        kind, colon, body = line.partition(":")
        if not colon:
            continue
        if kind == "intent":
            out["intent"] = body.strip()
        elif kind in ("lex", "phrase", "syn") and body.strip():
            out["subqueries"].append((kind, body.strip()))
    if not out["subqueries"]:
        raise QueryError("a block of sub-queries holds none")
    return out


def run_multi(engine: Engine, text: str, **filters) -> DataFrame:
    got = multi(text)
    weights = {"lex": 1.0, "phrase": scoring.PHRASE_WEIGHT, "syn": scoring.SYNONYM_WEIGHT}
    passes = []
    for kind, body in got["subqueries"]:
        parsed = q.parse(body)
        tree = q.Phrase(" ".join(q.plain_terms(parsed.tree))) if kind == "phrase" else engine.synonyms.expand(body) if kind == "syn" else None
        passes.append((kind, engine.hits(parsed, tree=tree, **filters), weights[kind]))
    return ranking.fuse(passes)
