"""Operators against brute force, exact round trips and held-out accuracy; and the edge cases of each."""

from __future__ import annotations

import bisect
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import bpe, components, decontamination, html_text, jaccard, langid, neighbours, pieces, quality, shared, sharding, token_files, warc
from corvane.llm.shared import table, table_path

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, n int, row string, shard int, value string"
ODD_TEXTS = [None, "", " ", "a", "Hello world, it's  fine\n\n  x", "Ünï 日本 😀 <|endoftext|> don't", "\x85   ", "word " * 4_000, "x" * 3_000, "same text here", "same text here"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    rows = [(i, t, None, None, None, 0.5, "k", 1, "r", 3, "v") for i, t in enumerate(ODD_TEXTS)] + [(0, None, "en", "s", 1, 0.5, "k", 1, "r", 3, "v"), (10, "same text here", None, None, None, 0.5, "k", 1, "r", 3, "v")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


# 1: byte-level BPE


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab '\n\t1.sté 日", max_size=60), st.lists(st.sampled_from(["<|endoftext|>", " the", "'ll", "\n\n", "aaaa", "é"]), max_size=12).map("".join)))
def test_bpe_equals_the_library(library, text):
    coder = bpe.coder(bpe.default_tokenizer())
    ids = library.encode(text, add_special_tokens=False).ids
    assert coder.encode(text) == ids
    assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_bpe_long_fragments(library):
    coder = bpe.coder(bpe.default_tokenizer())
    for text in ("ab" * 900, "qwertyuiop" * 200, "a" * 2_000, "thing" * 300 + "!" * 500):
        assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_a_full_table_forgets_and_stays_right(library):
    """Few slots: new keys meet in them, and the table is emptied again and again."""
    rng = np.random.default_rng(6)
    coder = bpe.ForcedBoundaryBPE(bpe.default_tokenizer())
    coder.fragments = pieces.PieceTable(coder._encode_fragments, bits=9, most=250)
    for _ in range(30):
        texts = ["".join(rng.choice(list("abcdefgh éñ'\n1.")) for _ in range(int(rng.integers(0, 90)))) for _ in range(12)]
        raw = [t.encode() for t in texts]
        ids, first = coder.rows(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [x.tolist() for x in np.split(ids, first[1:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_forced_cuts_lie_in_no_token():
    coder = bpe.coder(bpe.default_tokenizer())
    raw = "a,b é日".encode()
    for i in coder.cuts(raw):
        assert not any(raw[i - 1 : i + 1] in t for t in coder.token_bytes.values())


def test_round_trip(odd, empty, library):
    rows = bpe.round_trip(odd, bpe.default_tokenizer()).collect()
    assert len(rows) == odd.count()
    by_text = {r["doc_id"]: (r["text"] or "") for r in odd.collect()}
    for r in rows:
        ids = np.array(library.encode(by_text[r["doc_id"]], add_special_tokens=False).ids, "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(by_text[r["doc_id"]].encode()).hexdigest()
    assert bpe.round_trip(empty, bpe.default_tokenizer()).count() == 0


def test_encode_and_decode_as_tables(odd):
    path = bpe.default_tokenizer()
    back = bpe.decode(bpe.encode(odd.filter("doc_id > 2"), path), path)
    want = {(r["doc_id"], r["text"] or "") for r in odd.filter("doc_id > 2").collect()}
    assert {(r["doc_id"], r["text"]) for r in back.collect()} == want


# 2: nearest neighbours


def brute(vectors, queries, k):
    """``queries`` are places in ``vectors``: a row leaves out only itself."""
    out = {}
    for n in queries:
        q, v = vectors[n]
        d = sorted((float(np.sqrt(((np.array(v, float) - np.array(x, float)) ** 2).sum())), i) for m, (i, x) in enumerate(vectors) if m != n and len(x) == len(v))
        out.setdefault(q, []).append(d[:k])
    return out


def lists(rows):
    """By query id the lists of (score, vec_id) in order of rank; several queries of one id are kept apart by their order."""
    out, n = {}, {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], {}).setdefault(r["rank"], []).append((r["score"], r["vec_id"]))
    return {q: [[ranks[k][i] for k in sorted(ranks) if i < len(ranks[k])] for i in range(len(ranks[1]))] for q, ranks in out.items()}


@pytest.mark.parametrize(("relax", "regions"), [(1.0, 1), (1.0, 8), (1.2, 8)])
def test_neighbours(spark, relax, regions):
    rng = np.random.default_rng(3)
    vectors = [(int(i), [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(400)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(60)]  # one vector many times
    bad = [(2000, None), (2001, [0.0] * 6), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (2005, [1.0, 2.0]), (None, vectors[20][1])]
    frame = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<float>").withColumn("shard", F.lit(1)).withColumn("rank", F.lit("x")).withColumn("query", F.lit("x"))
    index = neighbours.build(frame, 10, shard_rows=60, most_regions=regions)
    got = lists(neighbours.search(index, frame.filter("vec_id % 20 = 0"), relax, block_queries=7).collect())
    want = brute(vectors, [n for n, v in enumerate(vectors) if v[0] % 20 == 0], 10)
    assert set(got) == set(want) and all(len(x) == 1 for x in got.values())
    hits = sum(len({i for _, i in got[q][0]} & {i for _, i in want[q][0]}) for q in want)
    assert hits >= (1.0 if relax == 1.0 else 0.9) * 10 * len(want)
    if relax == 1.0:
        for q in want:
            assert [i for _, i in got[q][0]] == [i for _, i in want[q][0]]
            assert np.allclose([s for s, _ in got[q][0]], [s for s, _ in want[q][0]], rtol=1e-12)


def test_neighbours_of_repeated_ids(spark):
    """Only a query's own row is left out: not another row with its id, whether its vector is the same or not."""
    vectors = [(0, [1.0, 0.0])] * 3 + [(0, [0.0, 1.0])] + [(i, [1.0, 0.0]) for i in range(1, 6)] + [(20 + i, [float(i), 3.0]) for i in range(6)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = lists(neighbours.search(neighbours.build(frame, 4), frame.filter("vec_id = 0"), 1.0).collect())
    want = brute(vectors, [0, 1, 2, 3], 4)
    assert sorted(got[0]) == sorted(want[0])


def test_neighbours_meet_few_regions(spark):
    """Where distances tell regions apart, pairs of query and region grow with the queries, not with their product."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 8)) * 50
    rows = [(int(i), [float(x) for x in centres[i % 16] + rng.normal(size=8)]) for i in range(1_600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = neighbours.build(frame, 5, shard_rows=100)
    assert len(index.tops[8].paths) == 16
    queries = neighbours.with_regions(neighbours.taking_part(frame.filter("vec_id % 10 = 0")), index.tops)
    queries = queries.withColumn("query", F.col("vec_id")).withColumn("most", F.lit(10.0))
    assert neighbours.elsewhere(index, queries, 1.0).count() < 2 * 160


def test_neighbours_recall_on_the_table(spark):
    got = neighbours.op2_neighbours(spark, SMALL).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SMALL, "embeddings").collect()]
    want = brute(rows, [n for n, r in enumerate(rows) if r[0] % 100 == 0], 10)
    hits = sum((r["query_id"], r["vec_id"]) in {(q, i) for q, d in want.items() for _, i in d[0]} for r in got)
    assert len(got) == 10 * len(want) and hits >= 0.9 * len(got)


def test_few_or_no_neighbours(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in neighbours.search(neighbours.build(frame, 10), frame.filter("vec_id = 0")).collect()] == [(0, 1, 1, 0.0)]
    none = frame.limit(0)
    assert neighbours.search(neighbours.build(none, 10), none).count() == 0
    assert neighbours.search(neighbours.build(none, 10), frame).count() == 0


# 3: language identification


def test_language_accuracy_on_the_held_out_fold(spark):
    rows = langid.op3_language_id(spark, SMALL).join(table(spark, SMALL, "documents").select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_kernel_is_the_presence_kernel():
    model = langid.fit(["abab", "xyz"], ["a", "b"])
    raw = "abba".encode()
    ours, theirs = set(langid.grams(raw).tolist()), set(langid.grams(b"abab").tolist())
    assert np.isclose(model.kernels(np.frombuffer(raw, np.uint8), np.array([0, 4]))[0, 0], len(ours & theirs) / np.sqrt(len(ours) * len(theirs)))


def plain_margins(train, names, landmarks, asked, ridge=1e-2):
    """Margins of kernel ridge regression by sets of n-grams and dense matrices."""

    def grams(text):
        raw = text.lower().encode()
        return {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}

    kernel = lambda a, b: len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b)))
    sets, known = [grams(t) for t in train], sorted(set(names))
    chosen = [i for x in known for i in [k for k, y in enumerate(names) if y == x][:landmarks]]
    inner = np.array([[kernel(sets[i], sets[j]) for j in chosen] for i in chosen])
    values, vectors = np.linalg.eigh(inner)
    whiten = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    x = np.array([[kernel(s, sets[j]) for j in chosen] for s in sets]) @ whiten
    y = np.array([[1.0 if n == k else -1.0 for k in known] for n in names])
    w = np.sqrt(1 / np.array([names.count(n) for n in names]))[:, None]
    solved = np.linalg.solve((x * w).T @ (x * w) + ridge * np.eye(x.shape[1]), (x * w).T @ (y * w))
    return known, np.array([[kernel(s, sets[j]) for j in chosen] for s in map(grams, asked)]) @ whiten @ solved


@pytest.mark.parametrize("share", [1, 16, 10_000])
def test_language_margins_are_the_plain_ones(spark, monkeypatch, share):
    """Whatever part of the grams is dense."""
    monkeypatch.setattr(langid, "DENSE_SHARE", share)
    rows = [r for r in table(spark, SMALL, "documents").orderBy("doc_id").collect() if r["text"] and r["lang"] and len(r["text"]) < 4_000]
    some, asked = rows[:60], [r["text"] for r in rows[60:90]] + ["", "a", "ñ日"]
    known, want = plain_margins([r["text"] for r in some], [r["lang"] for r in some], 4, asked)
    model = langid.fit([r["text"] for r in some], [r["lang"] for r in some], 4)
    raw = [t.lower().encode() for t in asked]
    got = model.margins(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert model.languages == known and np.allclose(got, want, atol=2e-3)
    sizes = [len(r) > 0 for r in raw]
    assert (got.argmax(1) == want.argmax(1))[sizes].all()


def test_every_language_is_learned(spark):
    """Seventy languages, some of very few rows, of long texts: none is left out, no text is cut."""
    rng = np.random.default_rng(11)
    word = lambda k: "".join(chr(0x4E00 + 40 * k + int(x)) for x in rng.integers(0, 40, 3))
    rows = [(70 * i + k, " ".join(["."] * 12_000 * (k == 0)) + " " + " ".join(word(k) for _ in range(30)), "x%02d" % k) for i in range(3) for k in range(70)]
    docs = spark.createDataFrame(rows + rows[:70], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert len(model.languages) == 70
    got = langid.identify(docs, model, ("lang",)).collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)
    assert langid.labelled_sample(docs, 2)[0][1].dtype == np.int32 and len(langid.labelled_sample(docs, 2)) == 140


def test_language_cases(spark, odd, empty):
    model = langid.train(table(spark, SMALL, "documents"))
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["lang_pred"] == by[1]["lang_pred"] == by[2]["lang_pred"] == "und" and by[0]["score"] == 0
    assert by[3]["lang_pred"] != "und"
    assert langid.train(empty) is None and langid.identify(odd, None).filter("lang_pred != 'und'").count() == 0
    assert langid.identify(empty, model).count() == 0


# 4: token files


def test_token_files(spark, odd, empty, library):
    path = table_path(spark, "test-tokens")
    docs = odd.dropDuplicates(["doc_id"])
    token_files.write(docs, bpe.default_tokenizer(), path)
    start = 0
    got = {r["doc_id"]: r for r in token_files.digests(token_files.read(spark, path)).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    some = token_files.read(spark, path, (), 3, 5)
    assert sorted(r["doc_id"] for r in some.collect()) == [3, 4]
    plan = some._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[1][:120] and "GreaterThanOrEqual(doc_id,3)" in plan
    token_files.write(empty, bpe.default_tokenizer(), path + "-empty")
    assert token_files.read(spark, path + "-empty").count() == 0
    token_files.write(odd, bpe.default_tokenizer(), path + "-ties")
    assert token_files.read(spark, path + "-ties").count() == odd.count()


def test_token_files_have_page_indexes_and_encodings(spark):
    import glob

    import pyarrow.parquet as pq

    path = table_path(spark, "test-encodings")
    token_files.write(table(spark, SMALL, "documents"), bpe.default_tokenizer(), path)
    file = pq.ParquetFile(sorted(glob.glob(path.removeprefix("file://") + "/part-*"))[0])
    columns = {file.metadata.row_group(0).column(i).path_in_schema: file.metadata.row_group(0).column(i) for i in range(file.metadata.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
    assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index


# 5: sharding


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, n = (low + high) // 2, 0, 1
        for s in sizes:
            if used + s > mid:
                n, used = n + 1, 0
            used += s
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=60), st.integers(1, 9))
def test_cuts_are_minimax(sizes, shards):
    class Held:
        def __init__(self):
            self.ends = [0, *np.cumsum(sizes).tolist()]
            self.total, self.most = self.ends[-1], max(sizes)

        def near(self, _):
            pass

        def below(self, x):
            return self.ends[bisect.bisect_right(self.ends, min(x, self.total)) - 1]

        def above(self, x):
            return self.ends[bisect.bisect_left(self.ends, max(0, min(x, self.total)))]

    capacity, at = sharding.cuts(Held(), shards)
    assert capacity == least_capacity(sizes, shards)
    edges = [0, *at, sum(sizes)]
    assert edges == sorted(edges) and max(b - a for a, b in zip(edges, edges[1:])) == capacity


@pytest.mark.parametrize(("part", "ahead", "kept"), [(2_048, 40_000, 200_000), (3, 0, 50)])
def test_group_sizes_in_parts(spark, monkeypatch, part, ahead, kept):
    """Boundaries are the plain ones, however few groups may be read at once."""
    for name, value in (("PART_GROUPS", part), ("AHEAD_GROUPS", ahead), ("KEPT", kept), ("DIGITS", 1)):
        monkeypatch.setattr(sharding, name, value)
    rng = np.random.default_rng(9)
    rows = sorted((hashlib.sha256(b"%d" % i).hexdigest(), int(rng.integers(1, 40))) for i in range(300))
    sizes = sharding.GroupSizes(spark.createDataFrame(rows, "digest string, bytes long"))
    ends = [0, *np.cumsum([b for _, b in rows]).tolist()]
    sizes.near(16)
    assert sizes.total == ends[-1] and sizes.most == max(b for _, b in rows)
    for x in rng.integers(0, ends[-1], 25).tolist():
        assert sizes.below(x) == ends[bisect.bisect_right(ends, x) - 1] and sizes.above(x) == ends[bisect.bisect_left(ends, x)]
        assert sizes.digest_at(sizes.below(x)) == rows[bisect.bisect_right(ends, x) - 1][0]


def check_shards(rows, texts):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
        text = texts[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode()) and r["law"] == "bytes" and r["grown_shard"] is None
    for got in by.values():
        assert sorted(r["slot"] for r in got) == list(range(len(got)))
    shard_of = {}
    for r in rows:
        assert shard_of.setdefault(texts[r["doc_id"]] or "", r["shard"]) == r["shard"]
    groups = {}
    for r in rows:
        d = hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
        groups[d] = groups.get(d, 0) + r["size"]
    sizes = [groups[d] for d in sorted(groups)]
    assert max(sum(r["size"] for r in got) for got in by.values()) == least_capacity(sizes, 16)


def test_sharding(spark, odd, empty):
    docs = table(spark, SMALL, "documents")
    check_shards(sharding.op5_sharding(spark, SMALL).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})
    rows = sharding.shard(odd).collect()
    assert len(rows) == odd.count()
    check_shards(rows, {r["doc_id"]: r["text"] for r in odd.collect()})
    assert sharding.shard(empty).count() == 0


# 6: HTML


ARTICLE = "<h1>Head &amp; more</h1><p>First  long paragraph\n of the text &eacute;.<p>Short.<ul><li>one<li>two</ul><p>Last <b>bold</b><br>line."
WANT = "Head & more\nFirst long paragraph of the text é.\nShort.\none\ntwo\nLast bold line."


def main_text(html):
    return html_text.main_text(html_text.LineReader(), html)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>Only this", "Only this"),
        (f"<html><head><title>t</title><style>x</style></head><body><header>site</header><nav><ul><li>a</ul></nav><article>{ARTICLE}</article><aside>side</aside><div class='ad'>buy now</div><section id=comments><p>A long comment by some reader of this page</section><footer>foot</footer></body>", WANT),
        (f"<body><div id='main-menu'><a>x</a></div><div class='cookie-notice'>We use cookies</div><main>{ARTICLE}<form><input><p>mail</form><div class='comments'><article><p>reader says much about it</article></div></main><script>if (a<b) x</script></body>", WANT),
        (f"<body><div class=sidebar><p>side text here</div><div class=content>{ARTICLE}</div><div class='footer'>foot</div></body>", WANT),
        # Names of layouts, heads that are left open, sections of a paper, comments that are left open.
        (f"<div class='layout has-sidebar'><article>{ARTICLE}</article></div>", WANT),
        (f"<body><div class='with-sidebar'><div class=sidebar><p>side text</div><article>{ARTICLE}</article></div>", WANT),
        (f"<div class='sidebar-layout page-footer'><div class=sidebar><p>side</div><article>{ARTICLE}</article></div>", WANT),
        (f"<html><head><title>x</title><meta charset=utf-8><body><nav><a>q</a></nav><article>{ARTICLE}</article>", WANT),
        (f"<html><head><title>x</title><script>1</script><article>{ARTICLE}</article>", WANT),
        ("<head><title>x</title>Words with no tag at all.", "Words with no tag at all."),
        ("<article><div class=article-header><h1>T</h1></div><p>One paragraph is here<section id=discussion><p>Discussed</section><section class=related-work><p>Work</section><div class=related-posts><a>p</a></div></article>", "T\nOne paragraph is here\nDiscussed\nWork"),
        (f"<article>{ARTICLE}</article><!-- open <p>more", WANT),
        # An advert longer than the article.
        ("<body><div class=ad>Buy this very long thing now, it is better than all that you can read here.</div><article><h1>T</h1><p>Few words.</article>", "T\nFew words."),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        # One dominant paragraph; two sibling sections; a title far from the only long paragraph; paragraphs of one list.
        ("<body><nav><a>x</a></nav><div><h1>T</h1><p>{0}</p><p>{1}</p></div></body>", "T\n{0}\n{1}"),
        ("<body><div><h2>One</h2><p>{0}</p></div><div><h2>Two</h2><p>{1}</p></div><footer>f</footer></body>", "One\n{0}\nTwo\n{1}"),
        ("<body><nav><a>x</a></nav><div><h1>T</h1><p>by A</p><p>May</p><p>in B</p><p>{0}</p></div></body>", "T\nby A\nMay\nin B\n{0}"),
        ("<body><ul><li><p>{0}</p><li><p>{1}</p></ul></body>", "{0}\n{1}"),
    ],
)
def test_main_text_without_article(html, text):
    long, less = "long text " * 59 + "ends", "less text " * 29 + "ends"
    assert main_text(html.format(long, less)) == text.format(long, less)


def test_ratios_choose_the_region(monkeypatch):
    """Pages that mark nothing: only the ratios tell the text from the lists beside it."""
    rng = np.random.default_rng(7)
    some = lambda n: " ".join("w%d" % x for x in rng.integers(0, 900, n))
    pages, want = [], []
    for _ in range(40):
        beside = lambda: "<div>" + "".join(f"<div><span>{some(2)}</span> <i>{some(1)}</i></div>" for _ in range(int(rng.integers(4, 9)))) + "</div>"
        lines = [some(int(rng.integers(25, 90))) for _ in range(int(rng.integers(3, 9)))]
        pages.append(f"<body>{beside()}<div>" + "".join(f"<p>{x}</p>" for x in lines) + f"</div>{beside()}</body>")
        want.append("\n".join(lines))
    assert [main_text(x) for x in pages] == want
    monkeypatch.setattr(html_text, "ratios", lambda lines: np.ones(len(lines)))
    assert sum(main_text(x) != w for x, w in zip(pages, want)) == 40


def plain_article(html):
    """The article of the table's pages by patterns alone."""
    import html as entities
    import re

    body = re.sub(r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>", "", re.search(r"(?s)<article>(.*?)</article>", html)[1])
    lines = re.split(r"</?(?:p|h[1-6]|li|ul|div|table|tr|td|th|blockquote)\b[^>]*>", re.sub(r"<br\s*/?>", " ", body))
    found = (re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in lines)
    return "\n".join(x for x in found if x)


def test_html_over_pages(spark):
    data = "/root/testdata/sf0.01"
    rows = html_text.op6_html_text(spark, data).collect()
    pages = {r["page_id"]: r["html"] for r in table(spark, data, "pages").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r["n_chars"] == len(r["text"]) and r["text"] == plain_article(pages[r["page_id"]])
    frame = spark.createDataFrame([(1, None, None, "x"), (1, None, "<p>a</p>" * 3_000, "y"), (None, None, "<p>b", "y")], "page_id long, url string, html string, text string")
    assert [(r["page_id"], r["n_chars"]) for r in html_text.extract(frame).collect()] == [(1, 0), (1, 5_999), (None, 1)]
    assert html_text.extract(frame.limit(0)).count() == 0


# 7: WARC


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT_CHARS", 700)
    body = "<p>zwölf Boxkämpfer 日本\r\n\r\nWARC/1.1\r\n</p>" * 100
    pages = [(5, "u", body), (3, None, body), (9, "u v\r\n", "short"), (4, "u", "short"), (7, "u", None), (8, "u", "x" * 100), (2, "u", "x" * 100), (1, "u", "x" * 99), (11, "u", "x" * 99), (12, "u", body * 12)]
    frame = spark.createDataFrame([(*p, 0, "d") for p in pages], "page_id long, url string, html string, bytes int, digest string")
    path = table_path(spark, "test-warc")
    warc.write(frame, path)
    rows = {r["page_id"]: r for r in warc.read(spark, path, with_payload=True).collect()}
    assert len(rows) == len(pages)
    refers = {5: 3, 8: 2}
    for i, _, html in pages:
        raw = (html or "").encode()
        r = rows[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", refers[i]) if i in refers else ("response", None))
        assert r["payload"] == (None if i in refers else raw)
    warc.write(frame.limit(0), path + "-empty")
    assert warc.read(spark, path + "-empty").count() == 0


def test_warc_records_refer_to_records(spark, monkeypatch):
    """Every identifier stands once, and a revisit names that of a response; repeated rows and null ids included."""
    monkeypatch.setattr(warc, "SEGMENT_CHARS", 300)
    body = "<p>some words</p>" * 60
    pages = [(3, "u", body), (3, "u", body), (3, "v", body), (5, "u", body), (None, "u", body), (4, None, "tiny"), (4, None, "tiny"), (None, "w", "x" * 200), (None, "w", "x" * 200)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = table_path(spark, "test-warc-ids")
    warc.write(frame, path)
    heads = [f for r in spark.read.format("binaryFile").load(path).filter("path like '%.gz'").collect() for f, _ in warc.parse(warc.inflated(bytes(r["content"]), 50))]
    names = [f["warc-record-id"] for f in heads]
    assert len(set(names)) == len(names)
    responses = {f["warc-record-id"] for f in heads if f["warc-type"] == "response"}
    revisits = [f for f in heads if f["warc-type"] == "revisit"]
    assert len(revisits) == 5 and {f["warc-refers-to"] for f in revisits} <= responses
    rows = warc.read(spark, path).collect()
    got = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in rows)
    assert got == sorted([("3", "response", "None"), ("3", "revisit", "3"), ("3", "revisit", "3"), ("5", "revisit", "3"), ("None", "revisit", "3"), ("4", "response", "None"), ("4", "response", "None"), ("None", "response", "None"), ("None", "revisit", "None")])
    assert all(r["payload_bytes"] in (len(body), 4, 200) for r in rows)


def test_parts_of_an_archive():
    """A file in any parts, in one gzip member or several, gives the same records; a file that is cut raises."""
    import gzip

    whole = "".join(x + warc.BETWEEN for i in range(5) for x in warc.records(i, "u", "<p>é</p>" * i * 9, 9 * len("<p>é</p>".encode()) * i, "d%d" % i, None, 0)).encode()
    want = list(warc.parse([whole]))
    assert len(want) == 5
    for step in (1, 7, 1 << 20):
        assert list(warc.parse(warc.inflated(whole, step))) == want
        assert list(warc.parse(warc.inflated(gzip.compress(whole[:900]) + gzip.compress(whole[900:]), step))) == want
    for bad in (whole[:-3], whole[:40], b"x" + whole):
        with pytest.raises(ValueError):
            list(warc.parse([bad]))
    with pytest.raises(ValueError):
        list(warc.parse(warc.inflated(gzip.compress(whole)[:-20])))


def test_warc_table(spark):
    """Against digests and smallest ids by pandas."""
    pages = table(spark, SMALL, "pages").toPandas()
    raw = pages["html"].fillna("").map(str.encode)
    pages["digest"], pages["n"] = raw.map(lambda x: hashlib.sha256(x).hexdigest()), raw.map(len)
    pages["first"] = pages.groupby("digest")["page_id"].transform("min")
    got = {r["page_id"]: r for r in warc.op7_warc(spark, SMALL).collect()}
    assert len(got) == len(pages)
    for p in pages.itertuples():
        again = p.n >= 100 and p.first != p.page_id
        assert (got[p.page_id]["payload_bytes"], got[p.page_id]["payload_digest"], got[p.page_id]["record_type"], got[p.page_id]["refers_to"]) == (p.n, p.digest, "revisit" if again else "response", p.first if again else None)


def test_segments_and_chunks():
    assert warc.assembled([(2, 5, b"de"), (1, None, b"abc")]) == b"abcde"
    for bad in ([(1, None, b"a"), (3, 2, b"b")], [(1, None, b"a"), (2, 5, b"b")], [(1, None, b"a")]):
        with pytest.raises(ValueError):
            warc.assembled(bad)
    assert warc.dechunked(b"3\r\nabc\r\n2;x=1\r\nde\r\n0\r\n\r\n") == b"abcde"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


# 8: Jaccard join


def shingles(text):
    words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(s), root(i)) for i, s in sets}


def check_jaccard(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_components(rows)
    got = jaccard.jaccard_components(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_jaccard_on_the_table(spark):
    check_jaccard(table(spark, SMALL, "documents"))


def test_jaccard_near_copies_at_the_edge(spark, monkeypatch):
    """Chains whose ends are not similar, pairs just at and under the threshold, and a large group of near copies,
    with blocks so small that the group is dealt over many tasks."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "PART_ROWS", 20)
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    passage = [word() for _ in range(40)]
    rows = []
    for g in range(12):
        base = [word() for _ in range(int(rng.integers(12, 60)))] + (passage if g % 2 else [])
        for c in range(int(rng.integers(2, 12))):
            base = list(base)
            for _ in range(int(rng.integers(0, 3))):
                base[int(rng.integers(0, len(base)))] = word()
            rows.append((len(rows), " ".join(base)))
    for n in range(5, 60, 6):  # one word added: intersection over union goes through the threshold
        base = [word() for _ in range(n)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base, word()])), (len(rows) + 2, " ".join([*base, word(), word(), word()]))]
    check_jaccard(spark.createDataFrame(rows, "doc_id long, text string"))


def test_jaccard_cases(spark, odd, empty):
    rows = jaccard.jaccard_components(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert by[0] == (0, 0) and by[1] == (0, 1) and by[3] == (1, 3) and by[9] == (1, 9) and by[10] == (1, 9) and by[7] == (1, 7)
    assert jaccard.jaccard_components(empty).count() == 0
    null = spark.createDataFrame([(None, "a b"), (1, "A  b"), (2, "a\tB")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(null).collect()} == {(None, None), (1, 1), (2, 1)}


def test_count_vectors_never_rule_out_a_link():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 5, (300, jaccard.COORDINATES)).astype(np.int32)
    points[100:200] = np.maximum(points[:100] + rng.integers(-1, 2, (100, jaccard.COORDINATES)) * (rng.random((100, jaccard.COORDINATES)) < 0.1), 0)
    sizes = points.sum(1)
    tree = jaccard.CountTree(points, sizes)
    for i in range(0, 300, 7):
        near = set(tree.near(points[i], int(sizes[i])).tolist())
        overlap = np.minimum(points, points[i]).sum(1)
        assert {j for j in range(300) if 7 * overlap[j] >= 3 * (sizes[i] + sizes[j])} <= near


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=25))
def test_components(spark, pairs):
    parent = list(range(13))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for a, b in pairs if a != b for x in (a, b)}
    frame = spark.createDataFrame(pairs, "a long, b long") if pairs else spark.createDataFrame([], "a long, b long")
    assert {r["node"]: r["component"] for r in components.components(frame).collect()} == want


def test_components_of_a_long_path(spark):
    rng = np.random.default_rng(12)
    order = rng.permutation(3_000).tolist()
    frame = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    assert {(r["node"], r["component"]) for r in components.components(frame).collect()} == {(i, 0) for i in range(3_000)}


def test_the_tree_supplies_the_candidates(spark, monkeypatch):
    """Every verified pair was named by an R-tree; bounds leave few that are no links; and without trees there are none."""
    seen = []

    def spy(pairs, nodes, real=jaccard.linked):
        links = real(pairs, nodes)
        seen.append((pairs.count(), links.count()))
        return links

    monkeypatch.setattr(jaccard, "linked", spy)
    docs = table(spark, SMALL, "documents")
    want = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    (pairs, links), (more, more_links) = seen
    assert links > 0 and pairs < 4 * links and more_links <= more
    assert len(set(want.values())) <= len(want) - links
    seen.clear()
    monkeypatch.setattr(jaccard, "_group_pairs", lambda rows: jaccard._pairs([], []))
    monkeypatch.setattr(jaccard, "_bucket_pairs", lambda rows: jaccard._pairs([], []))
    assert all(r["component_id"] in want for r in jaccard.jaccard_components(docs).collect()) and seen == [(0, 0), (0, 0)]


# 9: decontamination


def test_decontamination_finds_what_is_there(spark):
    import re

    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    docs, items = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    want = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect() if plain(i["text"]) in plain(d["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.op9_decontamination(spark, SMALL).collect()}
    assert want and want <= got and len(got - want) <= 0.05 * len(got) + 1


def test_pruning_loses_no_item():
    """Against scores of every item in every passage; and blocks that cannot reach the threshold are really skipped."""
    rng = np.random.default_rng(2)
    vocabulary = ["w%d" % i for i in range(80)]
    items = [" ".join(rng.choice(vocabulary, int(rng.integers(4, 20)))) for _ in range(50)]
    docs = [" ".join([*rng.choice(vocabulary, 15), *items[k % 50].split()[: int(rng.integers(3, 20))], *rng.choice(vocabulary, 15)]) for k in range(60)]
    index = decontamination.build(list(range(50)), items, 0.5)
    hashes, first = decontamination.words(*decontamination.packed(docs))
    row, item, score = decontamination.retrieve(index, hashes, first)
    got = {(int(r), int(i)): float(s) for r, i, s in zip(row, item, score)}
    weight = {(int(t), int(i)): float(w) for t in range(len(index.terms)) for i, w in zip(index.items[index.first[t] : index.first[t + 1]], index.weights[index.first[t] : index.first[t + 1]])}
    want = {}
    place = {int(h): k for k, h in enumerate(index.terms)}
    for r in range(len(docs)):
        mine = hashes[first[r] : first[r + 1]].tolist()
        for p in range(len(mine) // index.longest + 1):
            terms = {place[h] for h in mine[p * index.longest : (p + 2) * index.longest] if h in place}
            every = {i: sum(weight.get((t, i), 0) for t in terms) for i in range(50)}
            for i, s in every.items():
                if s >= 0.5 - 1e-9:
                    want[r, i] = max(want.get((r, i), 0), s)
            # The traversal alone, with all blocks left.
            found = dict(decontamination.block_max_wand(index, np.array(sorted(terms), np.int64), np.arange(7)))
            assert set(found) == {i for i, s in every.items() if s >= 0.5 - 1e-9}
    assert set(got) == set(want) and all(np.isclose(got[k], want[k]) for k in want)


def plain_overlap(item, document):
    """Shares of the 3-word runs of an item's question and answer in a document, by words and lists alone."""
    import re

    cut = lambda t: re.findall(r"[^\W_]+", t.lower())
    inside = cut(document)
    runs = {tuple(inside[i : i + 3]) for i in range(len(inside))}
    shares = []
    for side in decontamination.question_and_answer(item):
        w = cut(side)
        mine = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
        shares.append(sum(x in runs if len(x) == 3 else set(x) <= set(inside) for x in mine) / len(mine))
    return shares


def test_verified_pairs_are_the_plain_ones(spark):
    """Every pair over the score, verified by plain lists of words, and no other."""
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, SMALL, "documents").collect()}
    items = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    found = {(r["doc_id"], r["item_id"]): (r["question_overlap"], r["answer_overlap"]) for r in decontamination.op9_decontamination(spark, SMALL).collect()}
    index = decontamination.build([i for i, _ in items], [t for _, t in items])
    texts = dict(items)
    ids = list(docs)
    row, item, _ = decontamination.retrieve(index, *decontamination.words(*decontamination.packed([docs[i] for i in ids])))
    want = {}
    for r, i in zip(row.tolist(), item.tolist()):
        shares = plain_overlap(texts[index.ids[i]], docs[ids[r]])
        if min(shares) >= 0.5:
            want[ids[r], index.ids[i]] = shares
    assert set(found) == set(want) and all(np.allclose(found[k], want[k]) for k in want)


def test_null_items_and_parts(spark):
    docs = spark.createDataFrame([(7, "So, the Quick brown fox jumps over a lazy dog! Then"), (None, "one two three four five six seven")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "the quick brown fox jumps over a lazy dog"), (None, "one two three four five six seven"), (3, "the quick brown fox jumps over a lazy dog")], "item_id long, text string")
    want = [(None, None), (7, None), (7, 3)]
    for size in (decontamination.INDEX_BYTES, 40):
        got = [(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items, size).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_decontamination_cases(spark, odd, empty):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over a lazy dog"), (2, None), (3, ""), (4, "...")], "item_id long, text string").withColumn("score", F.lit(1))
    assert decontamination.contaminated(odd, items).count() == 0
    assert decontamination.contaminated(empty, items).count() == 0
    assert decontamination.contaminated(odd, items.limit(0)).count() == 0
    docs = spark.createDataFrame([(7, "So, the Quick brown fox jumps over a lazy dog! Then"), (8, "the quick dog"), (7, "So, the Quick brown fox jumps over a lazy dog! Then")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items).collect()] == [(7, 1), (7, 1)]
    assert decontamination.question_and_answer("What is it? A thing.") == ("What is it?", " A thing.")


def test_decontamination_finds_long_items(spark):
    rng = np.random.default_rng(3)
    some = lambda n: " ".join("v%d" % x for x in rng.integers(0, 200_000, n))
    long, middle, short = some(3_000), some(900), some(30)
    items = spark.createDataFrame([(1, long), (2, middle), (3, short)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{some(700)} {long} {some(5_000)}"), (2, f"{some(1_300)} {middle} {some(400)}"), (3, f"{some(50)} {short}"), (4, some(8_000)), (5, " ".join(long.split()[:1_000]))], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.contaminated(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3)} and all(np.isclose(x, 1) for x in got.values())


def test_decontamination_weights_do_not_depend_on_parts(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join("w%d" % x for x in rng.integers(0, 60, int(rng.integers(5, 900)))) for _ in range(40)]
    items = spark.createDataFrame([*enumerate(texts), (40, "..."), (40, "...")], "item_id long, text string")

    def weights(parts):
        out = {}
        for index in (x for part in parts for x in part):
            term = np.repeat(index.terms, np.diff(index.first))
            out.update({(index.ids[i], int(t)): float(w) for i, t, w in zip(index.items, term, index.weights)})
        return out

    whole, parts = list(decontamination.item_parts(items)), list(decontamination.item_parts(items, 20_000))
    assert len(whole) == 1 and len(parts) > 3
    want, got = weights(whole), weights(parts)
    assert set(want) == set(got) and all(np.isclose(got[k], want[k]) for k in want)


# 10: quality


def test_quality_on_the_held_out_fold(spark):
    data = "/root/testdata/sf0.01"
    rows = quality.op10_quality(spark, data).join(table(spark, data, "labels").select("doc_id", "quality"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.93 * len(held)


def test_votes_are_the_plain_ones(spark):
    """Scores against a plain version: cosines of all pairs in double precision, sorted, one text after the other."""
    data = "/root/testdata/sf0.001"
    docs = table(spark, data, "documents").select("doc_id", "text")
    labels = table(spark, data, "labels").select("doc_id", "quality")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for r in docs.collect():
        raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
        [(terms, values)] = quality.term_rows(raw, np.array([0, len(raw)]), model.vocabulary)
        x = np.zeros(len(model.axes))
        for t, v in zip(terms.tolist(), values.tolist()):
            if model.column[t] >= 0:
                x[model.column[t]] = v
        x = x @ model.axes.astype(float)
        cosines = sorted(((float(c), y) for c, y in zip(model.vectors.astype(float) @ (x / (np.linalg.norm(x) or 1)), model.labels)), key=lambda p: -p[0])[: quality.NEIGHBOURS]
        weights = [max(c, 0) ** quality.SHARPNESS for c, _ in cosines]
        want = sum(w * y for w, (_, y) in zip(weights, cosines)) / sum(weights) if sum(weights) else model.mean
        assert np.isclose(got[r["doc_id"]], want, atol=2e-3)


def test_axes_and_terms_are_the_plain_ones():
    import re

    text = "The cat, the hat! The CAT\nsat"
    raw = np.frombuffer(text.encode(), np.uint8)
    the, cat, odd = (int.from_bytes(x, "big") for x in (b"the", b"cat", b"zzz"))
    one = lambda w: int(shared.SpanHasher(np.frombuffer(w, np.uint8))(np.array([0]), np.array([len(w)]))[0])
    words = sorted([one(b"the"), one(b"cat"), one(b"none")])
    vocabulary = quality.Vocabulary(np.array(sorted([the, cat, odd])), np.array(words, np.uint64))
    [(terms, values)] = quality.term_rows(raw, np.array([0, len(raw)]), vocabulary)
    held = {int(t) - quality.SHAPES: round(float(np.expm1(v))) for t, v in zip(terms, values) if t >= quality.SHAPES}
    want = {k: len(re.findall(x.to_bytes(3, "big").decode(), text.lower())) for k, x in enumerate(vocabulary.trigrams.tolist())}
    want |= {3 + k: text.lower().split().count({one(b"the"): "the", one(b"cat"): "cat", one(b"none"): "none"}[w]) for k, w in enumerate(words)}
    assert held == {k: n for k, n in want.items() if n}
    rng = np.random.default_rng(13)
    x = rng.normal(size=(90, 4)) @ rng.normal(size=(4, 30)) + 0.01 * rng.normal(size=(90, 30))
    rows = [(np.arange(30, dtype=np.int32), r.astype(np.float32)) for r in x]
    axes = quality.latent_axes(rows, np.arange(30), np.ones(30, np.float32), 4)
    best = np.linalg.svd(x / np.linalg.norm(x, axis=1, keepdims=True))[2][:4]
    assert np.allclose(np.abs(best @ axes), np.eye(4), atol=1e-2)
    assert quality.ranked_area(np.array([0.1, 0.4, 0.4, 0.9]), np.array([0.0, 0.0, 1.0, 1.0])) == 0.875


def test_quality_cases(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (5, 0), (7, None), (99, 1)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] in (0, 1)} == {0.5}
    none = quality.train(odd, labels.limit(0))
    assert {r["score"] for r in quality.score(odd, none).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0
