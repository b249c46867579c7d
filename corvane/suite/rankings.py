"""Queries of ranking, widening, evidence and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import scoring
from corvane.operators import evidence, highlight, ranking, vectors, widening
from corvane.plans import language as q
from corvane.sources import chunking
from corvane.suite.common import KEYS, NOW, SCORED, TOKENS, answer, document_chunks, documents_index, found, index_of, query, scored_sql, table, with_ids
from corvane.suite.matching import A, B, C

_PASSES = f""", lex AS (SELECT doc_id, sum(score) AS score FROM s WHERE term IN ('{A}', '{B}') GROUP BY doc_id),
syn AS (SELECT doc_id, sum(score) AS score FROM s WHERE term IN ('{B}', '{C}') GROUP BY doc_id)"""
_RANKS = """, r AS (SELECT 'lex' AS source, 1.0 AS weight, doc_id, score, rank() OVER (ORDER BY score DESC) AS rank FROM (SELECT * FROM lex ORDER BY score DESC, sha1('documents/' || doc_id) LIMIT 200)
UNION ALL SELECT 'syn', 0.6, doc_id, score, rank() OVER (ORDER BY score DESC) FROM (SELECT * FROM syn ORDER BY score DESC, sha1('documents/' || doc_id) LIMIT 200))"""


def _two(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return index, [("lex", found(index, f"{A} {B}"), 1.0), ("syn", found(index, f"{B} {C}"), scoring.SYNONYM_WEIGHT)]


@query("rrf_fusion", scored_sql(f"{_PASSES}{_RANKS} SELECT doc_id, round(sum(weight / (60 + rank)), 6) AS rank_score, round(max(score), 6) AS score FROM r GROUP BY doc_id"))
def rrf_fusion(spark, sf_dir):
    index, passes = _two(spark, sf_dir)
    return with_ids(index, ranking.fuse(passes, 200)).select("doc_id", F.round("rank_score", 6).alias("rank_score"), F.round("score", 6).alias("score"))


@query("source_attribution", scored_sql(f"{_PASSES}{_RANKS} SELECT doc_id, arg_min(source, rank * 10 - weight) AS source FROM r GROUP BY doc_id"))
def source_attribution(spark, sf_dir):
    index, passes = _two(spark, sf_dir)
    return with_ids(index, ranking.fuse(passes, 200)).select("doc_id", "source")


@query("cascade_union", scored_sql(f"{_PASSES} SELECT coalesce(lex.doc_id, syn.doc_id) AS doc_id, CASE WHEN lex.doc_id IS NULL THEN 1 ELSE 0 END AS pass_index, round(coalesce(lex.score, syn.score), 6) AS score FROM lex FULL OUTER JOIN syn ON lex.doc_id = syn.doc_id"))
def cascade_union(spark, sf_dir):
    index, passes = _two(spark, sf_dir)
    return with_ids(index, ranking.cascade([p for _, p, _ in passes])).select("doc_id", "pass_index", F.round("score", 6).alias("score"))


@query(
    "strong_signal",
    scored_sql(
        f""", p AS (SELECT doc_id, sum(score) AS x FROM s WHERE term IN ('{B}') GROUP BY doc_id), o AS (SELECT x / (1 + x) AS y FROM p ORDER BY x DESC LIMIT 2)
SELECT round(max(y), 6) AS top, round(CASE WHEN count(*) > 1 THEN min(y) ELSE 0 END, 6) AS second, max(y) >= 0.85 AND max(y) - CASE WHEN count(*) > 1 THEN min(y) ELSE 0 END >= 0.15 AS fired FROM o"""
    ),
)
def strong_signal(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return ranking.strong_signal(found(index, B)).select(F.round("top", 6).alias("top"), F.round("second", 6).alias("second"), "fired")


def _conversations(spark, sf_dir):
    """A file per conversation, a chunk per turn, the role as its heading."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").cast("string").alias("parent_id"), F.col("turn").alias("chunk_seq"), F.lit("conversations").alias("collection"), F.col("role").alias("heading_path"), F.coalesce("text", F.lit("")).alias("body"), F.lit("txt").alias("kind"))


def _talks(spark, sf_dir):
    return index_of(spark, sf_dir, "conversations", lambda: _conversations(spark, sf_dir), fields={"words": "body", "heading": "heading_path"})


_TALKS = """
d AS (SELECT conv_id, turn, role, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'), lambda x: strlen(x) <= 40) AS w FROM conversations),
tok AS (SELECT conv_id, turn, unnest(w) AS term FROM d),
tf AS (SELECT conv_id, turn, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n, (SELECT count(*) FROM tok)::DOUBLE / count(*) AS mean FROM d),
s AS (SELECT tf.conv_id, tf.turn, tf.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) AS score
      FROM tf JOIN df USING (term) JOIN d USING (conv_id, turn) CROSS JOIN st)
"""


@query(
    "group_by_file",
    f"""WITH {_TALKS}, h AS (SELECT conv_id, turn, sum(score) AS score FROM s WHERE term IN ('the', 'of') GROUP BY conv_id, turn),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS place, max(score) OVER (PARTITION BY conv_id) AS best FROM h)
SELECT conv_id, turn, place, round(score, 6) AS score, round(best, 6) AS file_score FROM r WHERE place <= 3""",
)
def group_by_file(spark, sf_dir):
    rows = ranking.by_file(found(_talks(spark, sf_dir), "the of"), 3)
    return rows.select(F.col("parent_id").cast("long").alias("conv_id"), F.col("chunk_seq").alias("turn"), F.col("place").cast("long").alias("place"), F.round("score", 6).alias("score"), F.round("file_score", 6).alias("file_score"))


@query(
    "heading_section_order",
    f"""WITH {_TALKS}, hd AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(role), '[\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) <= 40) AS w FROM conversations),
ht AS (SELECT conv_id, turn, unnest(w) AS term FROM hd), hs AS (SELECT count(*) AS n, (SELECT count(*) FROM ht)::DOUBLE / count(*) AS mean FROM hd),
hdf AS (SELECT count(*) AS df FROM ht WHERE term = 'user'),
hh AS (SELECT conv_id, turn, ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(w) / mean)) AS h FROM hd CROSS JOIN hs CROSS JOIN hdf WHERE list_contains(w, 'user')),
b AS (SELECT conv_id, turn, max(CASE WHEN term = 'the' THEN score END) AS the, max(CASE WHEN term = 'user' THEN score END) AS usr FROM s WHERE term IN ('the', 'user') GROUP BY conv_id, turn),
x AS (SELECT coalesce(b.conv_id, hh.conv_id) AS conv_id, coalesce(b.turn, hh.turn) AS turn, coalesce(the, 0) AS the, coalesce(usr, 0) AS usr, coalesce(h, 0) AS h FROM b LEFT JOIN hh ON b.conv_id = hh.conv_id AND b.turn = hh.turn),
q AS (SELECT (SELECT ln(1 + (n - df + 0.5) / (df + 0.5)) FROM df, st WHERE term = 'the') AS r0, (SELECT ln(1 + (n - coalesce((SELECT df FROM df WHERE term = 'user'), 0) + 0.5) / (coalesce((SELECT df FROM df WHERE term = 'user'), 0) + 0.5)) FROM st) AS r1)
SELECT conv_id, turn, round((the + usr + (greatest(-the, 0)) + 0.25 * least(0, the) + greatest(2 * h - usr, 0) + 0.25 * least(2 * h, usr)) * pow((CASE WHEN the > 0 THEN r0 ELSE 0 END + CASE WHEN usr > 0 OR h > 0 THEN r1 ELSE 0 END) / (r0 + r1), 0.5), 6) AS section_score FROM x CROSS JOIN q""",
)
def heading_section_order(spark, sf_dir):
    index = _talks(spark, sf_dir)
    n = index.field_stats()["words"][0]
    df = index.frequencies({("words", "the"), ("words", "user")})
    body = {w: found(index, w).withColumnRenamed("score", w) for w in ("the", "user")}
    from corvane.plans.compile import Compiler, scored

    heading = scored(index, Compiler(index, "heading").compile(q.Term("user"))).withColumnRenamed("score", "h")
    rows = body["the"].join(body["user"], KEYS, "full_outer").join(heading, KEYS, "left").fillna(0.0, ["the", "user", "h"])
    rarity = {w: scoring.idf_value(n, df.get(("words", w), 0)) for w in ("the", "user")}
    slots = [
        {"body": F.col("the"), "heading": F.lit(0.0), "share": 1.0, "rarity": F.lit(rarity["the"]), "held": F.col("the") > 0},
        {"body": F.col("user"), "heading": F.col("h"), "share": 1.0, "rarity": F.lit(rarity["user"]), "held": (F.col("user") > 0) | (F.col("h") > 0)},
    ]
    score = ranking.section_score(F.col("the") + F.col("user"), slots, F.lit(sum(rarity.values())))
    return rows.select(F.col("parent_id").cast("long").alias("conv_id"), F.col("chunk_seq").alias("turn"), F.round(score, 6).alias("section_score"))


@query(
    "copies_fold",
    scored_sql(
        f""", p AS (SELECT doc_id, sum(score) AS score FROM s WHERE term = '{A}' GROUP BY doc_id), f AS (SELECT doc_id, score, sha256(text) AS h, sha1('documents/' || doc_id) AS pid FROM p JOIN documents USING (doc_id))
SELECT h AS file_key, arg_min(pid, (-score, pid)) AS parent_id, round(max(score), 6) AS score, count(*) - 1 AS n_copies FROM f GROUP BY h"""
    ),
)
def copies_fold(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    files = found(index, A).join(index.chunks.select(*KEYS, "content_hash"), KEYS).select("parent_id", "content_hash", "score")
    return ranking.folded_copies(files).select("file_key", "parent_id", F.round("score", 6).alias("score"), F.size("copies").cast("long").alias("n_copies"))


@query("recency_rerank", "SELECT event_id, round(CASE WHEN floor(epoch(ts))::BIGINT > 0 THEN (value / 100) * (1 + 0.5 * exp(-greatest(1705708800 - floor(epoch(ts))::BIGINT, 0) * ln(2) / 7776000)) ELSE value / 100 END, 6) AS rank_key FROM events")
def recency_rerank(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.unix_timestamp("ts").alias("mtime"), (F.col("value") / 100).alias("score"))
    return events.select("event_id", F.round(scoring.recency(F.col("score"), NOW, F.col("mtime"), 0.5, 90 * 86_400.0), 6).alias("rank_key"))


@query("kind_boost", "SELECT event_id, round(value * CASE event_type WHEN 'click' THEN 2.0 WHEN 'view' THEN 0.5 ELSE 1.0 END, 6) AS rank_key FROM events")
def kind_boost(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.round(scoring.kind_boost(F.col("value"), F.col("event_type"), {"click": 2.0, "view": 0.5}), 6).alias("rank_key"))


@query(
    "phrase_proximity_rerank",
    f"""WITH {TOKENS}, p AS (SELECT a.doc_id, min(abs(a.pos - b.pos)) + 1 AS span FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.term = 'with' AND b.term = 'that' GROUP BY a.doc_id)
SELECT doc_id, span, round(greatest(1 - ln(greatest(span - 1, 1)) / ln(100.0), 0), 6) AS factor FROM p""",
)
def phrase_proximity_rerank(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    rows = index.postings.filter((F.col("field") == "words") & F.col("term").isin("with", "that")).groupBy(*KEYS).agg(*[F.flatten(F.collect_list(F.when(F.col("term") == w, F.col("positions")))).alias(w) for w in ("with", "that")])
    rows = rows.filter((F.size("with") > 0) & (F.size("that") > 0)).withColumn("span", ranking.covering_window([F.col("with"), F.col("that")]))
    return with_ids(index, rows).select("doc_id", F.col("span").cast("long").alias("span"), F.round(scoring.closeness(F.col("span"), 2, 100), 6).alias("factor"))


@query(
    "typo_corrections",
    f"""WITH {TOKENS}, w AS (SELECT unnest(['thenigo', 'inrea', 'qzxv']) AS word), u AS (SELECT word FROM w WHERE word NOT IN (SELECT term FROM df)),
c AS (SELECT word, term, df FROM u JOIN df ON damerau_levenshtein(regexp_replace(term, '[^\\x00-\\x7F]', '~', 'g'), word) = 1 AND (len(term) < len(word) OR len(regexp_replace(term, '[a-z]', '', 'g')) = 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY df DESC, term) AS place, max(df) OVER (PARTITION BY word) AS best FROM c)
SELECT word, term, df, place FROM r WHERE place <= 3 AND df >= 0.05 * best""",
)
def typo_corrections(spark, sf_dir):
    rows = widening.corrections(documents_index(spark, sf_dir).dictionary("words"), ["thenigo", "inrea", "qzxv"])
    return rows.select("word", "term", "df", F.col("place").cast("long").alias("place"))


@query(
    "rare_spellings",
    f"""WITH {TOKENS}, w AS (SELECT term AS word, df AS own FROM df WHERE term IN ('anaion', 'anthon', 'arie', 'berer') AND df BETWEEN 1 AND 20),
c AS (SELECT word, own, term, df FROM w JOIN df ON damerau_levenshtein(regexp_replace(term, '[^\\x00-\\x7F]', '~', 'g'), word) = 1 AND (len(term) < len(word) OR len(regexp_replace(term, '[a-z]', '', 'g')) = 0) WHERE df >= 50 * own),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY df DESC, term) AS place FROM c)
SELECT word, own AS df, term, df AS term_df FROM r WHERE place = 1""",
)
def rare_spellings(spark, sf_dir):
    return widening.rare_spellings(documents_index(spark, sf_dir).dictionary("words"), ["anaion", "anthon", "arie", "berer"])


@query("synonym_search", scored_sql(f"SELECT doc_id, round(sum(score), 6) AS score FROM s WHERE term IN ('{A}', '{B}', '{C}') GROUP BY doc_id"))
def synonym_search(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    table_of = widening.Synonyms.of([[A, B], [B, C]])
    return answer(index, found(index, "", table_of.expand(A)))


@query("number_synonyms", scored_sql("SELECT doc_id, round(sum(score), 6) AS score FROM s WHERE term IN ('two', '2') GROUP BY doc_id"))
def number_synonyms(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return answer(index, found(index, "", widening.Synonyms.of(widening.number_groups()).expand("two")))


def _pair_sql(*pairs: tuple[str, str]) -> str:
    parts = [
        f"""SELECT a.doc_id, ((SELECT ln(1 + (n - df + 0.5) / (df + 0.5)) FROM df, st WHERE term = '{x}') + (SELECT ln(1 + (n - df + 0.5) / (df + 0.5)) FROM df, st WHERE term = '{y}')) AS idf,
len(list_filter(a.ps, lambda p: list_contains(b.ps, p + 1))) AS tf FROM tf a JOIN tf b ON a.doc_id = b.doc_id AND a.term = '{x}' AND b.term = '{y}'"""
        for x, y in pairs
    ]
    return f"WITH {TOKENS}, f AS ({' UNION ALL '.join(parts)}) SELECT doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM f JOIN dl USING (doc_id) CROSS JOIN st WHERE tf > 0 GROUP BY doc_id"


@query("compound_search", _pair_sql(("of", "the"), ("oft", "he")))
def compound_search(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return answer(index, found(index, "", widening.compound_tree("ofthe")))


@query("snippets")
def snippets(spark, sf_dir):
    """Snippets of the 50 best hits: shown rows only."""
    index = documents_index(spark, sf_dir)
    tree = q.parse(f"{A} {B}").tree
    shown = evidence.materialised(ranking.top(found(index, f"{A} {B}"), 50), index.chunks, "doc_id", "body")
    return evidence.with_snippets(shown.select("doc_id", "body"), tree).select("doc_id", "snippet")


@query("highlights")
def highlights(spark, sf_dir):
    """Runs of a phrase in the 50 best texts: its words and what stands between them."""
    index = documents_index(spark, sf_dir)
    tree = q.parse('"of the"').tree
    shown = evidence.materialised(ranking.top(found(index, '"of the"'), 50), index.chunks, "doc_id", "body")
    return highlight.with_runs(shown.select("doc_id", "body"), tree).select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.start", "r.end", "r.style", "r.slot")


@query("layered_search")
def layered_search(spark, sf_dir):
    from corvane.engine import Engine

    index = documents_index(spark, sf_dir)
    return Engine(index).search(f"{A} {B}", limit=50).join(index.chunks.select(*KEYS, "doc_id"), KEYS).select("doc_id", F.round("rank_key", 6).alias("rank_key"), "place")


_UNIT = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e)"


def _unit(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", scoring.unit(F.transform("embedding", lambda x: x.cast("double"))).alias("embedding"))


def _asked(rows):
    return rows.filter("vec_id = 0").first()["embedding"]


@query(
    "vector_top_k",
    f"WITH {_UNIT}, q AS (SELECT v AS w FROM u WHERE vec_id = 0), s AS (SELECT vec_id, list_sum(list_transform(list_zip(v, w), lambda z: z[1] * z[2])) AS x FROM u CROSS JOIN q) SELECT vec_id, round(x, 5) AS similarity FROM s ORDER BY x DESC, vec_id LIMIT 100",
)
def vector_top_k(spark, sf_dir):
    rows = _unit(spark, sf_dir)
    return vectors.nearest(rows, _asked(rows), 100).select("vec_id", F.round("similarity", 5).alias("similarity"))


@query(
    "vector_blend",
    f"""WITH {_UNIT}, q AS (SELECT v AS w FROM u WHERE vec_id = 0), s AS (SELECT vec_id, list_sum(list_transform(list_zip(v, w), lambda z: z[1] * z[2])) AS x FROM u CROSS JOIN q),
m AS (SELECT vec_id AS k, row_number() OVER (ORDER BY x DESC, vec_id) - 1 AS m FROM s ORDER BY x DESC, vec_id LIMIT 100),
l AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS i FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100),
b AS (SELECT coalesce(l.k, m.k) AS k, i, m, coalesce(l.k, m.k) IN (SELECT vec_id FROM embeddings) AS has FROM l FULL OUTER JOIN m ON l.k = m.k)
SELECT k AS file_key, round(coalesce(1.0 / (61 + i), 0) + coalesce(1.0 / (61 + CASE WHEN NOT has AND i IS NOT NULL THEN i ELSE m END), 0), 6) AS score FROM b""",
)
def vector_blend(spark, sf_dir):
    """Two rankings of numbered files: parts by price, and vectors by closeness."""
    rows = _unit(spark, sf_dir)
    near = vectors.nearest(rows, _asked(rows), 100).select(F.col("vec_id").alias("file_key"), (F.row_number().over(Window.orderBy(F.desc("similarity"), "vec_id")) - 1).alias("place"))
    parts = table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(100)
    lexical = parts.select(F.col("p_partkey").alias("file_key"), (F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")) - 1).alias("place"))
    return ranking.blend(lexical, near, rows.select(F.col("vec_id").alias("file_key"))).select("file_key", F.round("score", 6).alias("score"))


@query("missing_vectors", "WITH t AS (SELECT DISTINCT sha1(array_to_string(string_split_regex(lower(trim(text)), '\\s+')[1:256], ' ')) AS text_key, doc_id, n_chars FROM documents) SELECT DISTINCT text_key FROM t WHERE text_key NOT IN (SELECT text_key FROM t WHERE n_chars >= 1000)")
def missing_vectors(spark, sf_dir):
    sections = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text", vectors.text_key(F.col("text")).alias("text_key"))
    return vectors.missing(sections, sections.filter("n_chars >= 1000")).select("text_key")


@query("embedded_sections")
def embedded_sections(spark, sf_dir):
    sections = table(spark, sf_dir, "documents").select("text", vectors.text_key(F.col("text")).alias("text_key"))
    rows = vectors.embedded(sections.groupBy("text_key").agg(F.min("text").alias("text")), vectors.hashing_embedder(16))
    return rows.select("text_key", F.round(scoring.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm"))


__all__ = ["SCORED", "chunking", "document_chunks", "TOKENS"]
