"""Queries of matching: words, boolean algebra, phrases, patterns, fields and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.tags import TagFilter
from corvane.operators import ranking
from corvane.operators.index import FieldPredicates, scope
from corvane.plans import language as q
from corvane.plans import predicates
from corvane.suite.common import KEYS, NOW, SCORED, TOKENS, answer, document_chunks, documents_index, found, index_of, query, scored_sql, table, with_ids, words_sql
from corvane.sources.chunking import table_chunks
from corvane.sources.kinds import NOTE_KINDS

A, B, C = "tion", "anea", "bleor"
Z = "coalesce"


@query("bm25_or", words_sql("SELECT doc_id, round(coalesce(s0,0) + coalesce(s1,0) + coalesce(s2,0), 6) AS score FROM p", A, B, C))
def bm25_or(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return answer(index, found(index, f"{A} {B} {C}"))


@query("bm25_and", words_sql("SELECT doc_id, round(s0 + s1, 6) AS score FROM p WHERE s0 > 0 AND s1 > 0", A, B))
def bm25_and(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return answer(index, found(index, f"{A} AND {B}"))


@query("bm25_not", words_sql("SELECT doc_id, round(s0, 6) AS score FROM p WHERE s0 > 0 AND s1 IS NULL", A, B))
def bm25_not(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return answer(index, found(index, f"{A} -{B}"))


@query("bm25_required", words_sql("SELECT doc_id, round(s0 + coalesce(s1, 0), 6) AS score FROM p WHERE s0 > 0", B, A))
def bm25_required(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return answer(index, found(index, f"+{B} {A}"))


@query("bm25_only_not", f"WITH {TOKENS} SELECT doc_id, 0.0::DOUBLE AS score FROM d WHERE doc_id NOT IN (SELECT doc_id FROM tf WHERE term = 'the')")
def bm25_only_not(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return answer(index, found(index, "-the"))


@query("bm25_dismax", words_sql("SELECT doc_id, round(greatest(coalesce(s0, 0), coalesce(s1, 0)), 6) AS score FROM p", A, B))
def bm25_dismax(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return answer(index, found(index, f"{A} OR {B}"))


@query("bm25_nested", words_sql("SELECT doc_id, round(CASE WHEN s0 > 0 AND s1 > 0 THEN s0 + s1 ELSE 0 END + coalesce(s2, 0), 6) AS score FROM p WHERE (s0 > 0 AND s1 > 0) OR s2 > 0", A, B, C))
def bm25_nested(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return answer(index, found(index, f"({A} AND {B}) {C}"))


@query("boosted_terms", words_sql("SELECT doc_id, round(2.5 * coalesce(s0, 0) + coalesce(s1, 0), 6) AS score FROM p", A, B))
def boosted_terms(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return answer(index, found(index, f"{A}^2.5 {B}"))


@query(
    "bm25_top_k",
    words_sql("SELECT doc_id, round(coalesce(s0,0) + coalesce(s1,0), 6) AS score FROM p ORDER BY coalesce(s0,0) + coalesce(s1,0) DESC, sha1('documents/' || doc_id) LIMIT 50", A, B),
)
def bm25_top_k(spark, sf_dir):
    """The 50 best: a top-k report."""
    index = documents_index(spark, sf_dir)
    return answer(index, ranking.top(found(index, f"{A} {B}"), 50))


def _phrase_sql(tf: str, *words: str) -> str:
    joins = " ".join(f"JOIN tf t{k} ON t{k}.doc_id = t0.doc_id AND t{k}.term = '{w}'" for k, w in enumerate(words) if k)
    idf = " + ".join(f"(SELECT ln(1 + (n - df + 0.5) / (df + 0.5)) FROM df, st WHERE term = '{w}')" for w in words)
    return f"""WITH {TOKENS}, f AS (SELECT t0.doc_id, {tf} AS tf FROM tf t0 {joins} WHERE t0.term = '{words[0]}')
SELECT doc_id, round(({idf}) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS score FROM f JOIN dl USING (doc_id) CROSS JOIN st WHERE tf > 0"""


@query("phrase_match", _phrase_sql("len(list_filter(t0.ps, lambda x: list_contains(t1.ps, x + 1)))", "of", "the"))
def phrase_match(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return answer(index, found(index, '"of the"'))


@query("phrase_of_three", _phrase_sql("len(list_filter(t0.ps, lambda x: list_contains(t1.ps, x + 1) AND list_contains(t2.ps, x + 2)))", "to", "the", "in"))
def phrase_of_three(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return answer(index, found(index, '"to the in"'))


_NEAR = "len(list_filter(list_distinct(list_concat(t0.ps, t1.ps)), lambda a: len(list_filter(t0.ps, lambda x: x >= a AND x <= a + 5)) > 0 AND len(list_filter(t1.ps, lambda x: x >= a AND x <= a + 5)) > 0))"


@query("proximity_window", _phrase_sql(_NEAR, "with", "that"))
def proximity_window(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return answer(index, found(index, '"with that"~4'))


@query("near_operator", _phrase_sql(_NEAR, "with", "that"))
def near_operator(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return answer(index, found(index, "with NEAR/4 that"))


def _variants_sql(condition: str, blended: bool) -> str:
    if not blended:
        return scored_sql(f"SELECT doc_id, round(sum(score), 6) AS score FROM s WHERE {condition} GROUP BY doc_id")
    return f"""WITH {TOKENS}, v AS (SELECT term FROM df WHERE {condition}), m AS (SELECT max(df) AS mdf FROM df WHERE {condition})
SELECT doc_id, round(sum(ln(1 + (n - mdf + 0.5) / (mdf + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
FROM tf JOIN v USING (term) JOIN dl USING (doc_id) CROSS JOIN st CROSS JOIN m GROUP BY doc_id"""


@query("prefix_wildcard", _variants_sql("starts_with(term, 'bleor')", False))
def prefix_wildcard(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return answer(index, found(index, "bleor*"))


@query("glob_infix", _variants_sql("term LIKE '%einhe%'", True))
def glob_infix(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return answer(index, found(index, "*einhe*"))


@query("glob_one_letter", _variants_sql("term LIKE 'th_t'", True))
def glob_one_letter(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return answer(index, found(index, "th?t"))


@query("regex_terms", _variants_sql("regexp_matches(term, '^(?:th(?:ing|er)[aeiou]+)$')", True))
def regex_terms(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return answer(index, found(index, "/th(?:ing|er)[aeiou]+/"))


_ONE_EDIT = "damerau_levenshtein(regexp_replace(term, '[^\\x00-\\x7F]', '~', 'g'), 'thing') <= 1 AND (term[1] = 't' OR regexp_matches(term[1], '[a-z]'))"


@query("fuzzy_one_edit", _variants_sql(_ONE_EDIT, False))
def fuzzy_one_edit(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return answer(index, found(index, "thing~1"))


@query(
    "term_stats",
    f"WITH {TOKENS} SELECT term, df, ctf FROM df",
)
def term_stats(spark, sf_dir):
    return documents_index(spark, sf_dir).dictionary("words").select("term", "df", "ctf")


@query("doc_length_stats", f"WITH {TOKENS} SELECT count(*) AS chunks, sum(dl)::BIGINT AS total, round(avg(dl), 6) AS mean, max(dl)::BIGINT AS longest FROM dl")
def doc_length_stats(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    lengths = index.postings.filter("field = 'words'").groupBy(*KEYS).agg(F.max("dl").alias("dl"))
    rows = index.chunks.select(*KEYS).join(lengths, KEYS, "left").select(F.coalesce("dl", F.lit(0)).cast("long").alias("dl"))
    return rows.agg(F.count("*").alias("chunks"), F.sum("dl").alias("total"), F.round(F.avg("dl"), 6).alias("mean"), F.max("dl").alias("longest"))


@query("idf_table", f"WITH {TOKENS} SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df CROSS JOIN st")
def idf_table(spark, sf_dir):
    from corvane.functions.scoring import idf

    index = documents_index(spark, sf_dir)
    n = index.field_stats()["words"][0]
    return index.dictionary("words").select("term", F.round(idf(F.lit(n), F.col("df")), 6).alias("idf"))


@query(
    "field_boost_title",
    """WITH p AS (SELECT page_id, html, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages),
x AS (SELECT page_id, list_filter(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+'), lambda x: strlen(x) <= 40) AS t, list_filter(regexp_extract_all(lower(html), '[\\p{L}\\p{N}]+'), lambda x: strlen(x) <= 40) AS b FROM p),
f AS (SELECT 'b' AS f, page_id, len(b) AS dl, len(list_filter(b, lambda y: y = 'thing')) AS tf FROM x UNION ALL SELECT 't', page_id, len(t), len(list_filter(t, lambda y: y = 'thing')) FROM x),
g AS (SELECT f, count(*) AS n, avg(dl) AS mean, count(*) FILTER (tf > 0) AS df FROM f GROUP BY f),
s AS (SELECT f, page_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS score FROM f JOIN g USING (f) WHERE tf > 0)
SELECT b.page_id, round(b.score + 0.25 * coalesce(t.score, 0), 6) AS score FROM (SELECT * FROM s WHERE f = 'b') b LEFT JOIN (SELECT * FROM s WHERE f = 't') t USING (page_id)""",
)
def field_boost_title(spark, sf_dir):
    from corvane.engine import Engine

    title = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1), r"\s+", " "))
    index = index_of(spark, sf_dir, "pages", lambda: table_chunks(table(spark, sf_dir, "pages"), "pages", "page_id", "html", title=title, kind=F.lit("html"), page_id=F.col("page_id")), fields={"words": "body", "title": "title"})
    hits = Engine(index).hits("thing")
    return hits.join(index.chunks.select(*KEYS, "page_id"), KEYS).select("page_id", F.round("score", 6).alias("score"))


@query("scope_union", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2')")
def scope_union(spark, sf_dir):
    return scope(document_chunks(spark, sf_dir), [("documents", "src1"), ("documents", "src2"), ("other", None)]).select("doc_id")


@query("membership_semi", words_sql("SELECT p.doc_id, round(s0, 6) AS score FROM p JOIN documents USING (doc_id) WHERE source = 'src3' AND s0 > 0", A))
def membership_semi(spark, sf_dir):
    from corvane.engine import Engine

    index = documents_index(spark, sf_dir)
    return answer(index, Engine(index).hits(A, arms=[("documents", "src3")]))


@query("filter_only", "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE n_chars >= 3000 AND n_chars < 5000")
def filter_only(spark, sf_dir):
    from corvane.engine import Engine

    index = documents_index(spark, sf_dir)
    return answer(index, Engine(index).hits("n_chars>=3000 n_chars:<5000"))


@query("filtered_search", words_sql("SELECT p.doc_id, round(s0, 6) AS score FROM p JOIN documents USING (doc_id) WHERE n_chars BETWEEN 1000 AND 4000 AND source <> 'src1' AND s0 > 0", A))
def filtered_search(spark, sf_dir):
    from corvane.engine import Engine

    index = documents_index(spark, sf_dir)
    return answer(index, Engine(index).hits(f"{A} n_chars:[1000 TO 4000] -source:src1"))


@query(
    "range_filters",
    "SELECT o_orderkey AS order_id FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1996-03-01' AND CAST(o_totalprice AS BIGINT) > 20000",
)
def range_filters(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.unix_timestamp("o_orderdate").alias("mtime"), F.round("o_totalprice").cast("long").alias("size"))
    rules = FieldPredicates(orders)
    parsed = q.parse("mtime:[1995-01 TO 1996-03} size:>20000")
    rows = orders
    for clause in parsed.filters:
        rows = rows.filter(rules.predicate(clause))
    return rows.select("order_id")


@query("date_token_filter", "SELECT event_id FROM events WHERE floor(epoch(ts))::BIGINT BETWEEN 1705708800 - 7 * 86400 AND 1705708800")
def date_token_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.unix_timestamp("ts").alias("mtime"))
    rules = FieldPredicates(events, NOW)
    return events.filter(rules.predicate(q.parse("mtime:week").filters[0])).select("event_id")


@query("text_field_filter", "SELECT p_partkey FROM part WHERE contains(' ' || array_to_string(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+'), ' ') || ' ', ' widget ')")
def text_field_filter(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"))
    return part.filter(FieldPredicates(part).predicate(q.FieldClause("title", "Widget"))).select("p_partkey")


_LABELLED = "SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic, ['lang/' || d.lang, d.source] AS tags FROM documents d LEFT JOIN labels l USING (doc_id)"


def _labelled(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.array(F.concat(F.lit("lang/"), "lang"), "source").alias("tags"))
    return rows.join(labels, "doc_id", "left")


def _kept(spark, sf_dir, text: str):
    rows = _labelled(spark, sf_dir)
    return rows.filter(predicates.column(predicates.parse(text), rows.schema)).select("doc_id")


@query("strict_null_filter", f"WITH x AS ({_LABELLED}) SELECT doc_id FROM x WHERE coalesce(quality != 1, false) OR (NOT coalesce(toxic = 0, false) AND n_chars > 2000)")
def strict_null_filter(spark, sf_dir):
    return _kept(spark, sf_dir, "quality != 1 OR (NOT toxic == 0 AND n_chars > 2_000)")


@query("list_membership_filter", f"WITH x AS ({_LABELLED}) SELECT doc_id FROM x WHERE list_contains(tags, 'lang/de') OR (list_contains(tags, 'src4') AND coalesce(quality IN (0, 1), false))")
def list_membership_filter(spark, sf_dir):
    return _kept(spark, sf_dir, '"lang/de" in tags OR ("src4" in tags AND quality in [0, 1])')


@query("glob_filter", f"WITH x AS ({_LABELLED}) SELECT doc_id FROM x WHERE len(list_filter(tags, lambda t: t LIKE 'src1%')) > 0 AND lang != 'en'")
def glob_filter(spark, sf_dir):
    return _kept(spark, sf_dir, 'tags ~~ "src1*" AND lang != "en"')


@query("note_metadata_search", words_sql("SELECT p.doc_id, round(s0, 6) AS score FROM p JOIN documents USING (doc_id) WHERE lang = 'en' AND s0 > 0", A))
def note_metadata_search(spark, sf_dir):
    from corvane.engine import Engine

    index = documents_index(spark, sf_dir)
    assert "txt" in NOTE_KINDS
    return answer(index, Engine(index).hits(f'{A} [lang == "en"]'))


@query("tag_filter", f"WITH x AS ({_LABELLED}) SELECT doc_id FROM x WHERE (list_contains(tags, 'lang/fr') OR list_contains(tags, 'lang/es')) AND NOT list_contains(tags, 'src2')")
def tag_filter(spark, sf_dir):
    chosen = TagFilter(("lang/fr", "lang/es"), ("src2",))
    return _labelled(spark, sf_dir).filter(chosen.column(F.col("tags"))).select("doc_id")


@query(
    "word_evidence",
    scored_sql("SELECT doc_id, term, round(score, 6) AS body_score, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS rarity FROM s CROSS JOIN st WHERE term IN ('tion', 'anea')"),
)
def word_evidence(spark, sf_dir):
    """Per chunk and query word: its rarity and its share of the body's score."""
    from corvane.functions import scoring

    index = documents_index(spark, sf_dir)
    n, mean = index.field_stats()["words"]
    rows = index.postings.filter((F.col("field") == "words") & F.col("term").isin(A, B)).join(F.broadcast(index.dictionary("words").filter(F.col("term").isin(A, B)).select("term", "df")), "term")
    score = scoring.bm25(F.col("tf"), F.col("df"), F.col("dl"), F.lit(n), F.lit(mean))
    return with_ids(index, rows.select(*KEYS, "term", F.round(score, 6).alias("body_score"), F.round(scoring.idf(F.lit(n), F.col("df")), 6).alias("rarity"))).select("doc_id", "term", "body_score", "rarity")


@query("stemmed_search")
def stemmed_search(spark, sf_dir):
    """Words by their stems, half of the score from the exact form."""
    from corvane.engine import Engine

    index = documents_index(spark, sf_dir, stems=True)
    return answer(index, Engine(index).hits("things bleeding"))


__all__ = ["SCORED"]
