"""Queries of chunking, facets and upkeep."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import recovery, tags, text
from corvane.operators import facets, maintenance
from corvane.sources import chunking, markup
from corvane.suite.common import document_chunks, query, table

_WINDOWS = """
x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
y AS (SELECT doc_id, t, unnest(range(0, greatest(ceil((length(t) - 1000) / 800.0)::BIGINT, 0) + 1)) * 800 AS o FROM x WHERE length(t) > 0),
z AS (SELECT doc_id, o, substring(t, o + 1, 1000) AS body, 1 + length(substring(t, 1, o)) - length(replace(substring(t, 1, o), chr(10), '')) AS line FROM y),
w AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS chunk_seq, line, body FROM z WHERE trim(regexp_replace(body, '\\s', ' ', 'g')) <> '')
"""


def _files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("parent_id"), "text")


@query("plain_windows", f"WITH {_WINDOWS} SELECT doc_id, chunk_seq, line, md5(body) AS body_md5 FROM w")
def plain_windows(spark, sf_dir):
    return chunking.plain_windows(_files(spark, sf_dir)).select(F.col("parent_id").alias("doc_id"), F.col("chunk_seq").cast("long").alias("chunk_seq"), F.col("line").cast("long").alias("line"), F.md5("body").alias("body_md5"))


@query(
    "line_windows",
    """WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
y AS (SELECT doc_id, l, unnest(range(0, greatest(ceil((len(l) - 8) / 6.0)::BIGINT, 0) + 1)) * 6 AS o FROM x),
z AS (SELECT doc_id, o, array_to_string(l[o + 1 : o + 8], chr(10)) AS body FROM y)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS chunk_seq, o + 1 AS line, md5(body) AS body_md5 FROM z WHERE trim(regexp_replace(body, '\\s', ' ', 'g')) <> ''""",
)
def line_windows(spark, sf_dir):
    rows = chunking.line_windows(_files(spark, sf_dir), 8, 2, most=0)
    return rows.select(F.col("parent_id").alias("doc_id"), F.col("chunk_seq").cast("long").alias("chunk_seq"), F.col("line").cast("long").alias("line"), F.md5("body").alias("body_md5"))


@query("bounded_chunks")
def bounded_chunks(spark, sf_dir):
    """Whole documents as chunks, none over 8,000 characters."""
    whole = _files(spark, sf_dir).select("parent_id", F.lit(0).alias("chunk_seq"), F.col("text").alias("body"))
    return chunking.bounded(whole).select(F.col("parent_id").alias("doc_id"), "chunk_seq", F.length("body").alias("n_chars"))


@query(
    "csv_groups",
    """WITH x AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k, p_partkey || ',' || p_size AS row FROM part),
n AS (SELECT p_brand, count(*) AS n FROM x GROUP BY p_brand)
SELECT p_brand AS file, (k // 50) AS chunk_seq, (k // 50) * 50 + 2 AS line, md5('key,size' || chr(10) || string_agg(row, chr(10) ORDER BY k)) AS body_md5 FROM x JOIN n USING (p_brand) GROUP BY p_brand, k // 50""",
)
def csv_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_size"))).alias("r"))
    files = rows.select(F.col("p_brand").alias("parent_id"), F.concat(F.lit("key,size\n"), F.array_join(F.transform("r", lambda x: F.concat_ws(",", x["p_partkey"].cast("string"), x["p_size"].cast("string"))), "\n")).alias("text"))
    return chunking.csv_groups(files).select(F.col("parent_id").alias("file"), F.col("chunk_seq").cast("long").alias("chunk_seq"), F.col("line").cast("long").alias("line"), F.md5("body").alias("body_md5"))


@query(
    "chunk_overlap_marks",
    f"""WITH {_WINDOWS}, p AS (SELECT doc_id, chunk_seq, body, lag(body) OVER (PARTITION BY doc_id ORDER BY chunk_seq) AS before FROM w),
c AS (SELECT doc_id, chunk_seq, body, before, unnest(range(20, least(length(body), length(before), 2000) + 1)) AS n FROM p WHERE before IS NOT NULL),
m AS (SELECT doc_id, chunk_seq, max(n) AS n FROM c WHERE right(before, n) = left(body, n) GROUP BY doc_id, chunk_seq)
SELECT p.doc_id, p.chunk_seq, coalesce(m.n, 0) AS repeated FROM p LEFT JOIN m USING (doc_id, chunk_seq)""",
)
def chunk_overlap_marks(spark, sf_dir):
    rows = chunking.repeats(chunking.plain_windows(_files(spark, sf_dir)))
    return rows.select(F.col("parent_id").alias("doc_id"), F.col("chunk_seq").cast("long").alias("chunk_seq"), F.col("repeated").cast("long").alias("repeated"))


@query("html_sections")
def html_sections(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("parent_id"), F.col("html").alias("text"))
    return markup.sections(pages, "html").select(F.col("parent_id").cast("long").alias("page_id"), "chunk_seq", "title", "heading_path", F.md5("body").alias("body_md5"))


@query("markdown_sections")
def markdown_sections(spark, sf_dir):
    """Conversations written as Markdown, a heading a turn."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    files = rows.select(F.col("conv_id").cast("string").alias("parent_id"), F.array_join(F.transform("t", lambda x: F.concat(F.lit("## "), x["role"], F.lit("\n\n"), x["text"])), "\n\n").alias("text"))
    return markup.sections(files, "md").select(F.col("parent_id").cast("long").alias("conv_id"), "chunk_seq", "heading_path", F.md5("body").alias("body_md5"))


@query("conversation_chunks", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_seq, role AS heading_path, md5(text) AS body_md5 FROM conversations")
def conversation_chunks(spark, sf_dir):
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return table(spark, sf_dir, "conversations").select("conv_id", order.cast("long").alias("chunk_seq"), F.col("role").alias("heading_path"), F.md5("text").alias("body_md5"))


@query("notebook_cells")
def notebook_cells(spark, sf_dir):
    """Conversations written as notebooks: a heading cell and a cell of text a turn."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    cell = lambda x: F.array(F.struct(F.lit("markdown").alias("cell_type"), F.concat(F.lit("# "), x["role"]).alias("source")), F.struct(F.lit("code").alias("cell_type"), x["text"].alias("source")))
    files = rows.select(F.col("conv_id").cast("string").alias("parent_id"), F.to_json(F.struct(F.flatten(F.transform("t", cell)).alias("cells"))).alias("text"))
    return chunking.notebook_cells(files).select(F.col("parent_id").cast("long").alias("conv_id"), "chunk_seq", "heading_path", F.md5("body").alias("body_md5"))


@query("canonical_text", "SELECT doc_id, md5(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS text_md5 FROM documents")
def canonical_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.canonical(F.col("text"))).alias("text_md5"))


@query(
    "legibility_score",
    """WITH x AS (SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS n, length(regexp_replace(text, '[^\\p{L}\\p{N}.,;:!?''()\\-]', '', 'g')) AS good FROM documents)
SELECT doc_id, round(CASE WHEN n > 0 THEN good::DOUBLE / n ELSE 1.0 END, 6) AS share FROM x""",
)
def legibility_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(recovery.letter_share(F.col("text")), 6).alias("share"))


@query(
    "coverage_score",
    """WITH x AS (SELECT page_id, list_distinct(list_filter(regexp_extract_all(lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '[\\p{L}\\p{N}]+'), lambda t: strlen(t) <= 40)) AS a,
list_filter(regexp_extract_all(lower(regexp_extract(html, '(?s)<article>(.*?)</article>', 1)), '[\\p{L}\\p{N}]+'), lambda t: strlen(t) <= 40) AS b FROM pages)
SELECT page_id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(a) ELSE 1.0 END, 6) AS coverage FROM x""",
)
def coverage_score(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    title, body = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1), F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1)
    return pages.select("page_id", F.round(recovery.coverage(title, body), 6).alias("coverage"))


def _tagged(spark, sf_dir):
    raw = F.array(F.concat(F.lit("#Lang/"), F.upper("lang")), F.concat(F.lit("len/"), F.when(F.col("n_chars") < 1000, "short").otherwise("long"), F.lit("/"), (F.col("n_chars") % 3).cast("string")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("parent_id"), tags.expanded(raw).alias("tags"))


_TAGGED = """t AS (SELECT doc_id, unnest(['lang', 'lang/' || lang, 'len', 'len/' || CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END, 'len/' || CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END || '/' || (n_chars % 3)]) AS tag FROM documents)"""


@query("tag_catalogue", f"WITH {_TAGGED} SELECT tag, count(DISTINCT doc_id) AS files FROM t GROUP BY tag ORDER BY files DESC, tag LIMIT 500")
def tag_catalogue(spark, sf_dir):
    return facets.tag_catalogue(_tagged(spark, sf_dir))


@query(
    "tag_tree",
    f"WITH {_TAGGED} SELECT tag, CASE WHEN contains(tag, '/') THEN regexp_replace(tag, '/[^/]*$', '') END AS parent, len(string_split(tag, '/')) AS depth, count(DISTINCT doc_id) AS files FROM t GROUP BY tag",
)
def tag_tree(spark, sf_dir):
    rows = facets.tag_tree(facets.tag_catalogue(_tagged(spark, sf_dir)))
    return rows.select("tag", "parent", F.col("depth").cast("long").alias("depth"), "files")


@query("present_kinds", "SELECT DISTINCT 'txt' AS kind FROM documents UNION SELECT DISTINCT 'html' FROM pages")
def present_kinds(spark, sf_dir):
    pages = chunking.table_chunks(table(spark, sf_dir, "pages"), "pages", "page_id", "html", kind=F.lit("html"))
    return facets.present_kinds(document_chunks(spark, sf_dir).select("kind").unionByName(pages.select("kind")))


#: An index of all but German documents, beside live files that are the longer ones.
def _halves(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("parent_id"), F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("mtime"), (F.col("n_chars") % 4).alias("ctime"), "source", "lang", "n_chars")
    indexed, live = docs.filter("lang != 'de'"), docs.filter("n_chars >= 1000")
    return indexed.drop("lang", "n_chars"), live.drop("lang", "n_chars")


@query("prune_diff", "SELECT doc_id AS parent_id FROM documents WHERE lang <> 'de' AND n_chars < 1000 AND source <> 'src5'")
def prune_diff(spark, sf_dir):
    indexed, live = _halves(spark, sf_dir)
    return maintenance.stale(indexed, live, ["/src5"]).select("parent_id")


@query("unchanged_skip", "SELECT doc_id AS parent_id FROM documents WHERE n_chars >= 1000 AND (lang = 'de' OR n_chars % 5 = 0)")
def unchanged_skip(spark, sf_dir):
    indexed, live = _halves(spark, sf_dir)
    moved = live.withColumn("mtime", F.when(F.col("mtime") % 5 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))
    return maintenance.to_read(moved, indexed).select("parent_id")


@query(
    "membership_upsert",
    """SELECT doc_id AS parent_id, 'a' AS collection, source FROM documents WHERE lang <> 'de' AND n_chars < 1000
UNION ALL SELECT doc_id, 'a', 'new' FROM documents WHERE n_chars >= 1000 UNION ALL SELECT doc_id, 'b', source FROM documents WHERE lang <> 'de'""",
)
def membership_upsert(spark, sf_dir):
    indexed, live = _halves(spark, sf_dir)
    before = indexed.select("parent_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("collection"), "source")
    return maintenance.after_index(before, "a", live.select("parent_id", F.lit("new").alias("source")))


@query("upserted_chunks", "SELECT doc_id AS parent_id, 'old' AS version FROM documents WHERE lang <> 'de' AND n_chars < 1000 UNION ALL SELECT doc_id, 'new' FROM documents WHERE n_chars >= 1000")
def upserted_chunks(spark, sf_dir):
    indexed, live = _halves(spark, sf_dir)
    return maintenance.upserted(indexed.select("parent_id", F.lit("old").alias("version")), live.select("parent_id", F.lit("new").alias("version")))


@query("extraction_misses", "SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'de')")
def extraction_misses(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return maintenance.extraction_misses(files, files.filter("lang = 'de'")).select("content_hash")


@query("claimed_files", "SELECT source, min(doc_id) AS first_doc, count(*) AS files FROM documents GROUP BY source")
def claimed_files(spark, sf_dir):
    """Documents reached through two overlapping sources: the first claims each."""
    from corvane.sources.listing import claimed

    docs = table(spark, sf_dir, "documents").select(F.lit("c").alias("collection"), F.col("doc_id").cast("string").alias("path"), "doc_id", "source")
    twice = docs.withColumn("source_ord", F.lit(0)).unionByName(docs.withColumn("source_ord", F.lit(1)).withColumn("source", F.lit("later")))
    return claimed(twice).groupBy("source").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("files"))


