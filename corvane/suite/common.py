"""What the registered queries share: an index per data folder, and SQL for the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.index import SearchIndex, write_index
from corvane.plans import language as q
from corvane.plans.compile import Compiler, scored
from corvane.scratch import scratch
from corvane.sources.chunking import table_chunks

KEYS = ["parent_id", "chunk_seq"]
NOW = 1_705_708_800  # 2024-01-20, so that a query has one answer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_built: dict[tuple[str, str, str], SearchIndex] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return table_chunks(docs, "documents", "doc_id", "text", doc_id=F.col("doc_id"), source=F.col("source"), lang=F.col("lang"), n_chars=F.col("n_chars"))


def index_of(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], stems: bool = False, fields: dict | None = None) -> SearchIndex:
    """One index per session, data folder and corpus, built when first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir, f"{name}-{stems}")
    if key not in _built:
        _built[key] = write_index(make(), scratch(spark, f"index-{name}"), fields, stems)
    return _built[key]


def documents_index(spark: SparkSession, sf_dir: str, stems: bool = False) -> SearchIndex:
    return index_of(spark, sf_dir, "documents", lambda: document_chunks(spark, sf_dir), stems, {"words": "body"})


def found(index: SearchIndex, text: str, tree=None) -> DataFrame:
    """Hits of a query's tree alone: (parent_id, chunk_seq, score)."""
    return scored(index, Compiler(index).compile(q.parse(text).tree if tree is None else tree))


def with_ids(index: SearchIndex, hits: DataFrame, *columns: str) -> DataFrame:
    return hits.join(index.chunks.select(*KEYS, "doc_id", *columns), KEYS)


def answer(index: SearchIndex, hits: DataFrame) -> DataFrame:
    return with_ids(index, hits).select("doc_id", F.round("score", 6).alias("score"))


TOKENS = """
d AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'), lambda x: strlen(x) <= 40) AS w FROM documents),
tok AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d),
dl AS (SELECT doc_id, len(w) AS dl FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf, list(pos ORDER BY pos) AS ps FROM tok GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS ctf FROM tf GROUP BY term),
st AS (SELECT count(*) AS n, (SELECT count(*) FROM tok)::DOUBLE / count(*) AS mean FROM d)
"""
SCORED = (
    TOKENS
    + """,
s AS (SELECT tf.doc_id, tf.term, tf.tf, dl, df, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS score
      FROM tf JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st)
"""
)


def scored_sql(body: str) -> str:
    return f"WITH {SCORED} {body}"


def words_sql(body: str, *words: str) -> str:
    """SQL over p: one row per document with columns s0, s1 ... of the words' scores, null where a word is missing."""
    columns = ", ".join(f"max(CASE WHEN term = '{w}' THEN score END) AS s{k}" for k, w in enumerate(words))
    listed = ", ".join(f"'{w}'" for w in words)
    return scored_sql(f", p AS (SELECT doc_id, {columns} FROM s WHERE term IN ({listed}) GROUP BY doc_id) {body}")
