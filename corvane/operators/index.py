"""An inverted index as Parquet tables in immutable generations.

``chunks`` has one row per chunk; ``postings`` (field, term, chunk, tf, positions, dl) is written in runs sorted by
field and term, so a query's few terms prune most pages (after an update, in ranges of them); ``terms`` has document
frequencies. A generation is complete when its manifest is written; readers resolve the
newest manifest once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.errors import QuerySyntaxError, SchemaVersionError
from corvane.functions.dates import iso_seconds, token_range
from corvane.functions.stem import stem
from corvane.functions.text import fold_accents_text, words, words_of
from corvane.plans import language as q
from corvane.sources.kinds import CATEGORIES

VERSION = 2
EXACT = {"kind", "collection", "parent_id", "source"}
TEXT = {"title", "author", "heading_path", "path"}
NUMBERS = {"page", "slide", "line", "chunk_seq", "mtime", "created", "size", "n_chars"}
FROM_ONE = {"page", "slide"}
TIMES = {"mtime", "created"}
DEFAULT_FIELDS = {"words": "body", "title": "title", "path": "path", "heading": "heading_path"}


POSTINGS = "field string, term string, parent_id string, chunk_seq {seq}, tf int, positions array<int>, dl int"
#: Words that are sorted together, and rows that leave a worker at once. Small pages let a query's terms skip most of a run.
RUN_WORDS, OUT_ROWS = 2_000_000, 50_000
STORED = {"compression": "zstd", "parquet.page.row.count.limit": "5000"}


def postings_of(chunks: DataFrame, fields: dict[str, str], stems: bool) -> DataFrame:
    """Postings of all fields, in runs sorted by field and term. With ``stems`` a field ``body`` of stems stands beside ``words``.

    A chunk's words are grouped, stemmed and sorted where the chunk is, a bounded number at once: nothing is shuffled for it, and no
    task holds all postings of a word."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = chunks.select("parent_id", "chunk_seq", *(words(F.col(c)).alias(f"w_{f}") for f, c in fields.items()))
    seq = chunks.schema["chunk_seq"].dataType.simpleString()

    def postings(field, terms, codes, dl, ids, seqs):
        """Both spellings of a stem in one chunk are one posting; its places stay in order."""
        n = max(1, len(dl))
        by_term = np.asarray(pc.sort_indices(terms)).astype(np.int64)
        rank = np.empty(len(by_term), np.int64)
        rank[by_term] = np.arange(len(by_term))
        key = rank[codes] * n + np.repeat(np.arange(len(dl)), dl)
        order = np.argsort(key, kind="stable")
        key = key[order]
        places = (np.arange(len(key)) - np.repeat(np.cumsum(dl) - dl, dl)).astype(np.int32)[order]
        ends = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64), len(key))
        for lo in range(0, len(ends) - 1, OUT_ROWS):
            at = ends[lo : lo + OUT_ROWS + 1]
            term, owner = np.divmod(key[at[:-1]], n)
            who = pa.array(owner)
            held = pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(places[at[0] : at[-1]]))
            columns = [pa.array([field] * len(who), pa.string()), terms.take(pa.array(by_term[term])), ids.take(who), seqs.take(who), pa.array(np.diff(at).astype(np.int32)), held, pa.array(dl[owner].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["field", "term", "parent_id", "chunk_seq", "tf", "positions", "dl"])

    def sorted_run(some):
        table = pa.Table.from_batches(some)
        ids, seqs = (pa.concat_arrays(table.column(c).chunks) for c in ("parent_id", "chunk_seq"))
        for f in fields:
            held = pa.concat_arrays(table.column(f"w_{f}").chunks)
            flat = held.flatten().dictionary_encode()
            codes, dl = np.asarray(flat.indices).astype(np.int64), np.diff(np.asarray(held.offsets).astype(np.int64))
            yield from postings(f, flat.dictionary, codes, dl, ids, seqs)
            if stems and f == "words":
                spelt = pa.array([stem(t if t.isascii() else fold_accents_text(t)) for t in flat.dictionary.to_pylist()], pa.string()).dictionary_encode()
                yield from postings("body", spelt.dictionary, np.asarray(spelt.indices).astype(np.int64)[codes], dl, ids, seqs)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                some = batch.slice(lo, 200)
                held.append(some)
                size += sum(len(c.flatten()) for c in some.columns[2:])
                if size >= RUN_WORDS:
                    yield from sorted_run(held)
                    held, size = [], 0
        if held:
            yield from sorted_run(held)

    return rows.mapInArrow(run, POSTINGS.format(seq=seq))


def write_index(chunks: DataFrame, path: str, fields: dict[str, str] | None = None, stems: bool = False, files: DataFrame | None = None) -> "SearchIndex":
    """A new generation with all of ``chunks``; ``files`` (parent_id, path, mtime, ctime) are what it was made from, if it is to be kept up to date."""
    spark = chunks.sparkSession
    fields = {f: c for f, c in (fields or DEFAULT_FIELDS).items() if c in chunks.columns}
    base = f"{path}/gen={latest(spark, path) + 1}"
    chunks.write.options(**STORED).parquet(f"{base}/chunks")
    # Runs go to the table as they come: neither a shuffle nor a second copy of them takes disk.
    postings_of(spark.read.parquet(f"{base}/chunks"), fields, stems).write.options(**STORED).parquet(f"{base}/postings")
    return _finished(spark, path, fields, stems, files)


def update_index(index: "SearchIndex", fresh: DataFrame, gone: DataFrame | None = None, files: DataFrame | None = None) -> "SearchIndex":
    """A new generation in which the chunks of the files of ``fresh`` stand for what those files had, and the files of ``gone``
    (parent_id) have none. Only fresh texts are taken apart: postings of the other files are those of the generation before."""
    spark, path, fields = index.spark, index.path, index.fields
    changed = fresh.select("parent_id").distinct()
    if gone is not None:
        changed = changed.unionByName(gone.select("parent_id")).distinct()
    base = f"{path}/gen={latest(spark, path) + 1}"
    fresh.write.parquet(f"{base}/fresh")
    read = spark.read.parquet(f"{base}/fresh")
    index.chunks.join(changed, "parent_id", "left_anti").unionByName(read, allowMissingColumns=True).write.options(**STORED).parquet(f"{base}/chunks")
    stems = bool(index.stemmed_fields)
    postings = index.postings.join(changed, "parent_id", "left_anti").unionByName(postings_of(read, {f: c for f, c in fields.items() if c in read.columns}, stems))
    # Ranges are found by reading the rows once more: they are written first, so that texts are taken apart once.
    postings.write.parquet(f"{base}/unsorted")
    postings = spark.read.parquet(f"{base}/unsorted")
    postings.repartitionByRange("field", "term", "parent_id").sortWithinPartitions("field", "term", "parent_id", "chunk_seq").write.options(**STORED).parquet(f"{base}/postings")
    for done in ("unsorted", "fresh"):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{done}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return _finished(spark, path, fields, stems, files)


def _finished(spark: SparkSession, path: str, fields: dict[str, str], stems: bool, files: DataFrame | None) -> "SearchIndex":
    """Writes what follows from chunks and postings, and the manifest that makes the generation one."""
    generation = latest(spark, path) + 1
    base = f"{path}/gen={generation}"
    kept = spark.read.parquet(f"{base}/chunks")
    postings = spark.read.parquet(f"{base}/postings")
    postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf")).sortWithinPartitions("field", "term").write.options(**STORED).parquet(f"{base}/terms")
    n = kept.count()
    sizes = postings.groupBy("field").agg(F.sum("tf").alias("total"))
    sizes.select("field", F.lit(n).cast("long").alias("n"), (F.col("total") / F.lit(n)).alias("mean")).write.parquet(f"{base}/fields")
    # Values that a query may name: a filter by one that is not there is an error, which no search should need a scan to find.
    named = [kept.select(F.lit(c).alias("field"), F.col(c).alias("value")).distinct() for c in ("collection", "kind") if c in kept.columns]
    (reduce(DataFrame.unionByName, named) if named else spark.createDataFrame([], "field string, value string")).coalesce(1).write.parquet(f"{base}/values")
    if files is not None:
        files.select("parent_id", "path", "mtime", "ctime").write.parquet(f"{base}/files")
    manifest = (VERSION, generation, stems, files is not None, sorted(fields.items()))
    spark.createDataFrame([manifest], "version int, generation int, stems boolean, has_files boolean, fields array<struct<field:string,column:string>>").coalesce(1).write.parquet(f"{path}/manifest/g={generation}")
    return SearchIndex.open(spark, path)


def latest(spark: SparkSession, path: str) -> int:
    """Number of the newest complete generation, 0 for none."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return 0
    return max((int(s.getPath().getName()[2:]) for s in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))), default=0)


class FieldPredicates:
    """Field clauses of queries as conditions on the columns of chunks."""

    def __init__(self, chunks: DataFrame, now: int = 0):
        self.chunks, self.now = chunks, now

    def predicate(self, clause) -> Column:
        """A field clause as a condition on ``chunks``."""
        if isinstance(clause, q.Not):
            return ~F.coalesce(self.predicate(clause.node), F.lit(False))
        name, value = clause.field, clause.value
        if name in ("has", "exists"):
            return self._present(value)
        if name in NUMBERS:
            return self._number(name, clause)
        if name not in self.chunks.columns:
            raise QuerySyntaxError(f"no field {name!r}")
        if name in EXACT or name not in TEXT:
            return F.col(name).isin(self._exact(name, value))
        return self._text(name, value)

    def _present(self, name: str) -> Column:
        if name not in self.chunks.columns:
            raise QuerySyntaxError(f"no field {name!r}")
        return F.col(name) >= 1 if name in NUMBERS else F.length(F.coalesce(name, F.lit(""))) > 0

    @staticmethod
    def _exact(name: str, value: str) -> list[str]:
        inner = value[1:-1].replace(" OR ", " ") if value.startswith("(") else value.strip('"')
        values = [v.strip('"') for v in (inner.replace(",", " ").split() if value.startswith("(") or "," in value else [inner])]
        if name != "collection" and name in EXACT:
            values = [v.lower() for v in values]
        if name == "kind":
            values = [k for v in values for k in ([v] if v not in CATEGORIES else [*CATEGORIES[v], v])]
        return values

    def _number(self, name: str, clause) -> Column:
        def read(x: str | None) -> int | None:
            if x is None:
                return None
            if name in TIMES:
                if (seconds := iso_seconds(x)) is not None:
                    return seconds
            try:
                return int(x.replace("_", ""))
            except ValueError:
                raise QuerySyntaxError(f"{name} takes numbers, not {x!r}") from None

        column = F.col(name)
        if clause.low is None and clause.high is None:
            if name in TIMES and (span := token_range(clause.value, self.now)):
                return column.between(*span)
            return column == read(clause.value)
        low, high = read(clause.low), read(clause.high)
        out = F.lit(True)
        if low is not None:
            out = out & (column > low if clause.open_low else column >= low)
        elif name in FROM_ONE:
            out = out & (column >= 1)  # 0 says there is none
        if high is not None:
            out = out & (column < high if clause.open_high else column <= high)
        return out

    def _text(self, name: str, value: str) -> Column:
        """All words of a quoted value side by side; any of a group's; one word anywhere."""
        held = words(F.col(name))
        if value.startswith("("):
            parts = [p for p in value[1:-1].split() if p not in ("OR", "AND")]
            tests = [F.array_contains(held, p.lower()) for p in parts]
            return reduce((lambda a, b: a & b) if " AND " in value else (lambda a, b: a | b), tests)
        found = words_of(value.strip('"'))
        if not found:
            return F.lit(False)
        return F.concat(F.lit(" "), F.array_join(held, " "), F.lit(" ")).contains(" " + " ".join(found) + " ")


class SearchIndex(FieldPredicates):
    """One generation of an index. Everything read through it is of that generation."""

    def __init__(self, spark: SparkSession, path: str, generation: int, stems: bool, fields: dict[str, str] | None = None, has_files: bool = False, now: int = 0):
        base = f"{path}/gen={generation}"
        super().__init__(spark.read.parquet(f"{base}/chunks"), now)
        self.spark, self.path, self.generation = spark, path, generation
        self.postings = spark.read.parquet(f"{base}/postings")
        self.terms = spark.read.parquet(f"{base}/terms")
        self._fields = spark.read.parquet(f"{base}/fields")
        self.fields = fields or DEFAULT_FIELDS
        #: What files the generation was made from, if that was said.
        self.files = spark.read.parquet(f"{base}/files") if has_files else None
        self._values = spark.read.parquet(f"{base}/values")
        self._named: dict[str, list[str]] | None = None
        self._stats: dict[str, tuple[int, float]] | None = None
        self.stemmed_fields = frozenset({"body"} if stems else ())

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "SearchIndex":
        n = latest(spark, path)
        if not n:
            raise FileNotFoundError(f"no complete index under {path}")
        row = spark.read.parquet(f"{path}/manifest/g={n}").first()
        if row["version"] != VERSION:
            raise SchemaVersionError(f"the index is of version {row['version']}, this is version {VERSION}")
        return cls(spark, path, n, row["stems"], {x["field"]: x["column"] for x in row["fields"]}, row["has_files"])

    def dictionary(self, field: str) -> DataFrame:
        return self.terms.filter(F.col("field") == field)

    def field_stats(self) -> dict[str, tuple[int, float]]:
        """Chunks in the index and mean length, by field: a few rows."""
        if self._stats is None:
            self._stats = {r["field"]: (r["n"], r["mean"]) for r in self._fields.collect()}
        return self._stats

    def named_values(self, field: str) -> list[str]:
        """Collections or kinds that chunks have, as counted when the index was built."""
        if self._named is None:
            self._named = {}
            for r in self._values.filter(F.col("value").isNotNull()).collect():
                self._named.setdefault(r["field"], []).append(r["value"])
        return sorted(self._named.get(field, []))

    def frequencies(self, pairs: set[tuple[str, str]]) -> dict[tuple[str, str], int]:
        """Document frequencies of a query's terms, in one small job."""
        if not pairs:
            return {}
        by: dict[str, list[str]] = {}
        for f, t in sorted(pairs):
            by.setdefault(f, []).append(t)
        wanted = reduce(lambda a, b: a | b, [(F.col("field") == f) & F.col("term").isin(ts) for f, ts in by.items()])
        return {(r["field"], r["term"]): r["df"] for r in self.terms.filter(wanted).collect()}

    def file_chunks(self, parent_id: str, most: int | None = 5_000) -> DataFrame:
        """Chunks of one file in order; ``most`` None gives all."""
        rows = self.chunks.filter(F.col("parent_id") == parent_id).orderBy("chunk_seq")
        return rows if most is None else rows.limit(most)


def scope(chunks: DataFrame, arms: list[tuple[str, str | None]] | None) -> DataFrame:
    """Chunks of whole collections, or of sources of collections; ``None`` is everything, no arm is nothing."""
    if arms is None:
        return chunks
    if not arms:
        return chunks.limit(0)
    return chunks.filter(reduce(lambda a, b: a | b, [(F.col("collection") == c) & (F.lit(True) if s is None else F.col("source") == s) for c, s in arms]))


def overlap_free(hits: DataFrame, chunks: DataFrame, matcher) -> DataFrame:
    """Of two hits next to each other in a file the lower-ranked goes, if all its matches lie in the stretch that both hold.
    ``hits`` has (parent_id, chunk_seq, order), the better the smaller; the bodies of their files only are read."""
    import pyarrow as pa

    from corvane.sources.chunking import repeats

    files = F.broadcast(hits.select("parent_id").distinct())  # the files of an answer
    bodies = repeats(chunks.join(files, "parent_id", "left_semi").select("parent_id", "chunk_seq", "body"), None)
    side = Window.partitionBy("parent_id").orderBy("chunk_seq")
    bodies = bodies.withColumn("after", F.coalesce(F.lead("repeated").over(side), F.lit(0)))
    rows = hits.select("parent_id", "chunk_seq", "order").join(bodies, ["parent_id", "chunk_seq"])
    before, after = (F.when(f("chunk_seq").over(side) == F.col("chunk_seq") + d, f("order").over(side)) for f, d in ((F.lag, -1), (F.lead, 1)))
    # How much of its beginning and its end a better neighbour shows already.
    rows = rows.select("parent_id", "chunk_seq", "body", F.when(before < F.col("order"), F.col("repeated")).otherwise(0).alias("head"), F.when(after < F.col("order"), F.col("after")).otherwise(0).alias("tail")).filter("head > 0 or tail > 0")

    def run(batches):
        for b in batches:
            gone = [bool(matcher.has_any(t)) and not matcher.has_any(t[h : len(t) - e]) for t, h, e in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["parent_id", "chunk_seq"]).filter(pa.array(gone, pa.bool_()))

    seq = hits.schema["chunk_seq"].dataType.simpleString()
    return hits.join(rows.mapInArrow(run, f"parent_id string, chunk_seq {seq}"), ["parent_id", "chunk_seq"], "left_anti")
