"""Command line: build an index of folders, bring it up to date, search it, list facets, explain a search."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.engine import Engine
from corvane.errors import QueryError
from corvane.functions.tags import TagFilter
from corvane.operators.index import write_index
from corvane.sources.extract import extracted
from corvane.sources.listing import Source, claimed, walk
from corvane.streaming.indexer import bring_up_to_date


def live_files(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """Every file of the sources; its content is read only where it is asked for."""
    files = claimed(walk(spark, sources)).withColumn("parent_id", F.sha1("path"))
    return files.withColumns({"mtime": F.col("modified"), "ctime": F.lit(0).cast("long")})


def chunks_of(files: DataFrame) -> DataFrame:
    """Chunks of files, with their file's columns."""
    facts = files.select("parent_id", "collection", F.col("root").alias("source"), "path", "kind", "size", "mtime", F.sha2("content", 256).alias("content_hash"))
    found = extracted(files.select("parent_id", "kind", "content"))
    title = F.first(F.element_at(F.split("heading_path", " > "), 1)).over(Window.partitionBy("parent_id").orderBy("chunk_seq"))
    return found.withColumn("title", F.coalesce(title, F.lit(""))).join(facts, "parent_id")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corvane")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("index")
    build.add_argument("index")
    build.add_argument("folders", nargs="+", help="collection=path")
    update = commands.add_parser("update")
    update.add_argument("index")
    update.add_argument("folders", nargs="+", help="collection=path")
    update.add_argument("--seconds", type=float, help="stop at the end of the slice that passes this time; the next run goes on")
    search = commands.add_parser("search")
    search.add_argument("index")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=10)
    search.add_argument("-c", "--collection", action="append")
    search.add_argument("--meta")
    search.add_argument("--tag", action="append", default=[])
    search.add_argument("--not-tag", action="append", default=[])
    search.add_argument("--explain", action="store_true")
    search.add_argument("--as-typed", action="store_true", help="respell nothing")
    search.add_argument("--fold-copies", action="store_true")
    search.add_argument("--sections", type=int, default=1)
    for name in ("kinds", "collections"):
        commands.add_parser(name).add_argument("index")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if args.command in ("index", "update"):
        live = live_files(spark, [Source(*f.split("=", 1)) if "=" in f else Source("default", f) for f in args.folders])
        if args.command == "update":
            for e in bring_up_to_date(live, chunks_of, args.index, seconds=args.seconds):
                print(f"{e.kind}\t{e.done}/{e.total}\tgeneration {e.generation}")
            return 0
        index = write_index(chunks_of(live), args.index, stems=True, files=live)
        print(f"generation {index.generation}: {index.chunks.count()} chunks")
        return 0
    engine = Engine.open(spark, args.index)
    if args.command in ("kinds", "collections"):
        column = args.command.removesuffix("s")
        for r in engine.index.chunks.groupBy(column).agg(F.countDistinct("parent_id").alias("files")).orderBy(column).collect():
            print(f"{r[column]}\t{r['files']}")
        return 0
    filters = {"arms": [(c, None) for c in args.collection] if args.collection else None, "metadata": args.meta}
    if args.tag or args.not_tag:
        filters["tags"] = TagFilter(tuple(args.tag), tuple(args.not_tag))
    try:
        if args.explain:
            print(engine.explain(args.query, limit=args.limit, as_typed=args.as_typed, **filters))
            return 0
        hits = engine.search(args.query, limit=args.limit, per_file=args.sections, as_typed=args.as_typed, collapse_copies=args.fold_copies, **filters)
        shown = engine.with_snippets(hits.select("parent_id", "chunk_seq", "rank_key", "file_place", "place"), args.query)
        for r in shown.orderBy("file_place", "place").collect():
            print(f"{r['rank_key']:.4f}\t{r['path']}\t{r['snippet']!r}")
    except QueryError as e:
        print(f"error: {e}")
        return 2
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
