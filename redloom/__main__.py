"""Command line: JSON rows on standard output; exit code 2 when a run cannot start."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def emit(df: DataFrame) -> None:
    for row in df.toJSON().toLocalIterator():
        print(row)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("redloom")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, args in (("ingest", ("folder", "store")), ("documents", ("store",)), ("hits", ("store", "terms")), ("text", ("store", "view")), ("search", ("store", "query")), ("chunks", ("store", "view")), ("summarize", ("store", "prompt", "model", "client"))):
        one = sub.add_parser(name)
        for a in args:
            one.add_argument(a)
    o = parser.parse_args(argv)

    from redloom.operators import retrieval, summaries, terms, views
    from redloom.plans import documents
    from redloom.session import build_session
    from redloom.sources import docx
    from redloom.sources.registry import FormatError, load_registry
    from redloom.sources.store import Store, ingest

    spark = build_session("redloom")
    spark.sparkContext.setLogLevel("ERROR")
    try:
        if o.command == "ingest":
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(o.folder)
            rows = ingest(Store(spark, o.store), files, docx.parse_files)
            emit(rows.groupBy("document_id", "path").agg(F.count_if(F.col("row_type") == "node").alias("nodes"), F.count_if(F.col("row_type") == "error").alias("errors")))
            return 0
        t = docx.tables_of(Store(spark, o.store, read_only=True).load("parse"))
        if o.command == "documents":
            emit(t["node"].groupBy("document_id").agg(F.count(F.lit(1)).alias("nodes")).join(t["comment"].groupBy("document_id").agg(F.count(F.lit(1)).alias("comments")), "document_id", "left").orderBy("document_id"))
        elif o.command == "text":
            emit(views.view_text(views.project(t["span"], o.view)).orderBy("document_id", "part_id"))
        elif o.command == "hits":
            registry = load_registry(spark, open(o.terms, encoding="utf-8").read())
            emit(documents.hits_of(t, terms.compile_forms(registry)))
        elif o.command == "chunks":
            emit(documents.chunks_of(t, o.view))
        elif o.command == "summarize":
            made = documents.chunks_of(t).select("document_id", "chunk_id", F.col("text").alias("markup"))
            emit(summaries.summarize(Store(spark, o.store), made, o.prompt, o.model, summaries.client(o.client)))
        else:
            leaves = t["node"].where("start_off is not null").join(t["stream"], ["document_id", "part_id"]).select("document_id", "node_id", F.lit("union").alias("view"), F.expr("substring(text, start_off + 1, end_off - start_off)").alias("text"))
            emit(retrieval.text_tier(leaves, leaves.select("document_id", "node_id", F.col("node_id").alias("chunk_id")), o.query))
    except (FileNotFoundError, FormatError, ValueError) as x:
        print(json.dumps({"error": str(x)}), file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
