"""Questions from a command line: ``python -m fathom.cli --chunks PATH --query TEXT [--filter JSON] ...``"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom.functions.text import preview
from fathom.operators.filters import parse_filter
from fathom.operators.retrieve import METHODS, Retriever, answered, distinct_sources
from fathom.sources.writers import boxed

ROWS = "qid long, query string, doc {doc}, rank int, source_file string, preview string, error string"


def search_batch(chunks: DataFrame, asked: Sequence[tuple[str, str | None]], k: int = 3, method: str = "hybrid", retriever: Retriever | None = None) -> DataFrame:
    """(qid, query, doc, rank, source_file, preview, error) for questions with filters in JSON (or None).

    Filters are parsed before anything runs; text that isn't a filter warns and means none. Questions
    with the same filter are one search, and all searches share one index. A question that can't be
    asked is one row with its error and no document; the others are answered. ``chunks`` are (doc, text,
    any metadata).
    """
    spark, find = chunks.sparkSession, retriever or Retriever(chunks)
    kind = chunks.schema["doc"].dataType.simpleString()
    groups: dict[str, list[tuple[int, str]]] = {}
    failed = []
    for qid, (question, wanted) in enumerate(asked):
        try:
            if not (question or "").strip():
                raise ValueError("no question")
            groups.setdefault(json.dumps(parse_filter(wanted), sort_keys=True), []).append((qid, question))
        except ValueError as e:
            failed.append((qid, question, f"{type(e).__name__}: {e}"))
    files = F.col("source_file") if "source_file" in chunks.columns else F.lit(None).cast("string")
    known = chunks.select(F.col("doc").alias("__doc"), files.alias("source_file"), preview(F.col("text"), 200).alias("preview"))
    parts = []
    for wanted, rows in groups.items():
        try:
            table = spark.createDataFrame(rows, "qid long, query string")
            found = find.retrieve(table, k, json.loads(wanted), method)
            held = found.join(known, F.col("doc") == F.col("__doc")).join(F.broadcast(table), "qid")
            parts.append(held.select("qid", "query", "doc", F.col("rank").cast("int").alias("rank"), "source_file", "preview", F.lit(None).cast("string").alias("error")))
        except Exception as e:  # of the plan, such as a filter of another type: that group's rows say so
            failed += [(qid, q, f"{type(e).__name__}: {str(e).splitlines()[0]}") for qid, q in rows]
    errors = spark.createDataFrame(failed, "qid long, query string, error string")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("doc", kind), ("rank", "int"), ("source_file", "string"), ("preview", "string"))]
    parts.append(errors.select("qid", "query", *none, "error"))
    return reduce(DataFrame.unionByName, parts)


def _asked(args: argparse.Namespace) -> list[tuple[str, str | None]]:
    if not args.queries:
        return [(args.query, args.filter)]
    with sys.stdin if args.queries == "-" else open(args.queries, encoding="utf-8") as lines:
        rows = [json.loads(x) for x in lines if x.strip()]
    return [(r["query"], json.dumps(r["filter"]) if r.get("filter") is not None else args.filter) for r in rows]


def main(argv: Sequence[str] | None = None) -> int:
    """Print what is found for each question, the answer and its sources; 1 if a question failed."""
    parser = argparse.ArgumentParser(prog="fathom", description="Ask chunks a question, or a file of them.")
    parser.add_argument("--chunks", required=True, help="Parquet of chunks: doc (or chunk_id), text, any metadata")
    parser.add_argument("--query", default="", help="one question")
    parser.add_argument("--queries", help="a file of JSON lines {query, filter}, - for the standard input")
    parser.add_argument("--filter", help='metadata that must be equal, as JSON: {"source": "review"}')
    parser.add_argument("--k", type=int, default=3)
    parser.add_argument("--method", choices=METHODS, default="hybrid")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("fathom").getOrCreate()
    chunks = spark.read.parquet(args.chunks)
    if "doc" not in chunks.columns:
        chunks = chunks.withColumnRenamed("chunk_id", "doc")
    asked = _asked(args)
    found = search_batch(chunks, asked, args.k, args.method).persist()
    held = found.where("error is null").join(chunks.select(F.col("doc").alias("__doc"), "text"), F.col("doc") == F.col("__doc"))
    rows = held.groupBy("qid", "query").agg(F.array_sort(F.collect_list(F.struct("rank", "doc", "text"))).alias("x"))
    answers = {r["qid"]: r["answer"] for r in answered(rows).collect()}
    sources: dict[int, list[str]] = {}
    for r in distinct_sources(held.select("qid", F.coalesce("source_file", F.lit("unknown")).alias("source"), "rank")).orderBy("qid", "first_rank").collect():
        sources.setdefault(r["qid"], []).append(r["source"])
    errors = 0
    lines = found.orderBy("qid", "rank").collect()  # k rows for each question asked
    for qid, (question, _) in enumerate(asked):
        print(f"== {question}")
        for r in (x for x in lines if x["qid"] == qid):
            if r["error"]:
                errors += 1
                print(f"error: {r['error']}")
            else:
                print(f"[{r['rank']}] {r['source_file'] or 'unknown'}: {r['preview'][:150]}")
        if qid in answers:
            print(boxed(answers[qid]))
            print("sources: " + ", ".join(sources.get(qid, [])))
    return int(errors > 0)


if __name__ == "__main__":
    sys.exit(main())
