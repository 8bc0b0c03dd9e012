"""Sinks that take tables of any size."""

from collections import Counter

import pytest

from fathom import run_queries
from fathom.runtime import new_path
from fathom.sources import readers, writers

KIND = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("parts", [1, 3])
def test_every_document_goes_through_lists(spark, tmp_path, parts):
    rows = [(i, None if i == 3 else f'a "{i}"\n[,]é ' * i, "de" if i % 2 else None, "s") for i in range(40)] * 2
    spark.createDataFrame(rows, KIND).repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(tuple(r) for r in run_queries.round_trip_json_array(spark, str(tmp_path)).collect()) == Counter(rows)


def test_lists_have_a_bound_and_none_is_empty(spark):
    path, big = new_path(spark, "lists"), "x" * (writers.LIST_CHARS // 2)
    writers.write_json_lists(spark.createDataFrame([(i, big, "", "") for i in range(5)], KIND).coalesce(1), path)
    assert len(spark.read.text(path, wholetext=True).collect()) == 3
    assert sorted(r["doc_id"] for r in readers.json_array(spark, path, KIND).collect()) == list(range(5))
    none = new_path(spark, "lists")
    writers.write_json_lists(spark.createDataFrame([], KIND), none)
    assert readers.json_array(spark, none, KIND).count() == 0
