"""Queries that SQL can express, against that SQL; and every query over awkward and empty tables."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import compare  # noqa: E402

from jobweave.llm import queries  # noqa: E402

from .helpers import DOCS, SF, edge_rows  # noqa: E402


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_and_sql(spark, name):
    result, _, _ = compare.compare(spark, compare.duck(SF), SF, name, queries.QUERIES[name], queries.ORACLES[name])
    assert result.startswith("ok") and "types" not in result, result


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("awkward"))
    labels = [(i, i % 2, i % 3 % 2) for i in range(12)] + [(3, None, None), (None, 1, 1), (4, 0, 1), (4, 0, 1)]
    html = ["<p>x</p>", None, "", "<article><p>a</p></article>", "<p>" + "y" * 2000]
    pages = [(i, None if i % 4 == 3 else f"http://h{i % 2}/p", html[i % 5]) for i in range(12)] + [(None, "http://h0/q", html[4]), (4, "http://h0/p", html[4]), (4, "http://h0/p", html[4])]
    vectors = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0]), (8, [0.0, 1.0]), (None, [0.0, 1.0]), (8, [0.0, 1.0])]
    for name, rows, schema in (("documents", edge_rows(), DOCS), ("labels", labels, "doc_id long, quality int, toxic int"), ("pages", pages, "page_id long, url string, html string"), ("embeddings", vectors, "vec_id long, embedding array<float>")):
        df = spark.createDataFrame(rows, schema)
        clash = {c: F.lit("extra") for c in ("score", "predicted", "lang_pred", "tokens", "epoch", "block", "key", "id", "n", "group", "host", "path", "length", "part", "rank", "slot", "print", "label")}
        df.withColumns(clash).write.parquet(f"{root}/{name}.parquet")
        df.limit(0).write.parquet(f"{root}/empty/{name}.parquet")
    return root


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_awkward_and_empty_tables(spark, awkward, name):
    got = queries.QUERIES[name](spark, awkward)
    rows = got.collect()
    n = {"op1": 15, "op3": 11, "op6": None, "op9": None, "op10": 15}.get(name.split("_")[0], len(edge_rows()))
    assert n is None or len(rows) == n
    if name.startswith("op6"):
        assert rows
    if name.startswith("op9"):
        assert sum(r.piece == 0 for r in rows) == len(edge_rows())
    empty = queries.QUERIES[name](spark, f"{awkward}/empty")
    assert empty.count() == 0 and empty.columns == got.columns
