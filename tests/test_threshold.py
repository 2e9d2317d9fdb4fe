"""The threshold join against scoring every posting for every profile."""

import pytest
from pyspark.sql import functions as F

from jobweave import fixtures, session
from jobweave.checks import matching
from jobweave.operators import classic, features, scoring, wordsearch
from jobweave.plans import recommend as plan, threshold

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sides(spark):
    batch = matching.batch(spark, SF)
    jobs = session.stage(features.job_features(fixtures.postings(spark, SF).where("ord % 8 = 0"), batch, matching.AS_OF), "features")
    # people who differ in what bounds depend on: year, degree, wanted place and sureness
    kind = F.col("profile_id") % 4
    varied = batch.profiles.withColumns(
        {"p_year": F.when(kind < 2, F.lit("2027")), "p_degree": F.when(kind == 3, 4).otherwise(F.col("p_degree")), "p_conf": F.when(kind == 1, 40).otherwise(F.col("p_conf")),
         "target_locations": F.when(kind == 2, F.array(F.lit("北京"))).otherwise(F.array().cast("array<string>"))}
    )
    batch = features.Batch(session.stage(varied, "varied"), batch.words, batch.taxonomy)
    every = session.stage(scoring.score_pairs(features.all_pairs(jobs, batch)).select("profile_id", "ord", "score"), "every")
    return jobs, batch, every


@pytest.mark.parametrize("least", [70, 55, 50, 42])
def test_same_rows_as_all_pairs(sides, least, monkeypatch):
    jobs, batch, every = sides
    monkeypatch.setattr(threshold.blocked_join, "__defaults__", (40, 7))  # many blocks a key
    found = threshold.pairs_above(jobs, batch, least).select("profile_id", "ord", "score")
    want = every.where(F.col("score") >= least)
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()
    if least <= 55:
        assert want.count() > 0


def test_no_nested_loop_and_no_forced_broadcast(sides):
    jobs, batch, _ = sides
    for least in (70, 50):
        text = threshold.pairs_above(jobs, batch, least)._jdf.queryExecution().toString()
        assert "NestedLoop" not in text and "CartesianProduct" not in text and "ResolvedHint" not in text


def test_bounds():
    assert threshold.least_fit(-1) < 0 and threshold.least_fit(15) <= 0 < threshold.least_fit(16) < threshold.least_fit(99) < 1.01


def test_words_in_texts(spark):
    words = spark.createDataFrame([(0, "er"), (1, "machine learning"), (2, "learn"), (3, ""), (4, "a"), (5, "深度学习"), (6, "x y z"), (7, "learning on"), (8, "q" * 300)], "n int, w string")
    texts = ["machine learning on", "amachine learnings", "我们深度学习的", "ax y zb x  y", "", None, "teacher", "p" * 700 + "深度学习" + "q" * 299, "z" * 260 + "q" * 300, "machine\tlearning"]
    rows = session.stage(spark.createDataFrame(list(enumerate(texts)), "ord long, t string").withColumn("u", F.reverse("t")), "texts")
    got = {r.ord: (r.a, r.b) for r in wordsearch.occurrences(rows, "ord", {"a": "t", "b": "u"}, words).collect()}
    listed = [(r.n, r.w) for r in words.collect()]
    for i, t in enumerate(texts):
        want = tuple([n for n, w in listed if w and t and w in text] for text in (t or "", (t or "")[::-1]))
        assert got.get(i, ([], [])) == want, texts[i]
    assert wordsearch.occurrences(rows, "ord", {"a": "t"}, words.limit(0)).count() == 0


def test_words_in_texts_of_several_fields(spark):
    words = spark.createDataFrame([(0, "gear"), (1, "ring on"), (2, "on gear"), (3, "ear"), (4, "z")], "n int, w string")
    rows = session.stage(
        spark.createDataFrame([(0, "a ring", "on gear", "on gear"), (1, "gear", None, "gear"), (2, "", "gear z", "ring on"), (3, None, None, None)], "ord long, t string, u string, v string"), "texts"
    )
    got = {r.ord: (r.a, r.b, r.c) for r in wordsearch.occurrences(rows, "ord", {"a": ["t", "u"], "b": "v", "c": ["u", "v"]}, words).collect()}
    assert got == {0: ([0, 1, 2, 3], [0, 2, 3], [0, 2, 3]), 1: ([0, 3], [0, 3], [0, 3]), 2: ([0, 3, 4], [1], [0, 1, 3, 4])}
    # a field equal to another one of its row is cut once, for both
    listed = {r.ord: {(x.fields, *x.tokens) for x in r.listed if x.tokens} for r in wordsearch._tokens(rows, "ord", ["t", "u", "v"]).collect()}
    assert listed == {0: {(1, "a", "ring"), (6, "on", "gear")}, 1: {(5, "gear")}, 2: {(1, ""), (2, "gear", "z"), (4, "ring", "on")}, 3: set()}


def test_pairs_do_no_text_work(spark):
    """What depends on one side only is a feature of that side; a pair compares numbers."""
    people = spark.createDataFrame([(1, [1, 2], [2, 9], [1, 2, 9], ["X"])], "profile_id long, role_all array<int>, sk_30 array<int>, p_cheap array<int>, target_locations array<string>")
    jobs = spark.createDataFrame([(1, "X", 30, [1], [1, 2, 3, 4]), (2, None, -60, [], [3])], "ord long, location string, cheap_own int, title_ids array<int>, cheap_ids array<int>")
    scored = classic.cheap_fit(jobs.crossJoin(people))
    assert {r.ord: r.cheap_fit for r in scored.collect()} == {1: 30 + 28 + 22 + 7 + 2, 2: -60}
    assert "RLIKE" not in scored._jdf.queryExecution().toString()
