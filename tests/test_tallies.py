"""Words sought inside a posting's row, and sums over words in common, against plain loops."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from jobweave.functions.text import settled
from jobweave.operators import scoring, tallies
from jobweave.operators.wordsearch import Words, finder


def test_words_in_rows():
    listed = [(0, "er"), (1, "machine learning"), (2, "learn"), (3, ""), (4, "a"), (5, "深度学习"), (6, "x y z"), (9, "learning on"), (8, "q" * 300)]
    draw = random.Random(1)
    texts = ["machine learning on", "我们深度学习的", "ax y zb x  y", "", None, "p" * 700 + "深度学习" + "q" * 299, "z" * 260 + "q" * 300]
    texts += ["".join(draw.choice("abx yzerq") for _ in range(draw.randint(0, 60))) for _ in range(400)]
    others = texts[::-1]
    counts, numbers = Words(listed).find([pa.array(texts), pa.array(others)], [[0, 1]])[0]
    at = 0
    for t, u, n in zip(texts, others, counts):
        text = " ".join(x for x in (t, u) if x is not None)
        assert numbers[at:at + n].tolist() == sorted(k for k, w in listed if w and w in text)
        at += n


def test_words_come_without_a_shuffle(spark):
    rows = spark.createDataFrame([(1, "gear ring"), (2, None)], "ord long, t string")
    found = rows.withColumn("x", finder(Words([(7, "ear"), (3, "ring")]), {"t": F.col("t")}, {"ids": ["t"]}))
    assert {r.ord: r.x.ids for r in found.collect()} == {1: [3, 7], 2: []}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_sums_of_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(tallies, "BLOCK", 2)
    draw = random.Random(2)
    people = [(p, p * 10, ["X"] if p % 2 else [], [p % 3], *[[draw.randrange(20) for _ in range(6)] for _ in range(2)]) for p in range(5)]
    jobs = [(o, draw.choice(["AXA", None, "B"]), [o % 4], draw.sample(range(25), 9) if o else None, draw.sample(range(25), 2)) for o in range(30)]
    profiles = spark.createDataFrame(people, "slot int, profile_id long, target_locations array<string>, p_reach array<int>, a array<int>, b array<int>")
    postings = spark.createDataFrame(jobs, "ord long, location string, j_top array<int>, ids array<int>, title array<int>")
    parts = {"sum": [tallies.Part("a", "ids", 100), tallies.Part("a", "title", 65), tallies.Part("b", "ids", 7)]}
    for reach in (False, True):
        got = {(r.ord, r.profile_id): (r.sum, r.here) for r in tallies.met(postings, profiles, parts, reach).collect()}
        want = {
            (o, pid): (sum(100 for n in set(a) if n in (ids or [])) + sum(65 for n in set(a) if n in title) + sum(7 for n in set(b) if n in (ids or [])), any(t in (loc or "") for t in places))
            for _, pid, places, own, a, b in people for o, loc, top, ids, title in jobs if not reach or set(own) & set(top)
        }
        assert got == want
    assert tallies.met(postings, profiles.where("slot > 0"), parts) is None


def test_skill_fit_of_counted_words(spark):
    pair = "1L as sk_total, array(1, 2) as sk_35, array(3) as sk_170, array(4) as sk_125, array(5) as sk_100, array(1, 9) as kw, array(1, 2, 3, 4, 5, 9) as p_words, array(1, 4, 9) as all_ids, array(4) as title_ids"
    plain = spark.sql(f"select {pair}")
    hit = 35 * 100 + 125 * 165 + 2 * 2800
    counted = plain.withColumns({"skill_hit": F.lit(hit), "words_met": F.lit(4)})
    a, b = (scoring.skill_fit(x).select("skill_points", "skill_hits").first() for x in (plain, counted))
    assert a == b and a.skill_hits == 4
    assert "array_intersect" not in scoring.skill_fit(counted)._jdf.queryExecution().optimizedPlan().toString()


def test_settled_condition_is_computed_once(spark):
    made = spark.range(10).withColumn("x", F.pow("id", F.lit(0.5))).withColumn("y", F.col("x") * F.col("x"))
    kept = settled(made, F.col("y") >= 4)
    assert sorted(r.id for r in kept.collect()) == [r.id for r in made.where("y >= 4").orderBy("id").collect()]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("POWER") == 1
