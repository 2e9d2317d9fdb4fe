"""Registry lookups against a plain loop, nested objects at any depth."""

import json
import random

from pyspark.sql import functions as F

from jobweave.operators import catalogue, wordsearch
from jobweave.sources import records

REGISTRY = "no int, name string, url string"


def test_containing_is_every_occurrence(spark):
    rng = random.Random(5)
    strings = {"".join(rng.choice("ab 一") for _ in range(rng.randint(1, 12))) for _ in range(300)} | {"", "x", "aaaaaaaa", "😀a"}
    texts = spark.createDataFrame([(s,) for s in strings] + [(None,)], "text string")
    for size in (1, 3, 6):
        got = {tuple(r) for r in wordsearch.containing(texts, texts.select(F.col("text").alias("word")), size).collect()}
        assert got == {(t, w) for t in strings for w in strings if w and w in t}


def test_lookup_takes_the_first_entry_of_either_direction(spark):
    rng = random.Random(6)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    registry = [(i, n, f"u{i}") for i, n in enumerate(names)] + [(-2, "", "nameless"), (-1, None, "null"), (900, "zz", None), (901, "zz", "late")]
    companies = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(200)] + [None, " ", "zz top", "dddd", "dddd"]
    rows = spark.createDataFrame([(i, c, "own") for i, c in enumerate(companies)], "ord long, company string, apply_url string").withColumn("notice_url", F.lit(""))
    out = catalogue.official_lookup(rows, spark.createDataFrame(registry, REGISTRY)).collect()
    assert len(out) == len(companies)
    for r in out:
        c = (companies[r.ord] or "").strip()
        hits = sorted((no, url) for no, n, url in registry if n and c and (n in c or c in n))
        assert (r.official_no, r.official_url) == ((hits[0][0], hits[0][1] or "own") if hits else (None, "own"))


def test_lookup_with_an_empty_registry_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "acme", None, "n")], "ord long, company string, apply_url string, notice_url string")
    assert catalogue.official_lookup(rows, spark.createDataFrame([], REGISTRY)).first().official_url == "n"
    assert catalogue.official_lookup(rows.limit(0), spark.createDataFrame([(1, "acme", "u")], REGISTRY)).count() == 0


def test_lookup_in_a_registry_of_100_000(spark):
    registry = spark.range(100_000).select(F.col("id").cast("int").alias("no"), F.format_string("Company %06d Ltd", "id").alias("name"), F.concat(F.lit("u"), F.col("id")).alias("url"))
    rows = spark.range(0, 120_000, 1000).select(F.col("id").alias("ord"), F.format_string("Company %06d", "id").alias("company"), F.lit("own").alias("apply_url"), F.lit("").alias("notice_url"))
    got = {r.ord: r.official_url for r in catalogue.official_lookup(rows, registry).collect()}
    assert got == {i: f"u{i}" if i < 100_000 else "own" for i in range(0, 120_000, 1000)}


def test_objects_are_found_at_any_depth(spark):
    def nested(levels):
        value = {"leaf": 1}
        for i in range(levels):
            value = {"k": value} if i % 2 else [value]
        return json.dumps(value)

    payloads = [nested(d) for d in (0, 1, 12, 20, 60)] + ["[]", "{broken", None, "3"]
    df = spark.createDataFrame(list(enumerate(payloads)), "ord int, payload string").withColumn("n", F.lit("clash"))
    out = records.walk_objects(df, "payload")
    assert out.columns == ["ord", "n", "path", "depth", "record"]
    deepest = {r.ord: r.d for r in out.groupBy("ord").agg(F.max("depth").alias("d")).collect()}
    assert deepest == {0: 0, 1: 1, 2: 12, 3: 20, 4: 60}
    assert out.where("ord = 3").count() == 11  # every second level is an object, and the leaf
    assert records.walk_objects(df, "payload", max_depth=3).agg(F.max("depth")).first()[0] <= 3
