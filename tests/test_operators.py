"""Merging rules, the greedy rule against a plain loop, skew, transitions."""

import random

from pyspark.sql import functions as F

from jobweave import fixtures
from jobweave.operators import applications, catalogue, greedy, keys, profiles
from jobweave.operators.terms import find_terms

JOB = "ord long, id string, company string, role string, location string, source string, source_label string, source_url string, apply_url string, notice_url string, jd string, department string, batch string, updated_at string, position_id string, source_tier int"


def job(ord, **kw):
    base = {"ord": ord, "id": f"j{ord}", "company": "示例", "role": "工程师", "location": "北京", "source": "s", "source_label": f"l{ord}", "source_url": "", "apply_url": "", "notice_url": "", "jd": "", "department": "", "batch": "", "updated_at": "", "position_id": "", "source_tier": 1}
    return {**base, **kw}


def jobs(spark, rows):
    return spark.createDataFrame(rows, JOB)


def test_merge_fills_both_ways(spark):
    short = job(1, company="示例集团有限公司", jd="a", department="研发", source_label="first")
    long = job(2, company="示例", jd="a longer text", batch="校招", source_label="second")
    for rows in ([short, long], [{**long, "ord": 1}, {**short, "ord": 2}]):
        out = catalogue.merge_catalog(jobs(spark, rows), ["department", "batch", "jd"]).collect()
        assert len(out) == 1
        assert (out[0]["jd"], out[0]["department"], out[0]["batch"]) == ("a longer text", "研发", "校招")
        assert sorted(out[0]["source_labels"]) == ["first", "second"]


def test_failed_source_keeps_rows(spark):
    old = jobs(spark, [job(1, source="a"), job(2, source="b", role="x")])
    new = jobs(spark, [job(3, source="a", role="y")])
    ok = spark.createDataFrame([("a",)], "source string")
    kept = catalogue.replace_partition(old, new, ok).select("ord").collect()
    assert sorted(r["ord"] for r in kept) == [2, 3]


def test_greedy_is_not_connected_components(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["b"])], "ord long, ks array<string>")
    assert sorted(r["ord"] for r in greedy.dedupe_any_key(df, F.col("ks")).collect()) == [1, 3]


def test_greedy_matches_a_plain_loop_with_a_hot_key(spark):
    rng = random.Random(7)
    rows = [(i, sorted({("hot" if rng.random() < 0.35 else f"k{rng.randrange(60)}") for _ in range(rng.randrange(0, 4))})) for i in range(300)]
    rng.shuffle(rows)
    seen, want = set(), []
    for ord, ks in sorted(rows):
        if ks and not seen & set(ks):
            seen |= set(ks)
            want.append(ord)
    df = spark.createDataFrame(rows, "ord long, ks array<string>").repartition(5)
    assert sorted(r["ord"] for r in greedy.dedupe_any_key(df, F.col("ks")).collect()) == want


def test_keep_first_is_pruned_before_the_shuffle(spark):
    df = spark.range(10_000).select(F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    first = keys.keep_first(df, [F.col("k")], [F.col("ord")])
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()
    assert first.filter("k = 'hot'").first()["ord"] == 0


def test_transitions_across_slices(spark):
    rows = [(1, 1, "2024-01-01 10:00:00", "applied"), (2, 1, "2024-01-03 09:00:00", "applied"), (3, 1, "2024-01-03 10:00:00", "hr"), (4, 1, "2024-01-09 10:00:00", "hr"), (5, 2, "2024-01-09 10:00:00", "hr")]
    df = spark.createDataFrame(rows, "event_id long, job_no long, ts string, status string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["event_id"] for r in applications.stage_transitions(df).collect()) == [1, 3, 5]


def test_terms_count_without_overlap(spark):
    words = ["aa", "b c", "kv cache"]
    df = spark.createDataFrame([("aaa b c b c",), ("aaaa",), (None,)], "t string")
    got = [r["r"] for r in df.select(find_terms(words)(F.col("t")).alias("r")).collect()]
    assert got == [[0, 3], [1], []]


def test_sections(spark):
    text = "教育经历\nA大学\n专业技能\nCUDA C++\n项目经历\nGEMM"
    got = spark.createDataFrame([(text,)], "t string").select(profiles.split_sections(F.col("t")).alias("s")).first()["s"]
    assert [s["name"] for s in got] == ["education", "skills", "projects"]


def test_domains_of_a_text(spark):
    df = spark.createDataFrame([(1, "gizmo widget gizmo", "gizmo designer")], "id long, t string, title string")
    top = profiles.classify(df, fixtures.DEMO_TAXONOMY, F.col("t"), title=F.col("title")).first()["scores"][0]
    assert top["id"] == "gadget"
    # gizmo 9 twice and in the title, widget 8 once
    assert top["score10"] == round((9 * 2 * 1.85 + 8) * 10)


def test_merge_repeated_numbers(spark):
    """A feed number that repeats, or is missing, gives one row a key; texts meet no sort before the winners are known."""
    names = ["id", "company", "role", "department", "industry", "location", "batch", "graduation", "education", "company_type", "salary", "source", "apply_url", "notice_url", "position_id", "updated_at"]
    base = dict.fromkeys(names, "") | {"source": "s", "source_label": "l", "source_url": "u", "location": "武汉", "role": "焊工"}
    rows = [
        base | {"ord": 1, "company": "海星", "jd": "short"},
        base | {"ord": 1, "company": "海星", "jd": "the longest  of them"},
        base | {"ord": 2, "company": "海星集团", "jd": "medium text", "department": "车间"},
        base | {"ord": None, "company": "北岸", "jd": "only one"},
        base | {"ord": 5, "company": "北岸", "jd": None},
    ]
    kinds = ", ".join(f"{c} {'bigint' if c == 'ord' else 'string'}" for c in rows[0])
    merged = catalogue.merge_catalog(spark.createDataFrame([tuple(r.values()) for r in rows], kinds))
    got = {r["jd"]: r for r in merged.collect()}
    assert set(got) == {"the longest of them", "only one"} and merged.count() == 2
    assert got["the longest of them"]["department"] == "车间" and got["the longest of them"]["source_labels"] == ["l"]
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan[plan.index("max_by(struct") :].split("Aggregate")[0]
