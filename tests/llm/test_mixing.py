import math

import duckdb
import pytest

from jobweave.llm import mixing


@pytest.fixture(scope="module")
def skewed(spark):
    rows = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else f"s{i % 7}" if i % 5 else "rare"
        rows.append((i, " ".join(["w"] * (1 + i * 37 % 91)) if i % 50 else None, source if i % 101 else None))
    return rows


@pytest.mark.parametrize(("entropy", "repeats"), [(0.97, 2.0), (1.0, 1.2), (0.5, 3.0), (0.99, 50.0)])
def test_against_sql(spark, skewed, entropy, repeats):
    df = spark.createDataFrame(skewed, "doc_id long, text string, source string")
    got = mixing.mix(df, entropy=entropy, repeats=repeats, block_tokens=500)
    got = sorted((r.doc_id, r.source or "", r.tokens, r.epoch, r.block, r.block_rank) for r in got.collect())
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", skewed)
    want = con.execute(mixing.oracle_sql(entropy, repeats, 500)).fetchall()
    assert got == sorted(want)


def test_weights_and_quotas(spark, skewed):
    df = spark.createDataFrame(skewed, "doc_id long, text string, source string")
    sources = df.groupBy(mixing.F.coalesce("source", mixing.F.lit("")).alias("source")).agg(mixing.F.sum(mixing.tokens(mixing.F.col("text"))).alias("tokens")).where("tokens > 0").cache()
    weights = {r.source: r for r in mixing.weigh(sources, entropy=0.99, repeats=50).collect()}
    p = [r.weight for r in weights.values()]
    assert math.isclose(sum(p), 1) and math.isclose(-sum(x * math.log(x) for x in p), 0.99 * math.log(len(p)), rel_tol=1e-6)
    tight = mixing.weigh(sources, entropy=1.0, repeats=1.2).collect()
    assert math.isclose(max(r.quota / r.tokens for r in tight), 1.2, rel_tol=0.05)
    taken, longest = {}, max(len((t or "").split()) for _, t, _ in skewed)
    for r in mixing.mix(df, entropy=0.99, repeats=50, block_tokens=500).collect():
        taken[r.source or ""] = taken.get(r.source or "", 0) + r.tokens
    assert all(r.quota <= taken[s] < r.quota + longest for s, r in weights.items())


def test_epochs_permute_blocks(spark, skewed):
    df = spark.createDataFrame(skewed, "doc_id long, text string, source string")
    rows = mixing.mix(df, entropy=1.0, repeats=50, block_tokens=20).where("source is null").collect()
    orders = {e: [b for _, b in sorted({(r.block_rank, r.block) for r in rows if r.epoch == e})] for e in {r.epoch for r in rows}}
    full = [o for o in orders.values() if len(o) == max(map(len, orders.values()))]
    # every full epoch holds the same blocks; of the 720 orders of six blocks a handful of epochs meets few twice
    assert len(full[0]) >= 6 and len(full) > 5 and len({frozenset(o) for o in full}) == 1
    assert len({tuple(o) for o in full}) >= 0.8 * len(full)
    assert len({(r.doc_id, r.epoch) for r in rows}) == len(rows)


def test_native(spark, skewed):
    plan = mixing.mix(spark.createDataFrame(skewed[:50], "doc_id long, text string, source string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
