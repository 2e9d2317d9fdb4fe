"""The pipeline's stages against plain restatements, each on its own input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from jobweave.llm import mixing

from .helpers import SF, near_groups


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    root, docs = tmp_path_factory.mktemp("steps"), spark.read.parquet(f"{SF}/documents.parquet")
    junk = [(5000, None, "en", "src0", None), (5001, "12 34 !!", "en", "src0", 8), (5002, "a copy of text " * 5, "en", "src1", 75), (5003, "A copy of text " * 5, "en", "src1", 75)]
    docs = docs.union(spark.createDataFrame(junk, docs.schema)).withColumn("extra", F.lit("x"))
    out = [docs]
    for name, function in corpus_pipeline.STAGES:
        function(spark, out[-1], SF).write.parquet(str(root / name))
        out.append(spark.read.parquet(str(root / name)))
    return out


def test_stages(steps):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality", "near_dedup", "mix_sources", "pack"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_language_stage_drops_only_undetermined(steps):
    before, after = ({r.doc_id for r in s.select("doc_id").collect()} for s in steps[:2])
    assert before - after == {5000, 5001}


def test_quality_stage_keeps_most_good_documents(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = ({r.doc_id for r in s.select("doc_id").collect()} for s in steps[1:3])
    good = [i for i in before if labels.get(i) == 1]
    assert after <= before and sum(i in after for i in good) >= 0.95 * len(good)


def test_near_dedup_stage_keeps_one_of_each_group(steps):
    rows = [(r.doc_id, r.text) for r in steps[2].collect()]
    groups = near_groups(rows, 5)
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted(i for i, g in groups.items() if i == g)


def test_mixing_stage(steps):
    want = sorted(r.doc_id for r in mixing.mix(steps[3]).collect())
    assert sorted(r.doc_id for r in steps[4].collect()) == want


def test_packing_stage_covers_every_row(steps):
    rows = steps[5].collect()
    assert sorted(r.doc_id for r in rows if r.piece == 0) == sorted(r.doc_id for r in steps[4].collect())
    ends = {}
    for r in rows:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in ends.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 4096
