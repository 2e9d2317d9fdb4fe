"""Bounds are arguments: everything by default, and each argument really bounds."""

import json

import pytest
from pyspark.sql import functions as F

from jobweave import fixtures, session, taxonomy
from jobweave.operators import catalogue, features, pages, search
from jobweave.plans import recommend as plan
from jobweave.sources import feeds
from jobweave.streaming import health, refresh

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def postings(spark):
    return session.stage(fixtures.postings(spark, SF), "postings")


def test_rows_and_descriptions(spark, postings):
    n = postings.count()
    assert catalogue.rank_global(postings).count() == n and catalogue.rank_global(postings, cap=7).count() == 7
    assert catalogue.rank_domestic(postings, cap=5).count() == 5
    rows = postings.withColumn("salary", F.lit(""))
    whole, cut = feeds.encode_compact(rows), feeds.encode_compact(rows, jd_chars=20, max_rows=9)
    assert whole.count() == n and cut.count() == 9
    assert cut.agg(F.max(F.length("d"))).first()[0] <= 21 < whole.agg(F.max(F.length("d"))).first()[0]
    small = catalogue.compact_catalog(rows, jd_chars=30, cap=4, sources=1)
    assert small.count() == 4 and small.agg(F.max(F.size("source_labels"))).first()[0] <= 1
    assert search.facets(postings, cap=2).groupBy("kind").count().agg(F.max("count")).first()[0] == 2


def test_boards(spark):
    lines = spark.createDataFrame([(i, f"Firm {i} | https://jobs.lever.co/t{i}/x") for i in range(800)], "ord long, line string")
    assert pages.board_discovery(lines).count() == 800 and pages.board_discovery(lines, cap=3).count() == 3


def test_taxonomy_tables(spark):
    domains = spark.createDataFrame([(i, f"d{i}", f"D {i}", ["r"]) for i in range(12_000)], "ord int, id string, name string, roles array<string>")
    terms = spark.createDataFrame([("d0", 0, "term", "alpha", 5), ("d11999", 0, "major", "omega", 9)], "domain_id string, ord int, kind string, term string, weight int")
    read = taxonomy.from_frames(domains, terms, spark.createDataFrame([("d0", "d11999")], "a string, b string"))
    assert len(read.domains) == 12_000 and read.domains[-1].majors == ("omega",) and read.related("d11999", "d0")


@pytest.mark.parametrize("indent", [None, 2])
def test_feed_layouts(spark, tmp_path, indent):
    one = {"schema_version": 2, "generated_at": "t", "jobs": [{"company": "A{", "position": "R", "tags": ["x"]}, {"company": "B", "role": "{\nS"}]}
    (tmp_path / "f.json").write_text(json.dumps(one, indent=indent))
    rows = feeds.read_feed(spark, str(tmp_path)).collect()
    assert [(r.company, r.role, r.tags) for r in sorted(rows, key=lambda r: r.pos)] == [("A{", "R", ["x"]), ("B", "{\nS", None)]


def test_feed_lines_versions_and_damage(spark, tmp_path):
    short = {"schema_version": 4, "jobs": [{"c": "C", "r": "T", "q": 7, "s": "direct-official:c", "z": "P1", "x": "L"}]}
    (tmp_path / "f.json").write_text("\n".join([json.dumps(short), json.dumps({"schema_version": 1, "jobs": [{"company": "A", "role": "R"}]})]))
    for layout in ("documents", "lines"):
        rows = {r.company: r for r in feeds.read_feed(spark, str(tmp_path), layout).collect()}
        assert (rows["C"].source_tier, rows["C"].source, rows["C"].position_id, rows["A"].schema_version) == (7, "direct-official:c", "P1", 1)
    (tmp_path / "f.json").write_text('{"jobs": [')
    with pytest.raises(Exception, match="MALFORMED_RECORD|malformed"):
        feeds.read_feed(spark, str(tmp_path)).collect()


def test_refresh_needs_its_last_version(spark, tmp_path, postings):
    refresh_rows = postings.limit(20)
    gates = spark.createDataFrame([], "source string, min_rows long, role_word string, place string, min_place_rows long")
    for n in range(2):
        refresh_rows.write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(postings.schema).json(str(tmp_path / "in"))
        where = str(tmp_path / f"snap{n}")  # the second run looks for version 0 where there is none
        query = refresh.stream_refresh(stream, where, str(tmp_path / "state"), gates)
        if n:
            with pytest.raises(Exception, match="is missing under"):
                query.awaitTermination()
        else:
            query.awaitTermination()


def test_refresh_keeps_files_of_other_sources(spark, tmp_path, postings):
    """Only delivered sources are written; a batch folded twice is one batch; old versions and their files go."""
    rows = postings.where("source in ('direct-official:acme', 'ats:lever:stark', 'direct-official:globex')")
    gates = spark.createDataFrame([], "source string, min_rows long, role_word string, place string, min_place_rows long")
    files, fields = refresh.Snapshot(spark, str(tmp_path / "snap"), rows.schema), ["jd", "department"]
    parts = lambda: {f"{p.parent.parent.name}/{p.parent.name}/{p.name}" for p in (tmp_path / "snap").glob("*/epoch=*/part=*/*.parquet")}
    refresh.fold(files, 0, rows, gates, fields, buckets=4)
    before = parts()
    one = rows.where("source = 'ats:lever:stark' and ord % 4 = 1").withColumn("ord", F.col("ord") + 10**9)
    for _ in range(2):
        refresh.fold(files, 1, one, gates, fields, buckets=4)
        now = refresh.latest(spark, files.path, 1, rows.schema)
        assert now.where("source <> 'ats:lever:stark'").count() == rows.where("source <> 'ats:lever:stark'").count()
        assert {r.ord for r in now.where("source = 'ats:lever:stark'").collect()} <= {r.ord for r in one.collect()}
        want = catalogue.merge_catalog(now, fields)
        got = refresh.latest_merged(spark, files.path, 1, rows.schema, fields)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert before < parts() and len({p for p in parts() if p.startswith("epoch=1") or "rows" in p}) > 0
    refresh.fold(files, 2, rows.limit(0), gates, fields, buckets=4)  # an empty delivery keeps all
    assert refresh.latest(spark, files.path, 2, rows.schema).count() == now.count()
    files.prune(2, keep=1)
    assert files.manifest(1) is None and refresh.latest(spark, files.path, 2, rows.schema).count() == now.count()
    assert not before <= parts()


def test_stale_sources(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 16:00:00"), ("b", "2024-01-01 09:00:00")], "source string, window_end string").withColumn("window_end", F.to_timestamp("window_end"))
    assert {r.source: r.stale for r in health.stale_sources(rows, "2024-01-01 20:00:00").collect()} == {"a": False, "b": True}


def test_low_thresholds_score_every_pair(spark, postings):
    from jobweave.checks import matching

    batch = matching.batch(spark, SF)
    few = features.Batch(batch.profiles.orderBy("profile_id").limit(2), batch.words, batch.taxonomy)
    jobs = postings.limit(150)
    everything = session.stage(plan.recommend(jobs, few, matching.AS_OF, threshold=-1).select("profile_id", "ord", "score", "mismatch", "exact"), "scored")
    assert everything.count() == 2 * jobs.count()
    # scores of unrelated pairs are capped, mismatched ones at 42
    assert everything.where("mismatch and score > 42").isEmpty() and not everything.where("mismatch").isEmpty()
    kept = plan.recommend(jobs, few, matching.AS_OF, threshold=70)
    assert {(r.profile_id, r.ord) for r in kept.collect()} == {(r.profile_id, r.ord) for r in everything.where("score >= 70").collect()}
