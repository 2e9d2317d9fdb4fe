"""What keeps queries in proportion to their input: plans and operators on rows of their own."""

import os

from pyspark.sql import functions as F

from jobweave import fixtures, session, vocab
from jobweave.checks import matching
from jobweave.functions import text
from jobweave.operators import catalogue, greedy, pages, profiles, search, source_graph, wordsearch
from jobweave.sources import feeds, records

C = F.col


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_exploding_scores_computes_them_once(spark):
    session.apply_runtime_conf(spark)
    texts = spark.createDataFrame([(1, "Gizmo anvil gear", "widget"), (2, None, None)], "ord long, jd string, role string").repartition(2)
    scored = profiles.classify(texts, fixtures.DEMO_TAXONOMY, C("jd"), title=C("role"))
    plan = optimized(scored.select("ord", F.posexplode("scores")))
    assert "Generate" in plan and "Filter" not in plan
    assert [r.ord for r in scored.select("ord", F.posexplode("scores")).collect()] == [1, 1]


def test_grams_are_never_broadcast(spark):
    names = spark.createDataFrame([(f"name {i}",) for i in range(50)], "text string")
    for words in (["name 4", "e 1"], ["a longer word"]):
        found = wordsearch.containing(names, spark.createDataFrame([(w,) for w in words], "word string"))
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == sorted((f"name {i}", w) for i in range(50) for w in words if w in f"name {i}")


def test_words_a_pattern_needs():
    assert text.needed_words(vocab.INTERN) == ["实习", "intern"]
    assert text.needed_words(r"(?i)a*|xy") == [] and set(text.needed_words(r"(?:[5-9]|1[0-9])\s*(?:年|years?)")) == {"年", "year"}
    for name, pattern in vars(vocab).items():
        if isinstance(pattern, str) and pattern.startswith("(?i)"):
            assert all(w == w.lower() for w in text.needed_words(pattern)), name


def test_guarded_patterns_find_what_the_pattern_finds(spark):
    said = ["", None, "NEW  Grad 2027", "6 Years of", "５年 经验", "Intern", "资深", "off-CAMPUS", "3 - 5年", "8年工作经验", "internal", "INTERN ship", "ai", "no"]
    rows = spark.createDataFrame([(s,) for s in said], "t string")
    patterns = [vocab.CAMPUS, vocab.INTERN, vocab.SENIOR, vocab.SOCIAL, vocab.V6_EARLY, vocab.V6_SENIOR_TEXT, vocab.TECH_FEED, vocab.CAMPUS_FEED]
    both = rows.select(*[(text.low_has(F.lower("t"), p, C("t")) == text.has(C("t"), p)).alias(str(i)) for i, p in enumerate(patterns)])
    assert all(all(r) for r in both.collect())


def test_parsing_is_not_repeated_per_name(spark):
    session.apply_runtime_conf(spark)
    rows = spark.createDataFrame([(1, '{"company": "a", "title": "b"}'), (2, '{"company": "a"}'), (3, "broken"), (4, None)], "ord long, json string").repartition(2)
    out = records.map_records(rows, "json")
    assert optimized(out).count("from_json") == 1
    assert [(r.ord, r.company, r.role, r.jd) for r in out.collect()] == [(1, "a", "b", "b")]


def test_rows_without_a_key_all_stay_and_are_read_once(spark):
    rows = [(1, None), (1, None), (2, "r"), (3, "r")]
    df = spark.createDataFrame([(o, "c", r, "x", 1, "", "", "s") for o, r in rows], "ord long, company string, role string, location string, source_tier int, apply_url string, notice_url string, source string")
    best = catalogue.dedupe_best_quality(df)
    assert sorted(r.ord for r in best.collect()) == [1, 1, 2]
    assert optimized(best).count("LogicalRDD") == 1


def test_domestic_ranking_reads_only_what_is_asked_for(spark, tmp_path):
    path = str(tmp_path / "postings")
    columns = "ord long, company string, role string, jd string, batch string, graduation string, location string, updated_at string, source string, apply_url string, notice_url string, extra string"
    rows = [(1, "a", "AI", "x", "校招", "2027", "北京", "2026", "s", "u", "", "long"), (2, "b", "r", "实习", "", "", "上海", "2025", "s", "", "", "long")]
    spark.createDataFrame(rows, columns).write.parquet(path)
    ranked = catalogue.rank_domestic(spark.read.parquet(path)).select("ord", "score")
    assert "extra" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert [r.ord for r in ranked.collect()] == [1, 2]


def test_rows_that_share_no_key_need_no_round(spark):
    rows = spark.createDataFrame([(1, ["a"]), (2, ["b", "c"]), (3, ["c", "d"]), (4, ["d"]), (5, []), (6, ["a"])], "ord long, k array<string>")
    assert sorted(r.ord for r in greedy.dedupe_any_key(rows, C("k"), keep_keyless=True).collect()) == [1, 2, 4, 5]
    assert sorted(r.ord for r in greedy.dedupe_any_key(rows.where("ord < 3"), C("k")).collect()) == [1, 2]


def test_feed_files_are_compressed_and_read_back(spark, tmp_path):
    path = str(tmp_path / "feed")
    feeds.write_feed(spark.createDataFrame([(i, f"j{i}", "c", "r") for i in range(3000)], "ord long, id string, company string, role string"), path, 1, "x")
    assert all(f.endswith(".gz") for f in os.listdir(path) if f.startswith("part-"))
    for layout in ("lines", "documents"):
        assert feeds.read_feed(spark, path, layout=layout).select("id").distinct().count() == 3000


def test_rows_dealt_evenly(spark, tmp_path):
    """A table in one row group is read by one task; dealt out, no share holds much more than another."""
    path = str(tmp_path / "one")
    spark.range(20_000).coalesce(1).write.parquet(path)
    sizes = session.dealt(spark.read.parquet(path)).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 20_000 and len(sizes) >= 16 and max(sizes) < 2 * 20_000 / len(sizes)


def test_search_rules_texts_out_unsqueezed(spark):
    session.apply_runtime_conf(spark)
    said = ["a  Widget-maker", "WIDGET–maker", "widget　maker", "wid get", None, "", "Big widget", "İ widget"]
    fields = "company string, role string, location string, department string, industry string, jd string, batch string, graduation string"
    rows = spark.createDataFrame([(i, None, None, "", "", "", s, "", "") for i, s in enumerate(said)], f"ord long, {fields}").repartition(2)
    below = optimized(search.search_weighted(rows, "widget").select("ord")).splitlines()
    assert not any("regexp_replace" in line for line in below if "Filter" in line)
    for query in ("widget", "widget-maker", "big widget", "widget maker"):
        tokens = query.split()
        want = [i for i, n in enumerate(r.n for r in rows.orderBy("ord").select(text.normal(C("jd")).alias("n")).collect()) if all(t in n for t in tokens)]
        assert sorted(r.ord for r in search.search_weighted(rows, query).collect()) == want, query


def test_graph_reads_its_nodes_once(spark):
    registry = [(1, "acme", "https://acme.example.com/careers", "", "source", 60, False), (2, "acme", "https://acme.example.com/careers", "x", "watch", None, False)]
    jobs = [(5, "acme", "https://acme.example.com/careers", None, "i", "", "s"), (6, "bolt", "https://jobs.lever.co/bolt/1", None, "i", "企业官方", "s"), (4, "bolt", "https://jobs.lever.co/bolt/2", None, "k", "企业官方", "s")]
    reg = spark.createDataFrame(registry, "ord long, company string, url string, category string, kind string, priority int, authoritative boolean").repartition(2)
    seen = spark.createDataFrame(jobs, "ord long, company string, apply_url string, notice_url string, industry string, source_label string, source string").repartition(2)
    graph = source_graph.build_source_graph(reg, seen)
    assert optimized(graph).count("Generate") == 1
    rows = {r.company: r for r in graph.collect()}
    assert (rows["acme"].origin, rows["acme"].priority, rows["acme"].category) == ("priority-registry", 95, "x")
    assert [o for o in rows["acme"].origins if o != "observed-job"] == ["reviewed-registry"]
    assert (rows["bolt"].category, rows["bolt"].priority, rows["bolt"].origins) == ("k", 78, ["observed-job"])


def test_a_page_is_stripped_once(spark):
    session.apply_runtime_conf(spark)
    body = "<h1>Fitter</h1>" + "duty and need of the fitter " * 20
    rows = spark.createDataFrame([(1, "u", f"<html>{body}</html>", "The"), (2, "u", "<p>short duty need</p>", "The"), (3, "u", None, "The")], "page_id long, url string, html string, company string").repartition(2)
    jobs = pages.page_jobs(rows, "duty", "need")
    assert optimized(jobs).count("(script|style)\\b") == 1
    assert [(r.page_id, r.role) for r in jobs.collect()] == [(1, "Fitter")]


def test_records_are_opened_once(spark):
    session.apply_runtime_conf(spark)
    posting = '{"@type": ["Thing", "JobPosting"], "title": "<b>Fitter</b>", "hiringOrganization": {"name": "A"}, "jobLocation": [{"address": {"addressLocality": "X"}}], "l": [], "o": {}}'
    html = [f'<script type="application/ld+json">{p}</script>' for p in (posting, f"[[{posting}]]", '{"@type": "Thing", "title": "Fitter"}', "{broken, and long enough}", '"a string that is long enough"')]
    rows = spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id int, url string, html string").repartition(2)
    jobs = pages.jsonld_jobs(rows)
    assert not any("try_variant_get" in line and "hiringOrganization" in line for line in optimized(jobs).splitlines() if "Filter" in line)
    assert optimized(records.walk_objects(rows, "html")).count("try_variant_get") == 1
    assert sorted((r.page_id, r.role, r.company, r.location) for r in jobs.collect()) == [(0, "Fitter", "A", "X"), (1, "Fitter", "A", "X")]


def test_scored_pairs_are_made_once_for_all_orders(spark):
    shown = matching.order_results(spark, "/root/testdata/sf0.001")
    assert "Join" not in optimized(shown)
    assert {r.mode: r["count"] for r in shown.groupBy("mode").count().collect()} == {"match": 60, "fresh": 60}
