"""Source graph, health and statistics from suppliers and postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures, vocab
from ..operators import source_graph as G
from . import CHECKS, sqlx as S
from .columns import _host, big, blank, board_key_sql, board_root_sql, source_url_sql

C = F.col

# Suppliers as registries: kind and address follow from their nation and balance.
REGISTRY = """select s_suppkey as ord, s_name as company, case s_nationkey % 3 when 0 then 'watch' when 1 then 'source' else 'spider' end as kind,
  case s_nationkey % 4 when 0 then 'https://jobs.lever.co/Tenant' || cast(s_suppkey as string) when 1 then 'https://www.zhipin.com/x' when 2 then 'http://hr.example.com/join/' else 'https://corp.zhiye.com/a/b/c?jobId=7&x=1' end as url,
  case when s_nationkey % 5 = 0 then 'grid' else '' end as category, case when s_acctbal > 0 then cast(floor(s_acctbal / 50) as int) end as priority, s_acctbal > 7000 as authoritative from {supplier}"""


def registry(spark, sf):
    return spark.sql(REGISTRY, supplier=fixtures.table(spark, sf, "supplier"))


PREFERRED = "(select company from reg where authoritative and kind = 'source')"
GRAPH_CTES = {
    "reg": REGISTRY.replace("{supplier}", "supplier"),
    "known": f"""select ord::bigint as ord, company, {source_url_sql('url')} as url, case kind when 'watch' then 95 when 'source' then coalesce(priority, 70) else 100 end as priority,
      case kind when 'watch' then 'priority-registry' when 'source' then 'reviewed-registry' else 'career-spider' end as origin from reg where authoritative or company not in {PREFERRED}""",
    "raw_links": f"select ord * 2 + 1000000000000 as ord, {S.clean('company')} as company, apply_url as raw, source_label, source from postings union all select ord * 2 + 1000000000001, {S.clean('company')}, notice_url, source_label, source from postings",
    "reviewed_links": f"select *, {source_url_sql('raw')} as reviewed from raw_links where company not in {PREFERRED}",
    "seen0": f"select ord, company, {board_root_sql('raw', 'reviewed')} as url, case when contains(source_label, '官网') or contains(source_label, '企业官方') or {S.rx('source', '^(direct-official:|ats:|china-official)')} then 78 else 42 end as priority, 'observed-job' as origin from reviewed_links",
    "seen": f"select * from seen0 where url is not null and ({S.rx('url', vocab.CAREER_HINT)} or {S.rx(_host('url'), vocab.BOARD_HINT)})",
    "node": f"select *, {board_key_sql('company', 'url')} as key from (select ord, company, url, greatest(1, least(100, priority)) as priority, origin from (select * from known where url is not null union all select * from seen))",
    "winner": "select * from node qualify row_number() over (partition by key order by priority desc, ord) = 1",
    "others": "select key, origin, count(*) as n from node group by key, origin",
    "graph": """select key, company, url, priority, origin, coalesce((select string_agg(o.origin, ';' order by o.origin) from others o where o.key = w.key and (o.origin <> w.origin or o.n > 1)), '') as origins from winner w""",
}


@CHECKS.add("build_source_graph", S.with_postings("select key, company, url, priority::bigint as priority, origin, origins from graph", **GRAPH_CTES))
def build_source_graph(spark, sf):
    df = G.ranked(G.build_source_graph(registry(spark, sf), fixtures.postings(spark, sf)))
    return df.select("key", "company", "url", big(C("priority")).alias("priority"), "origin", F.array_join("origins", ";").alias("origins"))


@CHECKS.add(
    "graph_health",
    S.with_postings(
        """select key, coalesce(v.status, h.health, '') as health from graph g left join (select key, case when contains(key, 'lever') then 'request-failed' else 'jobs-found' end as health from graph where priority >= 42) h using (key)
        left join (select key, case when priority > 90 then 'jobs-found' when length(url) % 2 = 0 then 'reachable-no-concrete-job' else 'request-failed' end as status from graph where origin <> 'observed-job') v using (key)""",
        **GRAPH_CTES,
    ),
)
def graph_health(spark, sf):
    graph = G.build_source_graph(registry(spark, sf), fixtures.postings(spark, sf))
    before = graph.filter("priority >= 42").select("key", F.when(C("key").contains("lever"), "request-failed").otherwise("jobs-found").alias("health"))
    visits = graph.filter("origin <> 'observed-job'").select(
        "key", F.when(F.length("url") % 2 == 0, 200).otherwise(500).alias("http_status"), F.when(C("priority") > 90, 3).otherwise(0).alias("jobs")
    )
    return G.apply_health(G.carry_health(graph, before), visits).select("key", blank(C("health")).alias("health"))


VISITS = "select s_suppkey as key, case when s_acctbal < 0 then null when s_acctbal > 5000 then 200 else 404 end as http_status, s_nationkey as jobs from {supplier}"


@CHECKS.add(
    "visit_summary",
    f"select count(*) as sampled, count(*) filter (http_status < 400) as reachable, sum(jobs)::bigint as jobs from ({VISITS.replace('{supplier}', 'supplier')})",
)
def visit_summary(spark, sf):
    df = G.visit_summary(spark.sql(VISITS, supplier=fixtures.table(spark, sf, "supplier")))
    return df.select(*[big(C(c)).alias(c) for c in df.columns])


STATUS = """select s_suppkey as ord, case when s_nationkey % 4 = 0 then '' else 'Source-' || cast(s_nationkey as string) end as name, case when s_nationkey % 8 = 0 then '' else s_name end as label, '' as url,
  s_acctbal > 0 as ok, cast(floor(abs(s_acctbal)) as bigint) as advertised, case when s_acctbal > 3000 then '2001-07-15T01:00:00Z' else '2001-07-14T12:00:00Z' end as generated_at from {supplier}"""
BASE = "select c_custkey as ord, case when c_nationkey % 4 = 0 then '' else 'SOURCE-' || cast(c_custkey % 40 as string) end as name, '' as label, case when c_nationkey % 8 = 0 then '' else c_name end as url, c_acctbal > 0 as ok, 0 as advertised, '2001-07-15T03:00:00Z' as generated_at from {customer}"


def status(spark, sf):
    return spark.sql(STATUS, supplier=fixtures.table(spark, sf, "supplier")), spark.sql(BASE, customer=fixtures.table(spark, sf, "customer"))


STATUS_KEY = "lower(coalesce(nullif(name, ''), nullif(label, ''), nullif(url, '')))"
STATUS_CTES = {"p": STATUS.replace("{supplier}", "supplier"), "b": BASE.replace("{customer}", "customer")}


def with_status(body: str) -> str:
    return "with " + ", ".join(f"{k} as ({v})" for k, v in STATUS_CTES.items()) + " " + body


@CHECKS.add(
    "merge_status",
    with_status(
        f"""select side::bigint as side, ord, name, (select max(g) from (select max(generated_at) as g from p union all select max(generated_at) from b)) as generated_at from (select 0 as side, * from p union all select 1, * from b)
        qualify {STATUS_KEY} is null or row_number() over (partition by {STATUS_KEY} order by side, ord) = 1"""
    ),
)
def merge_status(spark, sf):
    p, b = status(spark, sf)
    merged = G.merge_status(p, b.withColumn("advertised", C("advertised").cast("bigint")))
    return merged.select(big(C("side")).alias("side"), "ord", "name", G.later_stamp(p, b).scalar().alias("generated_at"))


@CHECKS.add(
    "upsert_status",
    with_status("select side::bigint as side, ord, name from (select 0 as side, ord, name from p union all select 1, ord, name from b where name not in (select name from p)) where name not in ('Source-3', 'SOURCE-5')"),
)
def upsert_status(spark, sf):
    new, old = status(spark, sf)
    return G.upsert_status(old, new, ["Source-3", "SOURCE-5"]).select(big(C("side")).alias("side"), "ord", "name")


@CHECKS.add(
    "source_stats",
    S.with_postings(
        f"""select source, count(*) as rows, count(distinct {S.clean('company')}) as companies, count(*) filter (contains(location, '北京')) as in_place,
        count(*) filter (contains(company_type, '国有企业')) as state_owned, count(*) filter (graduation = '2027届') as explicit_year from postings group by source"""
    ),
)
def source_stats(spark, sf):
    return G.source_stats(fixtures.postings(spark, sf))


@CHECKS.add(
    "top_groups",
    S.with_postings(
        "select source, value, n, place::bigint as place from (select *, row_number() over (partition by source order by n desc, value) as place from (select source, coalesce(nullif(department, ''), '未分类') as value, count(*) as n from postings group by 1, 2)) where place <= 30"
    ),
)
def top_groups(spark, sf):
    return G.top_groups(fixtures.postings(spark, sf), "source", "department").select("source", "value", "n", big(C("place")).alias("place"))


@CHECKS.add(
    "feed_state",
    with_status(
        """select max(advertised) as expected, case when (select count(*) from orders) > 0 then 'global' else 'none' end as chosen, 'degraded' as state, 0::bigint as inconsistent,
        (max(generated_at) < '2001-07-15T04:00:00Z')::bigint as stale, count(*) filter (ok) as ok_sources, count(*) as all_sources from p"""
    ),
)
def feed_state(spark, sf):
    p, _ = status(spark, sf)
    catalogue = fixtures.postings(spark, sf).groupBy().agg(F.count("*").alias("rows"))
    feeds = catalogue.select(
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("feed"), F.lit(ok).alias("ok"), (C("rows") * keep).alias("rows")) for f, ok, keep in (("priority", True, 0), ("domestic", False, 0), ("global", True, 1), ("previous", True, 1))])
        ).alias("f")
    ).select("f.*")
    df = G.feed_state(feeds, p, "2001-07-15 10:00:00")
    return df.select("expected", "chosen", "state", big(C("inconsistent")).alias("inconsistent"), big(C("stale")).alias("stale"), "ok_sources", "all_sources")
