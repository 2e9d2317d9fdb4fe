"""Merge, de-duplication, refresh and ranking over all postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures, vocab
from ..operators import catalogue, greedy, keys
from . import CHECKS, sqlx as S
from .columns import _canonical_sql, _host, big, blank, domestic_sql, priority_sql, quality_sql, role_without_city_sql, TITLE_CITY_SQL

C = F.col
AS_OF = fixtures.AS_OF

# A second observation of every posting: some roles renamed, some departments
# lost, all ord values after the first observation's.
FRESH = """select ord + 10000000000 as ord, id, company, role || case when position_id <> '' then ' II' else '' end as role,
  case when length(jd) % 2 = 0 then '' else department end as department, industry, location, batch, '2028届' as graduation,
  education, company_type, salary_low, salary_high, source, source_label, source_url, source_tier, apply_url, notice_url,
  position_id, jd || ' (seen again)' as jd, updated_at from {postings}"""


def fresh(spark, sf):
    return spark.sql(FRESH, postings=fixtures.postings(spark, sf))


def with_both(body: str, **ctes: str) -> str:
    return S.with_postings(body, fresh=FRESH.replace("{postings}", "postings"), **ctes)


def ordered(df, *cols):
    return df.select("ord", *cols)


OWN_ID = f"coalesce(nullif(case when length(position_id) > 0 then position_id else '' end, ''), {S.sid('source', 'company', 'role', 'location')})"


@CHECKS.add(
    "dedupe_by_id",
    S.with_postings(f"select ord, role from postings qualify row_number() over (partition by {OWN_ID} order by coalesce(length({S.clean('jd')}), 0) desc, ord) = 1"),
)
def dedupe_by_id(spark, sf):
    # The position id stands in as record id so that ids repeat.
    df = fixtures.postings(spark, sf).withColumn("id", C("position_id"))
    return ordered(catalogue.dedupe_by_id(df), "role")


KEY = S.sid(S.company("company"), S.company("role"), S.company("location"))
LABEL = f"coalesce({S.clean('source_label')}, {S.clean('source')})"
FILL = [f for f in vocab.MERGE_FIELDS if f not in ("jd", "salary")]
NAMED = f"{S.clean('company')} is not null and {S.clean('role')} is not null"
MERGED_CTES = {
    "keyed": f"select *, {KEY} as key, {S.clean('jd')} as jd_clean, {LABEL} as label from postings where {NAMED}",
    "winner": "select key, ord, company, role, location, jd_clean from keyed qualify row_number() over (partition by key order by coalesce(length(jd_clean), 0) desc, ord) = 1",
    "filled": "select w.key, w.ord, w.company, w.role, w.location, w.jd_clean, "
    + ", ".join(f"coalesce((select {S.clean('k.' + f)} from keyed k where k.ord = w.ord), g.{f}) as {f}" for f in FILL)
    + " from winner w join (select key, "
    + ", ".join(f"arg_min({S.clean(f)}, ord) filter ({S.clean(f)} is not null) as {f}" for f in FILL)
    + " from keyed group by key) g on g.key = w.key",
    "labels": "select key, string_agg(label, ';' order by ord) as source_labels, count(*) as n_labels from (select key, label, min(ord) as ord from keyed group by key, label) group by key",
    "urls": "select key, string_agg(source_url, ';' order by ord) as source_urls from (select key, source_url, min(ord) as ord from keyed group by key, source_url) group by key",
}


MERGED_SELECT = (
    "select key, ord, company, role, coalesce(length(jd_clean), 0) as jd_chars, "
    + ", ".join(S.blank(f) + f" as {f}" for f in FILL)
    + ", source_labels, source_urls from filled join labels using (key) join urls using (key)"
)


def merged_shown(df):
    return df.select(
        "key", "ord", "company", "role", F.coalesce(F.length("jd"), F.lit(0)).cast("bigint").alias("jd_chars"),
        *[blank(C(f)).alias(f) for f in FILL],
        F.array_join("source_labels", ";").alias("source_labels"), F.array_join("source_urls", ";").alias("source_urls"),
    )


@CHECKS.add("merge_catalog", S.with_postings(MERGED_SELECT, **MERGED_CTES))
def merge_catalog(spark, sf):
    return merged_shown(catalogue.merge_catalog(fixtures.postings(spark, sf), FILL + ["jd"]))


@CHECKS.add(
    "compact_catalog",
    S.with_postings(
        f"""select key, ord, {S.blank(S.clean('jd_clean'))} as jd,
        (select string_agg(label, ';' order by ord) from (select label, min(ord) as ord from keyed k where k.key = f.key group by label)) as source_labels
        from filled f order by coalesce(updated_at, '') desc, coalesce({S.clean('company')}, '') desc, coalesce({S.clean('role')}, '') desc, ord""",
        **MERGED_CTES,
    ),
)
def compact_catalog(spark, sf):
    df = catalogue.compact_catalog(fixtures.postings(spark, sf).withColumn("salary", F.lit("")))
    return df.select("key", "ord", blank(C("jd")).alias("jd"), F.array_join("source_labels", ";").alias("source_labels"))


def any_keys_sql() -> str:
    c, r, p = (f"lower({S.clean(x)})" for x in ("company", "role", "location"))
    names = f"({c} || '|' || {r})"
    return (
        f"list_distinct(list_filter(['url:' || {_canonical_sql('apply_url', vocab.TRACKING_PARAMS)} || '|' || {names}, "
        f"'url:' || {_canonical_sql('notice_url', vocab.TRACKING_PARAMS)} || '|' || {names}, "
        f"'position:' || {c} || '|' || lower({S.clean('position_id')}), 'fallback:' || {names} || '|' || {p}], lambda k: k is not null))"
    )


def greedy_sql(rounds: int = 10) -> str:
    """The greedy rule unrolled; all rows of the data settle within these rounds."""
    ctes = {
        "e0": "select ord, unnest(case when len(keys) = 0 then ['role:' || names] else keys end) as key from (select ord, keys, names from (select ord, "
        + any_keys_sql()
        + f" as keys, lower({S.clean('company')}) || '|' || lower({S.clean('role')}) as names from postings))",
    }
    for i in range(rounds):
        ctes[f"s{i}"] = f"select ord from (select ord, key, min(ord) over (partition by key) as first from e{i}) group by ord having max(ord - first) = 0"
        ctes[f"e{i + 1}"] = f"select * from e{i} where ord not in (select ord from e{i} where key in (select key from e{i} where ord in (select ord from s{i})))"
    union = " union all ".join(f"select ord from s{i}" for i in range(rounds))
    body = S.with_postings(f"select ord, role from postings where ord in ({union})", **ctes)
    for name in ctes:
        body = body.replace(f"\n{name} as (", f"\n{name} as materialized (")
    return body


@CHECKS.add("dedupe_any_key", greedy_sql())
def dedupe_any_key(spark, sf):
    return ordered(greedy.dedupe_any_key(fixtures.postings(spark, sf)), "role")


OPPORTUNITY = (
    f"lower({S.clean('company')}) || '|' || {role_without_city_sql('role')} || '|' || "
    f"{S.blank(f'lower({S.clean(f'coalesce(nullif(trim(location), {S.q(str())}), {TITLE_CITY_SQL})')})')}"
)


@CHECKS.add(
    "dedupe_best_quality",
    S.with_postings(f"select ord, source from postings qualify row_number() over (partition by coalesce({OPPORTUNITY}, cast(ord as string)) order by {quality_sql()} desc, ord) = 1"),
)
def dedupe_best_quality(spark, sf):
    return ordered(catalogue.dedupe_best_quality(fixtures.postings(spark, sf)), "source")


LINK = f"coalesce({S.clean('apply_url')}, {S.clean('notice_url')})"
FEED_KEY = f"""lower(coalesce({S.clean('source')} || ':' || {S.clean('position_id')},
  'pdd:' || nullif(regexp_extract({LINK}, '[?&]position(?:Id|_id)=([^&#]+)', 1), ''),
  'url:' || regexp_replace({LINK}, '/+$', ''),
  {S.blank(f'lower({S.clean("company")})')} || '|' || {S.blank(f'lower({S.clean("role")})')} || '|' || {S.blank(f'lower({S.clean("location")})')}))"""


@CHECKS.add("dedupe_canonical", S.with_postings(f"select ord, source from postings qualify row_number() over (partition by {FEED_KEY} order by ord) = 1"))
def dedupe_canonical(spark, sf):
    return ordered(catalogue.dedupe_canonical(fixtures.postings(spark, sf)), "source")


def low(x: str) -> str:
    return S.blank(f"lower({S.clean(x)})")


IDENTITY = f"{low('company')} || '/' || {low('role')} || '/' || {low('location')} || '/' || {S.blank(f'lower({LINK})')}"
LATEST = "select *, {i} as ident from {t} qualify row_number() over (partition by {i} order by ord desc) = 1"
UPSERT_CTES = {"o": LATEST.format(i=IDENTITY, t="postings"), "f": LATEST.format(i=IDENTITY, t="fresh")}
UPSERT = {
    "replace": "select coalesce(f.ord, o.ord) as ord, coalesce(f.graduation, o.graduation) as graduation, coalesce(f.department, o.department) as department from o full join f using (ident)",
    "insert_only": "select coalesce(o.ord, f.ord) as ord, coalesce(o.graduation, f.graduation) as graduation, coalesce(o.department, f.department) as department from o full join f using (ident)",
    "overlay": """select case when f.source like 'direct-official:%' then f.ord else coalesce(o.ord, f.ord) end as ord,
      case when f.source like 'direct-official:%' then coalesce(nullif(f.graduation, ''), o.graduation) else coalesce(o.graduation, f.graduation) end as graduation,
      case when f.source like 'direct-official:%' then coalesce(nullif(f.department, ''), o.department, '') else coalesce(o.department, f.department) end as department
      from o full join f using (ident)""",
}


def _upsert(mode):
    def run(spark, sf):
        return ordered(catalogue.upsert(fixtures.postings(spark, sf), fresh(spark, sf), mode), "graduation", "department")

    return run


for _mode in UPSERT:
    CHECKS.add(f"upsert_{_mode}", with_both(UPSERT[_mode], **UPSERT_CTES))(_upsert(_mode))

# A source counts as refreshed when more than half of its fresh rows lost their department.
OK_SQL = "select source from fresh group by source having count(*) filter (department = '') * 2 > count(*)"
POSITION_IDENTITY = (
    f"{low('company')} || '/' || {low('role')} || '/' || {low('location')} || '/' || {S.blank(f'lower(coalesce({S.clean("position_id")}, {S.clean("apply_url")}))')}"
)


def ok_sources(new):
    return new.groupBy("source").agg(F.count_if(C("department") == "").alias("lost"), F.count("*").alias("n")).filter("lost * 2 > n").select("source")


@CHECKS.add(
    "replace_partition",
    with_both(
        "select ord, source from kept union all select ord, source from new where ident not in (select ident from kept)",
        done=OK_SQL,
        kept=f"select *, {POSITION_IDENTITY} as ident from postings where source not in (select source from done)",
        new=f"select *, {POSITION_IDENTITY} as ident from fresh qualify row_number() over (partition by {POSITION_IDENTITY} order by ord) = 1",
    ),
)
def replace_partition(spark, sf):
    new = fresh(spark, sf)
    return ordered(catalogue.replace_partition(fixtures.postings(spark, sf), new, ok_sources(new)), "source")


@CHECKS.add(
    "replace_window",
    with_both(
        "select ord, source from kept union all select ord, source from new where ident not in (select ident from kept)",
        done=OK_SQL,
        kept=f"select *, {POSITION_IDENTITY} as ident from postings where not (source in (select source from done) and (contains(batch, '社会') or contains(apply_url, '/social/')))",
        new=f"select *, {POSITION_IDENTITY} as ident from fresh qualify row_number() over (partition by {POSITION_IDENTITY} order by ord) = 1",
    ),
)
def replace_window(spark, sf):
    new = fresh(spark, sf)
    social = C("batch").contains("社会") | C("apply_url").contains("/social/")
    return ordered(catalogue.replace_partition(fixtures.postings(spark, sf), new, ok_sources(new), social), "source")


GATES = [
    ("direct-official:acme", 10, "工程师", "北京", 1), ("direct-official:globex", 1_000_000_000, None, None, None),
    ("ncss-public:2027", 1, "no such role", None, None), ("ats:lever:stark", 1, None, "Atlantis", 1),
]


@CHECKS.add(
    "last_good",
    with_both(
        """select ord, source, 0::bigint as preserved from fresh where source in (select source from passing)
           union all select ord, source, 1 from postings where source not in (select source from passing)""",
        stats="""select source, count(*) as n, count(*) filter (contains(role, '工程师')) as eng, count(*) filter (contains(location, '北京')) as bj,
          count(*) filter (contains(lower(role), 'no such role')) as none, count(*) filter (contains(location, 'Atlantis')) as atl from fresh group by source""",
        passing="""select source from stats where case source when 'direct-official:acme' then n >= 10 and eng > 0 and bj >= 1
          when 'direct-official:globex' then n >= 1000000000 when 'ncss-public:2027' then none > 0 when 'ats:lever:stark' then atl >= 1 else true end""",
    ),
)
def last_good(spark, sf):
    gates = spark.createDataFrame(GATES, "source string, min_rows long, role_word string, place string, min_place_rows long")
    df = catalogue.last_good(fresh(spark, sf), fixtures.postings(spark, sf), gates)
    return ordered(df, "source", big(C("preserved_previous")).alias("preserved"))


ORDER = {"direct-official:globex": 0, "ats:lever:stark": 1, "direct-official:acme": 2}
RANK = "case source when 'direct-official:globex' then 0 when 'ats:lever:stark' then 1 when 'direct-official:acme' then 2 else 99 end"


@CHECKS.add("priority_union", S.with_postings(f"select ord, source from postings qualify row_number() over (partition by {FEED_KEY} order by {RANK}, source, ord) = 1"))
def priority_union(spark, sf):
    return ordered(catalogue.priority_union(fixtures.postings(spark, sf), ORDER), "source")


DOMESTIC_SCORE = f"""({priority_sql(S.clean('source'))} + case when contains(location, '北京') then 65 when {S.rx('location', '|'.join(vocab.FIRST_TIER))} then 38 else 0 end
  + case when {S.rx(S.joined(*map(S.clean, ['role', 'jd', 'batch', 'graduation'])), vocab.CAMPUS_FEED)} then 35 else 0 end
  + case when {S.rx("concat_ws('', " + ', '.join(map(S.clean, ['role', 'jd', 'batch', 'graduation'])) + ')', vocab.TARGET_YEAR)} then 18 else 0 end
  + case when {S.rx(S.clean('role'), vocab.TECH_FEED)} then 22 when {S.rx(S.clean('jd'), vocab.TECH_FEED)} then 9 else 0 end
  + case when trim(apply_url) <> '' then 8 when trim(notice_url) <> '' then 3 else 0 end)::bigint"""


@CHECKS.add(
    "rank_domestic",
    S.with_postings(
        f"select ord, score from (select *, {DOMESTIC_SCORE} as score from postings where {domestic_sql('location', 'source')}) "
        f"order by score desc, updated_at, {S.clean('company')}, ord"
    ),
)
def rank_domestic(spark, sf):
    return ordered(catalogue.rank_domestic(fixtures.postings(spark, sf)), big(C("score")).alias("score"))


GLOBAL_SCORE = f"({priority_sql('source')} + case when {S.rx(S.joined('role', 'batch', 'graduation'), vocab.CAMPUS_FEED)} then 20 else 0 end)::bigint"


@CHECKS.add("rank_global", S.with_postings(f"select ord, {GLOBAL_SCORE} as score from postings order by score desc, updated_at, ord"))
def rank_global(spark, sf):
    return ordered(catalogue.rank_global(fixtures.postings(spark, sf)), big(C("score")).alias("score"))


CUTOFF = "1999-01-01"
RECENT = f"coalesce(try_cast(updated_at as date) >= date '{CUTOFF}', false)"
EXPLICIT, CAMPUS = S.rx("role", vocab.TARGET_YEAR), S.rx("role", vocab.CAMPUS_FEED)


@CHECKS.add(
    "signal_filter",
    S.with_postings(
        f"select ord, ({RECENT} and ({EXPLICIT} or {CAMPUS}))::bigint as current_rule from postings where {EXPLICIT} or ({RECENT} and {CAMPUS})"
    ),
)
def signal_filter(spark, sf):
    df = catalogue.signal_filter(fixtures.postings(spark, sf), CUTOFF, "watch")
    return ordered(df, F.lit(1).cast("bigint").alias("current_rule"))


@CHECKS.add(
    "signal_union",
    with_both(
        f"select ord, set_no from sets qualify row_number() over (partition by {IDENTITY} order by set_no desc, ord desc) = 1",
        s0=f"select * from postings where notice_url <> '' and {RECENT} and ({EXPLICIT} or {CAMPUS}) qualify row_number() over (partition by notice_url order by ord desc) = 1",
        s1="select * from fresh where notice_url <> '' qualify row_number() over (partition by notice_url order by ord desc) = 1",
        sets="select *, 0::bigint as set_no from s0 union all by name select *, 1::bigint as set_no from s1",
    ),
)
def signal_union(spark, sf):
    first = catalogue.signal_filter(fixtures.postings(spark, sf), CUTOFF, "current")
    second = catalogue.signal_filter(fresh(spark, sf), CUTOFF, "explicit")
    return ordered(catalogue.signal_union([first, second]), big(C("set_no")).alias("set_no"))


TENANT_REGISTRY = """select source, min(case when apply_url <> '' then apply_url end) as start_url,
  min(case when contains(apply_url, 'recruitee') then apply_url end) as api_url from {postings} group by source"""


@CHECKS.add(
    "tenant_guard",
    S.with_postings(
        f"""select p.ord, p.source from postings p join reg r on p.source = r.source where
          {_host('p.apply_url')} = {_host('r.start_url')} or {_host('p.apply_url')} = {_host('r.api_url')}
          or ({_host('p.apply_url')} = 'shop.example.org' and {_host('p.notice_url')} = {_host('r.start_url')} and regexp_matches(cast(p.ord as string), '^[0-9]+$'))""",
        reg=TENANT_REGISTRY.replace("{postings}", "postings"),
    ),
)
def tenant_guard(spark, sf):
    df = fixtures.postings(spark, sf)
    reg = spark.sql(TENANT_REGISTRY, postings=df).withColumn("api_hosts", F.array_compact(F.array(keys.urls.host(C("api_url")))))
    rows = df.select("ord", "source", C("apply_url").alias("response_url"), C("notice_url").alias("origin_url"), C("ord").cast("string").alias("tenant"))
    return ordered(catalogue.tenant_guard(rows, reg, "shop.example.org"), "source")


REGISTRY = [
    ("Supplier#00000000", "https://all.example.com"), ("Supplier#000000003", "https://three.example.com"),
    ("SUPPLIER#000000007", "https://seven.example.com"), ("the Supplier#000000002 group", "https://two.example.com"),
]


def _official_sql(registry: str) -> str:
    company = S.blank(S.clean("company"))
    return S.with_postings(
        f"""select ord, coalesce(f.url, nullif(apply_url, ''), nullif(notice_url, ''), '') as official_url
        from postings left join firsts f on {company} = f.known""",
        registry=registry,
        companies=f"select distinct {company} as known from postings",
        firsts="select known, arg_min(url, i) as url from companies join registry on known <> '' and (contains(known, name) or contains(name, known)) group by known",
    )


def _official(spark, sf, registry):
    return ordered(catalogue.official_lookup(fixtures.postings(spark, sf), registry), blank(C("official_url")).alias("official_url"))


@CHECKS.add(
    "official_lookup",
    _official_sql("select * from (values " + ", ".join(f"({i}, {S.q(n)}, {S.q(u)})" for i, (n, u) in enumerate(reversed(REGISTRY))) + ") t(i, name, url)"),
)
def official_lookup(spark, sf):
    rows = [(i, n, u) for i, (n, u) in enumerate(reversed(REGISTRY))]
    return _official(spark, sf, spark.createDataFrame(rows, "no int, name string, url string"))


#: Registered names that are longer than the companies' own, shorter, or the same.
SUPPLIER_REGISTRY = """select s_suppkey as i, concat('https://', cast(s_suppkey as string), '.example.com') as url,
  case s_suppkey % 3 when 0 then substring(s_name, 1, 17) when 1 then concat('the ', s_name, ' group') else s_name end as name
  from {supplier} where s_suppkey % 4 > 0"""


@CHECKS.add("official_lookup_table", _official_sql(SUPPLIER_REGISTRY.replace("{supplier}", "supplier")))
def official_lookup_table(spark, sf):
    registry = spark.sql(SUPPLIER_REGISTRY, supplier=fixtures.table(spark, sf, "supplier"))
    return _official(spark, sf, registry.withColumnRenamed("i", "no"))
