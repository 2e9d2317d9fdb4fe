"""Column expressions over all postings, pages, résumés."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures, vocab
from ..functions import dates, provenance, signals, text, urls
from . import CHECKS, sqlx as S

C = F.col
AS_OF = fixtures.AS_OF


def blank(c):
    return F.coalesce(c, F.lit(""))


def big(c):
    return c.cast("bigint")


def posting_check(name: str, cols: str, **ctes: str):
    return CHECKS.add(name, S.with_postings(f"select ord, {cols} from postings", **ctes))


@posting_check("clean_norm", f"{S.blank(S.clean('role'))} as role_clean, {S.blank(S.norm('company'))} as company_norm")
def clean_norm(spark, sf):
    df = fixtures.postings(spark, sf)
    return df.select("ord", blank(text.clean(C("role"))).alias("role_clean"), blank(text.norm(C("company"))).alias("company_norm"))


@posting_check("canonical_company", f"{S.blank(S.company('company'))} as company_key")
def canonical_company(spark, sf):
    return fixtures.postings(spark, sf).select("ord", blank(text.canonical_company(C("company"))).alias("company_key"))


@posting_check("stable_id", f"{S.sid('source', 'company', 'role', 'location')} as sid")
def stable_id(spark, sf):
    df = fixtures.postings(spark, sf)
    return df.select("ord", text.stable_id(*map(C, ["source", "company", "role", "location"])).alias("sid"))


@posting_check("compact_text", f"{S.blank(S.compact('jd', 220))} as jd_short")
def compact_text(spark, sf):
    return fixtures.postings(spark, sf).select("ord", blank(text.compact_text(C("jd"), 220)).alias("jd_short"))


def _canonical_sql(x: str, drop: list[str]) -> str:
    bare = f"regexp_replace(trim({x}), '#.*$', '')"
    base = f"regexp_replace(regexp_extract({bare}, '^([^?]*)', 1), '/+$', '')"
    root = f"{base} || case when regexp_matches({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+$') then '/' else '' end"
    kept = (
        f"list_filter(string_split(regexp_extract({bare}, '^[^?#]*[?]([^#]*)', 1), '&'), "
        f"lambda p: p <> '' and not list_contains({S.arr(drop)}, split_part(p, '=', 1)))"
    )
    full = f"{root} || case when len({kept}) > 0 then '?' || array_to_string({kept}, '&') else '' end"
    return (
        f"nullif(lower(case when regexp_matches(trim({x}), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') then {full} "
        f"else regexp_replace({bare}, '/+$', '') end), '')"
    )


@posting_check(
    "canonical_url",
    f"{S.blank(_canonical_sql('apply_url', vocab.TRACKING_PARAMS))} as apply_key, "
    f"{S.blank(_canonical_sql('notice_url', vocab.TRACKING_PARAMS_LATER))} as notice_key",
)
def canonical_url(spark, sf):
    df = fixtures.postings(spark, sf)
    return df.select(
        "ord",
        blank(urls.canonical_url(C("apply_url"))).alias("apply_key"),
        blank(urls.canonical_url(C("notice_url"), vocab.TRACKING_PARAMS_LATER)).alias("notice_key"),
    )


def _host(x):
    return f"nullif(lower(regexp_extract({x}, '^[A-Za-z]+://([^/?#:]*)', 1)), '')"


def source_url_sql(x: str) -> str:
    """SQL twin of urls.source_url for links without user info or ports."""
    url = S.clean(x)
    path = f"regexp_replace(regexp_replace(regexp_extract({url}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/$', '')"
    query = f"string_split(regexp_extract({url}, '[?]([^#]*)', 1), '&')"
    key = "lower(split_part(p, '=', 1))"
    keep = (
        f"case when contains({_host(url)}, 'hotjob.cn') then list_filter({query}, lambda p: {key} = 'projectcode' and p like '%=_%') "
        f"when {_host(url)} like '%jobs.feishu.cn' then list_filter({query}, lambda p: {key} = 'project' and p like '%=_%') "
        f"when contains({_host(url)}, 'zhiye.com') then list_filter({query}, lambda p: {key} in ('jobid','jobadid','projectid','projectcode') and p like '%=_%') "
        "else [] end"
    )
    ok = (
        f"regexp_matches({url}, '^https?://') and {_host(url)} is not null and {_host(url)} not in "
        f"({', '.join(map(S.q, vocab.EXCLUDED_HOSTS))}) and not regexp_matches({_host(url)}, {S.q(vocab.EXCLUDED_SUFFIX)})"
    )
    return (
        f"case when {ok} then lower(regexp_extract({url}, '^(https?)://', 1)) || '://' || {_host(url)} || "
        f"case when {path} = '' then '/' else {path} end || "
        f"case when len({keep}) > 0 then '?' || array_to_string({keep}, '&') else '' end end"
    )


@posting_check("source_url_key", f"{S.blank(source_url_sql('apply_url'))} as source_url_key")
def source_url_key(spark, sf):
    return fixtures.postings(spark, sf).select("ord", blank(urls.source_url(C("apply_url"))).alias("source_url_key"))


def board_root_sql(raw: str, reviewed: str) -> str:
    first = f"split_part(regexp_extract({reviewed}, '^https?://[^/]*/*(.*)$', 1), '/', 1)"
    return f"""case when contains({_host(raw)}, 'greenhouse.io') and contains({raw}, '/embed/') and regexp_matches({raw}, '[?&]for=[^&]')
        then 'https://' || {_host(raw)} || '/' || regexp_extract({raw}, '[?&]for=([^&#]*)', 1)
      when regexp_matches({_host(reviewed)}, {S.q(vocab.SHARED_BOARD)}) then 'https://' || {_host(reviewed)} || '/' || {first}
      when contains({_host(reviewed)}, 'recruitee.com') then 'https://' || {_host(reviewed)} || '/'
      else {reviewed} end"""


def board_key_sql(company: str, url: str) -> str:
    rest = f"list_filter(string_split(regexp_extract({url}, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')"
    return f"""{S.blank(f'lower({S.clean(company)})')} || '|' || coalesce({_host(url)}, '') || '|' ||
      case when regexp_matches({_host(url)}, {S.q(vocab.SHARED_BOARD)}) or {_host(url)} like '%jobs.feishu.cn' then coalesce({rest}[1], '')
        when contains({_host(url)}, 'recruitee.com') then ''
        when regexp_matches({_host(url)}, {S.q(vocab.BOARD_HINT)}) then array_to_string({rest}[1:2], '/')
        else '' end"""


@CHECKS.add("board_root_key")
def board_root_key(spark, sf):
    df = fixtures.postings(spark, sf).select("ord", "company", urls.board_root(C("apply_url")).alias("root"))
    return df.select("ord", blank(C("root")).alias("board_root"), blank(urls.board_key(C("company"), C("root"))).alias("board_key"))


CHECKS.oracles["board_root_key"] = S.with_postings(
    f"select ord, coalesce(root, '') as board_root, coalesce({board_key_sql('company', 'root')}, '') as board_key from "
    f"(select ord, company, {board_root_sql('apply_url', 'reviewed')} as root from "
    f"(select *, {source_url_sql('apply_url')} as reviewed from postings))"
)

# Six spellings of the same day, chosen by row, so every branch sees all rows.
SPELLINGS = """case ord % 6
  when 0 then day when 1 then replace(day, '-', '/') when 2 then replace(day, '-', '.') || ' 10:00'
  when 3 then substr(day, 1, 4) || '年' || cast(cast(substr(day, 6, 2) as int) as string) || '月' || cast(cast(substr(day, 9, 2) as int) as string) || '日'
  when 4 then cast((ord + 1000000000) * 1000 as string) else cast(ord + 1000000000 as string) end"""


@CHECKS.add(
    "parse_date",
    S.with_postings(
        f"""select ord, coalesce(cast(case when ord % 13 = 0 and ord % 6 < 4 or ord % 6 in (1, 2, 3) and updated_at < '2000' then null when ord % 6 >= 4
          then cast(make_timestamp((ord + 1000000000) * 1000000) as date) else cast(updated_at as date) end as string), '') as day
        from (select ord, case when updated_at = '' then null else updated_at end as updated_at from postings)"""
    ),
)
def parse_date(spark, sf):
    df = fixtures.postings(spark, sf).select("ord", text.nonblank(C("updated_at")).alias("day"))
    df = df.withColumn("raw", F.when(C("day").isNotNull() | (C("ord") % 6 >= 4), F.expr(f"case when day is null and ord % 6 < 4 then null else {SPELLINGS} end")))
    return df.select("ord", blank(dates.parse_date(C("raw")).cast("string")).alias("day"))


@posting_check("age_days", f"cast({S.age('updated_at')} as bigint) as age")
def age_days(spark, sf):
    df = fixtures.postings(spark, sf)
    return df.select("ord", big(dates.age_days(dates.parse_date(C("updated_at")), AS_OF)).alias("age"))


FRESH_SQL = "case when age <= 14 then 5.0::double when age <= 30 then 4 when age <= 60 then 2.5 when age <= 120 then 1 else 0 end"


@CHECKS.add(
    "freshness",
    S.with_postings(
        f"select ord, {FRESH_SQL} as fresh, case when age <= 7 then 8 when age <= 30 then 5 when age <= 60 then 2 else 0 end::bigint as fresh_v4 "
        f"from (select ord, {S.age('updated_at')} as age from postings)"
    ),
)
def freshness(spark, sf):
    df = fixtures.postings(spark, sf).withColumn("age", dates.age_days(dates.parse_date(C("updated_at")), AS_OF))
    return df.select("ord", dates.freshness(C("age")).alias("fresh"), big(dates.freshness_v4(C("age"))).alias("fresh_v4"))


def role_sql(x: str, strict: bool) -> str:
    t = S.clean(x)
    extra = f" and {S.rx(t, vocab.ROLE_WORD)}" if strict else ""
    return (
        f"coalesce(length({t}) between 2 and 140 and not {S.rx(t, vocab.ROLE_NOISE)} and not {S.rx(t, '^[0-9]+$')} "
        f"and not {S.rx(t, r'^[^\p{L}\p{N}]+$')}{extra}, false)"
    )


@posting_check("looks_like_role", f"{role_sql('role', False)}::bigint as loose, {role_sql('role', True)}::bigint as strict, {role_sql('batch', False)}::bigint as batch_loose")
def looks_like_role(spark, sf):
    df = fixtures.postings(spark, sf)
    return df.select(
        "ord",
        big(signals.looks_like_role(C("role"))).alias("loose"),
        big(signals.looks_like_role(C("role"), strict=True)).alias("strict"),
        big(signals.looks_like_role(C("batch"))).alias("batch_loose"),
    )


def graduation_sql(x: str) -> str:
    y = vocab.COHORT_YEAR
    long = f"regexp_extract({x}, {S.q(rf'(^|[^0-9])({y})\s*届')}, 2)"
    short = f"regexp_extract({x}, {S.q(r'(^|[^0-9])(2[4-9]|3[0-9])\s*届')}, 2)"
    bare = f"regexp_extract({x}, {S.q(rf'(^|[^\p{{L}}\p{{N}}_])({y})($|[^\p{{L}}\p{{N}}_])')}, 2)"
    return (
        f"case when {long} <> '' then {long} || '届' when {short} <> '' then '20' || {short} || '届' "
        f"when {bare} <> '' and {S.rx(x, vocab.COHORT_HINT)} then {bare} || '届' end"
    )


def year_sql(x: str) -> str:
    years = f"list_sort(list_distinct(regexp_extract_all({x}, {S.q(vocab.COHORT_YEAR)})))"
    return f"coalesce(list_filter({years}, lambda y: contains({x}, y || '届'))[1], {years}[-1])"


def degree_sql(x: str) -> str:
    low = S.norm(x)
    return (
        f"case when contains({low}, '博士') or contains({low}, 'phd') then '博士' when contains({low}, '硕士') then '硕士' "
        f"when contains({low}, '研究生') then '研究生' when contains({low}, 'master') then '硕士' when contains({low}, '本科') then '本科' "
        f"when contains({low}, '学士') then '学士' when contains({low}, 'bachelor') then '本科' when contains({low}, '大专') then '大专' "
        f"when contains({low}, '专科') then '专科' end"
    )


def rank_sql(x: str) -> str:
    d = degree_sql(x)
    return f"coalesce(case {d} when '博士' then 4 when '硕士' then 3 when '研究生' then 3 when '本科' then 2 when '学士' then 2 when '大专' then 1 when '专科' then 1 end, 0)"


@CHECKS.add(
    "graduation_degree",
    f"with resumes as ({S.RESUMES}) select profile_id, {S.blank(graduation_sql('text'))} as graduation, "
    f"{S.blank(year_sql('text'))} as grad_year, {S.blank(degree_sql('text'))} as degree, {rank_sql('text')}::bigint as degree_rank from resumes",
)
def graduation_degree(spark, sf):
    df = fixtures.resumes(spark, sf)
    t = C("text")
    return df.select(
        "profile_id",
        blank(signals.infer_graduation(t)).alias("graduation"),
        blank(signals.graduation_year(t)).alias("grad_year"),
        blank(signals.infer_degree(t)).alias("degree"),
        big(signals.degree_rank(t)).alias("degree_rank"),
    )


BLOB = S.joined("role", "batch", "graduation")


@posting_check(
    "batch_label",
    f"""case when contains(role, '实习') then '2027实习/人才储备' when contains(role, '秋招') then '2027秋招' else '2027校园招聘' end as campaign,
    case when graduation = '2027届' or {S.rx(S.joined('role', 'department'), vocab.TARGET_YEAR)} then '2027校园招聘'
      when {S.rx('role', vocab.CAMPUS_FEED)} then '校园/实习招聘·年份待确认' else '当前公开岗位·年份待确认' end as platform,
    {S.blank(f'''case when {graduation_sql(BLOB)} is not null then {graduation_sql(BLOB)} || '校园招聘' || coalesce(' · ' || {S.clean('company_type')}, '')
      when {S.rx(BLOB, vocab.CAMPUS)} then '校园招聘' else {S.clean('company_type')} end''')} as cohort""",
)
def batch_label(spark, sf):
    df = fixtures.postings(spark, sf)
    blob = text.joined(C("role"), C("batch"), C("graduation"))
    return df.select(
        "ord",
        signals.campaign_batch(C("role")).alias("campaign"),
        signals.platform_batch(text.joined(C("role"), C("department")), C("role"), C("graduation") == "2027届").alias("platform"),
        blank(signals.cohort_batch(blob, C("company_type"))).alias("cohort"),
    )


def class_sql(source: str, label: str) -> str:
    s = S.blank(f"lower({S.clean(source)})")
    short = f"substr({S.clean(label)}, 1, 40)"
    return f"""case when starts_with({s}, 'direct-official:') then coalesce({short}, '企业招聘官网 · 自主直连')
      when starts_with({s}, 'priority-official:') or starts_with({s}, 'priority-campaign:') then coalesce({short}, '重点企业 2027 招聘源')
      when starts_with({s}, 'ncss-public:') then '国家大学生就业服务平台 · 2027招聘'
      when starts_with({s}, 'campus-discovery:university') then coalesce({short}, '高校就业网 · 2027招聘发现')
      when starts_with({s}, 'priority-discovery:sasac') then coalesce({short}, '央企官方招聘发现')
      when starts_with({s}, 'china-official') then '中国企业官方招聘' when starts_with({s}, 'ats:') then '企业官方 ATS'
      when starts_with({s}, 'remote-board') then '公开远程招聘板' else coalesce({short}, '公开招聘来源') end"""


@posting_check("source_class", f"{class_sql('source', 'source_label')} as source_class")
def source_class(spark, sf):
    return fixtures.postings(spark, sf).select("ord", provenance.source_class(C("source"), C("source_label")).alias("source_class"))


def tier_sql(source: str, label: str) -> str:
    s = S.blank(f"lower({S.clean(source)})")
    b = f"({s} || ' ' || {S.blank(f'lower({S.clean(label)})')})"
    return f"""case when starts_with({s}, 'direct-official:') or {S.rx(b, '自主直连|招聘官网')} then 7
      when {S.rx(s, '^(priority-official:|china-official|ats:)')} or {S.rx(b, '企业官方招聘|企业官方 ats')} then 6
      when starts_with({s}, 'priority-campaign:') or starts_with({s}, 'priority-discovery:sasac') or contains({b}, '国资委') then 5
      when starts_with({s}, 'ncss-public:') or contains({b}, '国家大学生就业') then 4
      when starts_with({s}, 'campus-discovery:university') or contains({b}, '高校就业网') then 3 else 1 end"""


def score_sql(tier: str, *texts: str) -> str:
    b = S.blank(S.norm(S.joined(*texts)))
    return f"""case when {tier} >= 3 then least({tier}, 7) when {S.rx(b, 'direct-official|自主直连|招聘官网|mokahr')} then 7
      when {S.rx(b, r'企业官方|官方招聘|feishu|beisen|zhiye\.com')} then 6 when {S.rx(b, '国资委|sasac|政府|官方公告')} then 5
      when {S.rx(b, '国家大学生就业|ncss')} then 4 when contains({b}, '高校就业') then 3 else 1 end"""


PROVENANCE_TEXTS = ("source_label", "source", "source_url", "apply_url", "notice_url")


@posting_check(
    "source_tier_score",
    f"case when source_tier is not null then greatest(1, least(7, source_tier)) else {tier_sql('source', 'source_label')} end::bigint as tier, "
    f"{score_sql('source_tier', *PROVENANCE_TEXTS)}::bigint as score",
)
def source_tier_score(spark, sf):
    df = fixtures.postings(spark, sf)
    return df.select(
        "ord",
        big(provenance.source_tier(C("source"), C("source_label"), C("source_tier"))).alias("tier"),
        big(provenance.source_score(C("source_tier"), *map(C, PROVENANCE_TEXTS))).alias("score"),
    )


def priority_sql(source: str) -> str:
    s = f"lower({source})"
    return f"""case when starts_with({s}, 'direct-official:') or contains({s}, '招聘官网') then 145
      when starts_with({s}, 'priority-official:') then 135 when starts_with({s}, 'priority-campaign:') then 110
      when starts_with({s}, 'china-official') or contains({s}, '中国企业官方招聘') then 95
      when starts_with({s}, 'ncss-public:') or contains({s}, '国家大学生就业') then 80
      when starts_with({s}, 'priority-discovery:sasac') or contains({s}, '国资委') then 72
      when starts_with({s}, 'campus-discovery:university') or contains({s}, '高校就业网') then 65
      when starts_with({s}, 'ats:') or contains({s}, '企业官方 ats') then 55 else 0 end"""


def quality_sql() -> str:
    return (
        "(coalesce(source_tier, 0) * 10 + case when trim(apply_url) <> '' then 8 else 0 end + case when trim(notice_url) <> '' then 2 else 0 end "
        f"+ case when {S.rx('lower(source)', 'direct-official|官网|官方|moka|beisen|feishu|iguopin')} then 6 else 0 end)"
    )


@posting_check("source_priority_quality", f"{priority_sql('source')}::bigint as priority, {quality_sql()}::bigint as quality")
def source_priority_quality(spark, sf):
    df = fixtures.postings(spark, sf)
    return df.select(
        "ord",
        big(provenance.source_priority(C("source"))).alias("priority"),
        big(provenance.source_quality(C("source_tier"), C("apply_url"), C("notice_url"), C("source"))).alias("quality"),
    )


def domestic_sql(loc: str, source: str) -> str:
    place = S.blank(S.clean(loc))
    s = f"lower({S.clean(source)})"
    trusted = f"{S.rx(s, provenance.TRUSTED)} or {S.rx(s, '中国企业官方招聘|招聘官网|国家大学生就业|高校就业网')}"
    return f"(not {S.rx(place, vocab.OVERSEAS)} and ({trusted} or {S.rx(place, '|'.join(vocab.CITIES))} or {S.rx(place, vocab.HOME_COUNTRY)}))"


def domestic_app_sql(loc: str, label: str) -> str:
    return (
        f"(not {S.rx(loc, vocab.OVERSEAS)} and ({S.rx(label, '(?i)中国企业官方招聘|招聘官网|官方招聘|direct-official')} "
        f"or {S.rx(loc, '|'.join(vocab.CITIES))} or {S.rx(loc, r'(?i)中国|china|cn\b')}))"
    )


@posting_check("is_domestic", f"{domestic_sql('location', 'source')}::bigint as domestic, {domestic_app_sql('location', 'source_label')}::bigint as domestic_app")
def is_domestic(spark, sf):
    df = fixtures.postings(spark, sf)
    return df.select(
        "ord",
        big(provenance.is_domestic(C("location"), C("source"))).alias("domestic"),
        big(provenance.is_domestic_app(C("location"), C("source_label"))).alias("domestic_app"),
    )


CAREER_BLOB = S.norm(S.joined("role", "batch", "graduation", "jd"))


@posting_check(
    "career_flags",
    f"{S.rx(CAREER_BLOB, vocab.CAMPUS)}::bigint as campus, {S.rx(CAREER_BLOB, vocab.INTERN)}::bigint as intern, "
    f"{S.rx(CAREER_BLOB, vocab.SENIOR)}::bigint as senior, {S.rx(CAREER_BLOB, vocab.SOCIAL)}::bigint as social, "
    f"case when {S.rx(S.joined('role', 'jd', 'batch', 'graduation'), vocab.V6_EARLY)} then 'early' "
    f"when {S.rx('role', vocab.V6_SENIOR_TITLE)} or {S.rx(S.joined('role', 'jd', 'batch', 'graduation'), vocab.V6_SENIOR_TEXT)} then 'senior' else 'unknown' end as level",
)
def career_flags(spark, sf):
    flags = signals.career_flags(C("role"), C("batch"), C("graduation"), C("jd"))
    df = fixtures.postings(spark, sf).withColumn("f", flags)
    level = signals.career_level(C("role"), text.joined(C("role"), C("jd"), C("batch"), C("graduation")))
    return df.select("ord", *[big(C(f"f.{k}")).alias(k) for k in ("campus", "intern", "senior", "social")], level.alias("level"))


TITLE_CITY_SQL = f"list_filter({S.arr(vocab.TITLE_CITIES)}, lambda c: contains(role, c))[1]"


def role_without_city_sql(x: str) -> str:
    out = f"trim({x})"
    for city in vocab.TITLE_CITIES:
        out = f"trim(regexp_replace({out}, {S.q(rf'[\s\-—–·（）()]*{city}[\s）)]*$')}, ''))"
    return f"lower({S.clean(out)})"


PLACE_TEXT = S.joined("location", "role", "jd")


@posting_check(
    "places",
    f"array_to_string(list_filter({S.arr(vocab.CITIES)}, lambda c: contains({PLACE_TEXT}, c))[1:8], '/') as listed, "
    f"""coalesce((select string_agg(city, '/' order by pos) from (select city, min(i) as pos from (select unnest(found) as city, generate_subscripts(found, 1) as i
      from (select regexp_extract_all({PLACE_TEXT}, {S.q('|'.join(vocab.CARD_CITIES))}) as found)) group by city order by pos limit 6)), '') as in_order, """
    f"coalesce(nullif(trim(location), ''), {TITLE_CITY_SQL}, '') as city, {S.blank(role_without_city_sql('role'))} as bare_role",
)
def places(spark, sf):
    df = fixtures.postings(spark, sf)
    blob = text.joined(C("location"), C("role"), C("jd"))
    return df.select(
        "ord",
        blank(signals.places_listed(blob)).alias("listed"),
        blank(signals.places_in_order(blob)).alias("in_order"),
        blank(signals.inferred_city(C("location"), C("role"))).alias("city"),
        blank(signals.role_without_city(C("role"))).alias("bare_role"),
    )


def number_sql(x: str) -> str:
    return f"case when {x} = floor({x}) then cast(cast({x} as bigint) as string) else cast({x} as string) end"


SALARY_SQL = (
    f"coalesce({number_sql('salary_low')} || '-' || {number_sql('salary_high')} || 'K/月', "
    f"{number_sql('coalesce(salary_low, salary_high)')} || 'K/月', '')"
)


@posting_check("salary_join_names", f"{SALARY_SQL} as salary, concat_ws('/', {S.clean('industry')}, nullif({S.clean('department')}, {S.clean('industry')})) as names")
def salary_join_names(spark, sf):
    df = fixtures.postings(spark, sf)
    names = F.array(C("industry"), C("department"), C("industry"), F.lit(" "))
    return df.select(
        "ord",
        blank(signals.salary_text(C("salary_low"), C("salary_high"))).alias("salary"),
        blank(text.ordered_join(names)).alias("names"),
    )


def entities_sql(x: str) -> str:
    for entity, char in text.ENTITIES:
        x = f"replace({x}, {S.q(entity)}, {S.q(char)})"
    return x


STRIP_SQL = "regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</(?:p|li|div|h[1-6])>', chr(10), 'g')"
STRIP_SQL = entities_sql(f"regexp_replace({STRIP_SQL}, '<[^>]+>', ' ', 'g')")
STRIP_SQL = f"regexp_replace(regexp_replace(regexp_replace({STRIP_SQL}, '[ \\t]+', ' ', 'g'), '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@CHECKS.add("strip_html", f"select page_id, {STRIP_SQL} as body from pages")
def strip_html(spark, sf):
    return fixtures.table(spark, sf, "pages").select("page_id", blank(text.strip_html(C("html"))).alias("body"))


COMPLETE_SQL = (
    "least(3, case when length(trim(jd)) >= 220 then 2 when length(trim(jd)) >= 80 then 1 else 0 end + case when trim(apply_url) <> '' then 1 else 0 end)"
)


@posting_check("completeness", f"{COMPLETE_SQL}::bigint as complete, (length(trim(jd)) < 70)::bigint as sparse")
def completeness(spark, sf):
    df = fixtures.postings(spark, sf)
    return df.select("ord", big(signals.completeness(C("jd"), C("apply_url"))).alias("complete"), big(signals.is_sparse(C("jd"))).alias("sparse"))
