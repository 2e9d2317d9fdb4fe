"""Domain views over the driver's tables.

The tables hold orders, parts and texts; these views read them as postings,
résumés, stage events and so on. The statements use only syntax Spark and
DuckDB share, so the checking SQL starts from the very same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .session import dealt, spread
from .taxonomy import Domain, Taxonomy

AS_OF = "2001-07-15"
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

POSTINGS = """
select o_orderkey as ord,
  'job-' || cast(o_orderkey as string) as id,
  case o_orderkey % 4 when 1 then s_name || '有限公司' when 2 then s_name || '集团 股份有限公司'
    when 3 then '  ' || upper(s_name) else s_name end as company,
  p_name || case s_suppkey % 9 when 0 then ' 工程师' when 1 then ' 实习生' when 2 then ' 资深专家'
    when 3 then ' 工程师-北京' when 4 then ' graduate engineer' when 5 then ' 产品经理（上海）'
    when 6 then ' campus  intern' else '' end as role,
  case when o_orderkey % 11 = 0 then '' else p_brand end as department,
  p_type as industry,
  case s_suppkey % 7 when 0 then '北京' when 1 then '上海 深圳' when 2 then '杭州/北京' when 3 then ''
    when 4 then r_name when 5 then 'Singapore' else '深圳' end as location,
  case o_orderpriority when '1-URGENT' then '2027校园招聘' when '2-HIGH' then '校招' when '3-MEDIUM' then '社会招聘'
    when '4-NOT SPECIFIED' then '' else '公开招聘' end as batch,
  case o_orderkey % 5 when 0 then '2027届' when 1 then '2026届' else '' end as graduation,
  case s_nationkey % 5 when 0 then '本科及以上' when 1 then '硕士' when 2 then '博士' when 3 then 'Bachelor' else '' end as education,
  case n_nationkey % 3 when 0 then '国有企业' when 1 then '民营企业' else '外资企业' end as company_type,
  case when o_orderkey % 6 = 0 then null else cast(floor(o_totalprice / 1000) as double) / 2 end as salary_low,
  case when o_orderkey % 8 = 0 then null else cast(floor(o_totalprice / 1000) as double) / 2 + 5 end as salary_high,
  case o_orderkey % 10 when 0 then 'direct-official:acme' when 1 then 'direct-official:globex'
    when 2 then 'priority-official:initech' when 3 then 'priority-campaign:hooli' when 4 then 'ncss-public:2027'
    when 5 then 'campus-discovery:university' when 6 then 'priority-discovery:sasac' when 7 then 'ats:lever:stark'
    when 8 then 'remote-board:umbrella' else 'china-official:wayne' end as source,
  case o_custkey % 6 when 0 then '招聘官网 · acme' when 1 then '公开聚合来源' when 2 then '国资委公告' when 3 then ''
    when 4 then '高校就业网' else '企业官方招聘 feed' end as source_label,
  'https://www.source' || cast(o_orderkey % 10 as string) || '.example.com/list' as source_url,
  case when o_orderkey % 10 < 7 then cast(1 + o_orderkey % 7 as int) end as source_tier,
  case o_custkey % 8
    when 0 then ''
    when 1 then 'https://jobs.lever.co/Tenant' || cast(s_suppkey as string) || '/' || cast(part_no as string) || '?lever-source=x'
    when 2 then 'https://acme.jobs.feishu.cn/campus/position/' || cast(part_no as string) || '/detail?project=7&utm_source=x'
    when 3 then 'https://boards.greenhouse.io/embed/job_app?for=t' || cast(s_suppkey as string) || '&token=' || cast(part_no as string)
    when 4 then 'https://t' || cast(s_suppkey as string) || '.recruitee.com/o/' || cast(part_no as string)
    when 5 then 'https://www.zhipin.com/job/' || cast(part_no as string)
    when 6 then 'https://Careers.example.com//Jobs/' || cast(s_suppkey as string) || '/?utm_source=feed&id=' || cast(part_no as string) || '#top'
    else 'https://shop.example.org/' || cast(s_suppkey as string) || '/' end as apply_url,
  case when o_orderkey % 3 = 0 then 'https://notice.example.org/n/' || cast(o_custkey as string) || '/?spm=1&from=app&k=2'
    else '' end as notice_url,
  case when o_orderkey % 4 = 0 then 'P' || cast(o_custkey as string) else '' end as position_id,
  case when o_orderkey % 17 = 0 then '' else text end as jd,
  case when o_orderkey % 13 = 0 then '' else cast(cast(o_orderdate as date) as string) end as updated_at
from (select *, o_orderkey % (select count(*) from {part}) as part_no,
             o_custkey % (select count(*) from {supplier}) as supp_no,
             o_orderkey % (select count(*) from {documents}) as doc_no from {orders}) o
join {part} on p_partkey = part_no
join {supplier} on s_suppkey = supp_no
join {nation} on n_nationkey = s_nationkey
join {region} on r_regionkey = n_regionkey
join {documents} on doc_id = doc_no
"""

# One résumé per conversation turn; user turns are résumés, system turns the
# smaller set of profiles that postings are scored against.
RESUMES = """
select conv_id * 1000 + turn as profile_id,
  'cv-' || cast(conv_id as string) || case turn % 2 when 0 then '.pdf' else '.txt' end as file_name,
  case conv_id % 4
    when 0 then '张三丰' || chr(10) || '教育背景' || chr(10) || '某大学 专业 thanea 硕士 2027届 北京' || chr(10) || '专业技能' || chr(10) || 'gizmo edtion anvil' || chr(10) || text
    when 1 then '【Skills】' || chr(10) || text || chr(10) || '项目经历:' || chr(10) || 'widget gear ndble 2026 2028 anvil' || chr(10) || 'Awards' || chr(10) || 'ok'
    when 2 then text || chr(10) || 'education' || chr(10) || 'bachelor ring erlich 2028届 plate major chsch' || chr(10) || 'Experience：' || chr(10) || text
    else text end as text,
  case conv_id % 3 when 0 then '北京' when 1 then '' else '深圳' end as target_location,
  case conv_id % 5 when 0 then 'metal' else '' end as target_direction
from {conversations} where role = '@ROLE'
"""

STAGE_EVENTS = """
select event_id, user_id as job_no, ts, cast(cast(ts as date) as string) as day,
  case event_type when 'view' then case when event_id % 3 = 0 then 'discovered' else 'preparing' end
    when 'click' then 'applied' when 'signup' then case when event_id % 2 = 0 then 'interview1' else 'assessment' end
    when 'purchase' then case when event_id % 4 = 0 then 'signed' else 'offer' end
    else case when event_id % 5 = 0 then 'rejected' else 'hr' end end as status
from {events}
"""

# --- a small taxonomy over words of the driver's texts ------------------------
DEMO_TAXONOMY = Taxonomy(
    (
        Domain("metal", "Metal works", ("bolt engineer", "anvil", "gear"), ("thanea", "eriner"),
               (("thanedble", 9), ("edtion", 8), ("anvil", 8), ("gear", 6), ("atble", 7), ("ingre", 4), ("estion", 5))),
        Domain("gadget", "Gadget design", ("gizmo", "widget designer"), ("threen", "hation"),
               (("gizmo", 9), ("widget", 8), ("ndble", 7), ("hetion", 6), ("inble", 5), ("ingor", 3), ("attion", 7))),
        Domain("plating", "Plate / ring craft", ("plate", "ring", "engineer"), ("thatin",),
               (("plate", 8), ("ring", 5), ("heble", 7), ("ndtion", 6), ("hable", 7), ("ating", 5), ("ating on", 9))),
        Domain("office", "Office support", ("intern", "campus", "实习生"), ("ereden",),
               (("eding", 7), ("haing", 5), ("ining", 6), ("intion", 8), ("python", 6), ("rod", 4))),
        Domain("legal-de", "Recht", ("专家",), ("chsch", "einlich"),
               (("enkeit", 9), ("erlich", 7), ("erung", 6), ("einbe", 7), ("nicht", 5), ("chver", 8))),
        Domain("trade-de", "Handel", ("产品经理",), ("einau",),
               (("enheit", 8), ("erber", 7), ("enlich", 6), ("erung", 5), ("schie", 9))),
        Domain("vin-fr", "Vin", ("工程师",), ("enelle",),
               (("éelle", 8), ("ément", 7), ("ouque", 6), ("queque", 7), ("leaux", 9))),
        Domain("mode-fr", "Mode", ("产品",), ("aiaux",),
               (("étion", 8), ("outre", 7), ("oueau", 6), ("lement", 5), ("éelle", 3))),
        Domain("campo-es", "Campo", ("资深专家",), ("asado",),
               (("ciónas", 8), ("ciónll", 7), ("domente", 9), ("ciónmi", 6))),
        Domain("mar-es", "Mar", ("graduate",), ("osque",),
               (("ciónes", 8), ("ciónra", 7), ("doción", 9), ("queci", 6), ("ciónas", 3))),
    ),
    frozenset({("metal", "plating"), ("gadget", "office"), ("legal-de", "trade-de"), ("vin-fr", "mode-fr"), ("campo-es", "mar-es"), ("gadget", "plating")}),
)
# Aliases a company is searched under, and a registry of official sources.
DEMO_ALIASES = {"supplier#000000007": ["supplier#000000007", "lucky seven", "s7"], "supplier#000000012": ["supplier#000000012", "dozen"]}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def _sql(spark: SparkSession, sf_dir: str, text: str, names: list[str], share=spread) -> DataFrame:
    """Run a view; the first table named drives it and is spread over the cores."""
    frames = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    frames[names[0]] = share(frames[names[0]])
    return spark.sql(text, **frames)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, POSTINGS, ["orders", "part", "supplier", "documents", "nation", "region"], dealt)


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, RESUMES.replace("@ROLE", "user"), ["conversations"])


def personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, RESUMES.replace("@ROLE", "system"), ["conversations"])


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, STAGE_EVENTS, ["events"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
