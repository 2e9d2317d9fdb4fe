"""Column functions on literal rows of our own making, Chinese text included."""

from pyspark.sql import functions as F

from jobweave import vocab
from jobweave.functions import dates, signals, text, urls
from jobweave.operators import pages


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


def test_text(spark):
    assert one(spark, lambda c: text.compact_text(c, 40), "\t brass　 fittings \r\n and   valves ") == "brass fittings and valves"
    long = "turbine blade " * 50
    assert one(spark, lambda c: text.compact_text(c, 31), long) == long[:31].rstrip() + "…"
    assert one(spark, text.compact_text, long) == long.strip()
    assert one(spark, text.canonical_company, "海星集团股份有限公司") == "海星"
    assert one(spark, text.strip_html, "<h2>x</h2><i>y &lt; z</i>").split() == ["x", "y", "<", "z"]


def test_dates(spark):
    for raw in ("2025年3月9日", "2025/03/09", "2025.3.9 23:59", "2025-03-09T00:00:01Z", "1741478400", "1741478400000"):
        assert str(one(spark, dates.parse_date, raw)) == "2025-03-09", raw
    assert one(spark, dates.parse_date, "2025-02-30") is None
    assert one(spark, lambda c: dates.age_days(dates.parse_date(c), "2025-03-12"), "2025-03-09") == 3
    assert one(spark, lambda c: dates.age_days(dates.parse_date(c), "2025-03-01"), "2025-03-09") == 0
    assert one(spark, lambda c: dates.age_days(dates.parse_date(c), "2025-03-01"), "n/a") == 999


def test_cohorts(spark):
    assert one(spark, signals.infer_graduation, "招收2026届学生") == "2026届"
    assert one(spark, signals.infer_graduation, "26届提前批") == "2026届"
    assert one(spark, signals.infer_graduation, "founded in 2027") is None
    assert one(spark, signals.graduation_year, "2025 实践, 2026届, 2028") == "2026"
    assert one(spark, signals.infer_degree, "大专以上，博士优先") == "博士"


def test_board_roots(spark):
    """A board's root is its tenant on a shared host, whatever position follows."""
    for tenant in ("north-mill", "Quay7"):
        for position in ("aa-bb-01", "77", "tool-maker"):
            assert one(spark, urls.board_root, f"https://jobs.lever.co/{tenant}/{position}") == f"https://jobs.lever.co/{tenant}"
            assert one(spark, urls.board_root, f"https://jobs.ashbyhq.com/{tenant}/{position}/application") == f"https://jobs.ashbyhq.com/{tenant}"
    plain = "https://www.tidewater.example/vacancies/7"
    assert one(spark, urls.board_root, plain) == plain
    keys = {one(spark, lambda c: urls.board_key(F.lit("某公司"), c), f"https://t9.jobs.feishu.cn/campus/position/{n}/detail") for n in (5, 6, 7)}
    assert len(keys) == 1


def test_source_urls(spark):
    kept = one(spark, urls.source_url, "https://t9.jobs.feishu.cn/88/?project=3&utm_medium=mail")
    assert "project=3" in kept and "utm_medium" not in kept
    assert one(spark, urls.source_url, "https://www.zhipin.com/x/y") is None


def test_roles_and_titles(spark):
    assert one(spark, lambda c: signals.looks_like_role(c, strict=True), "船舶结构设计工程师")
    assert not one(spark, lambda c: signals.looks_like_role(c, strict=True), "返回首页")
    assert one(spark, lambda c: pages.role_from_block(F.lit("返回首页"), c), "返回首页\n桥梁检测工程师\n武汉") == "桥梁检测工程师"
    many = "\n".join(["首页"] * 40 + ["桥梁检测工程师"])
    assert one(spark, lambda c: pages.role_from_block(F.lit("返回首页"), c), many) == "桥梁检测工程师"
    assert one(spark, lambda c: pages.company_from_title(c), "校招：海星船厂2027届校园招聘") == "海星船厂"
    assert one(spark, signals.role_without_city, "质检工程师（武汉）") == "质检工程师"


def test_fast_space(spark):
    """The pattern Spark uses for white space finds the runs of the published one, whatever stands beside them."""
    odd = [chr(i) for i in (*range(1, 0x300), *range(0x1670, 0x1690), *range(0x1FF0, 0x2070), *range(0x2FF0, 0x3010))]
    texts = [t for c in odd for t in (c, f"a{c}b {c} c", f" {c}{c}d  e f", f"g{c} h {c}")]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    slow = F.regexp_replace("v", vocab.SPACE, " ")
    assert df.filter(slow != F.col("v")).count() > 100
    assert df.filter(slow != F.regexp_replace("v", vocab.SPACE_FAST, " ")).isEmpty()
    assert df.filter(F.regexp_replace("v", f"[{vocab.DASHES}]", "-") != F.regexp_replace("v", vocab.DASHES_FAST, "-")).isEmpty()
