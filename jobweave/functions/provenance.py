"""Where a listing came from: display class, tier, priority, quality."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab
from .text import clean, has, joined, let, norm

# --- fixed values: display classes of provenance prefixes ---------------------
DIRECT = "企业招聘官网 · 自主直连"
CAMPAIGN = "重点企业 2027 招聘源"
PLATFORM = "国家大学生就业服务平台 · 2027招聘"
UNIVERSITY = "高校就业网 · 2027招聘发现"
STATE = "央企官方招聘发现"
FEDERATION = "中国企业官方招聘"
BOARD = "企业官方 ATS"
REMOTE = "公开远程招聘板"
PUBLIC = "公开招聘来源"
# --- fixed values: trusted prefixes of a domestic source ----------------------
TRUSTED = "^(direct-official:|priority-official:|priority-campaign:|priority-discovery:|ncss-public:|campus-discovery:university|china-official)"


def source_class(source: Column, label: Column) -> Column:
    s = F.coalesce(F.lower(clean(source)), F.lit(""))
    short = F.substring(clean(label), 1, 40)

    def named(default: str) -> Column:
        return F.coalesce(short, F.lit(default))

    return (
        F.when(s.startswith("direct-official:"), named(DIRECT))
        .when(s.rlike("^priority-(official|campaign):"), named(CAMPAIGN))
        .when(s.startswith("ncss-public:"), PLATFORM)
        .when(s.startswith("campus-discovery:university"), named(UNIVERSITY))
        .when(s.startswith("priority-discovery:sasac"), named(STATE))
        .when(s.startswith("china-official"), FEDERATION)
        .when(s.startswith("ats:"), BOARD)
        .when(s.startswith("remote-board"), REMOTE)
        .otherwise(named(PUBLIC))
    )


def source_tier(source: Column, label: Column, existing: Column | None = None) -> Column:
    s = F.coalesce(F.lower(clean(source)), F.lit(""))
    blob = F.concat(s, F.lit(" "), F.coalesce(F.lower(clean(label)), F.lit("")))
    derived = (
        F.when(s.startswith("direct-official:") | blob.rlike("自主直连|招聘官网"), 7)
        .when(s.rlike("^(priority-official:|china-official|ats:)") | blob.rlike("企业官方招聘|企业官方 ats"), 6)
        .when(s.startswith("priority-campaign:"), 5)
        .when(s.startswith("priority-discovery:sasac") | blob.contains("国资委"), 5)
        .when(s.startswith("ncss-public:") | blob.contains("国家大学生就业"), 4)
        .when(s.startswith("campus-discovery:university") | blob.contains("高校就业网"), 3)
        .otherwise(1)
    )
    if existing is None:
        return derived
    clamped = F.greatest(F.lit(1), F.least(F.lit(7), existing.cast("int")))
    return F.when(existing.isNotNull(), clamped).otherwise(derived)


# --- fixed values: what labels and links say about a source, best first --------
SCORE_WORDS = [
    (7, "direct-official|自主直连|招聘官网|mokahr"), (6, r"企业官方|官方招聘|feishu|beisen|zhiye\.com"),
    (5, "国资委|sasac|政府|官方公告"), (4, "国家大学生就业|ncss"), (3, "高校就业"),
]
SCORE_WORDS_V9 = [
    (7, "direct-official|自主直连|招聘官网"), (6, r"企业官方|官方招聘|官方 ats|feishu|beisen|zhiye\.com"),
    (5, "国资委|sasac|政府|官方公告"), (4, "国家大学生就业|ncss"), (3, "校园就业|高校就业网|高校就业"),
]


def source_score(tier: Column, *texts: Column, words: list[tuple[int, str]] = SCORE_WORDS) -> Column:
    """The tier when it is at least 3, else what the labels and links say."""

    def read(blob: Column) -> Column:
        out = F.lit(1)
        for points, pattern in reversed(words):
            out = F.when(blob.rlike(pattern), points).otherwise(out)
        return out

    by_text = let(F.coalesce(norm(joined(*texts)), F.lit("")), read)
    return F.when(tier >= 3, F.least(tier, F.lit(7))).otherwise(by_text)


def source_priority(source: Column) -> Column:
    s = F.coalesce(F.lower(source), F.lit(""))
    return (
        F.when(s.startswith("direct-official:") | s.contains("招聘官网"), 145)
        .when(s.startswith("priority-official:"), 135)
        .when(s.startswith("priority-campaign:"), 110)
        .when(s.startswith("china-official") | s.contains("中国企业官方招聘"), 95)
        .when(s.startswith("ncss-public:") | s.contains("国家大学生就业"), 80)
        .when(s.startswith("priority-discovery:sasac") | s.contains("国资委"), 72)
        .when(s.startswith("campus-discovery:university") | s.contains("高校就业网"), 65)
        .when(s.startswith("ats:") | s.contains("企业官方 ats"), 55)
        .otherwise(0)
    )


def source_quality(tier: Column, apply_url: Column, notice_url: Column, source: Column) -> Column:
    official = has(F.lower(clean(source)), "direct-official|官网|官方|moka|beisen|feishu|iguopin")
    return (
        F.coalesce(tier, F.lit(0)) * 10
        + F.when(clean(apply_url).isNotNull(), 8).otherwise(0)
        + F.when(clean(notice_url).isNotNull(), 2).otherwise(0)
        + F.when(official, 6).otherwise(0)
    )


def is_domestic(location: Column, source: Column) -> Column:
    loc = F.coalesce(clean(location), F.lit(""))
    s = F.coalesce(F.lower(clean(source)), F.lit(""))
    trusted = s.rlike(TRUSTED) | s.rlike("中国企业官方招聘|招聘官网|国家大学生就业|高校就业网")
    at_home = loc.rlike("|".join(vocab.CITIES)) | loc.rlike(vocab.HOME_COUNTRY)
    return ~loc.rlike(vocab.OVERSEAS) & (trusted | at_home)


def is_domestic_app(location: Column, label: Column) -> Column:
    """The market view's variant: official labels, cities or country words."""
    loc = F.coalesce(location, F.lit(""))
    src = F.coalesce(label, F.lit(""))
    home = src.rlike("(?i)中国企业官方招聘|招聘官网|官方招聘|direct-official") | loc.rlike("|".join(vocab.CITIES))
    return (home | loc.rlike(r"(?i)中国|china|cn\b")) & ~loc.rlike(vocab.OVERSEAS)
