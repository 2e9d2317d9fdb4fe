"""Signals read from text: roles, cohorts, degrees, places, career flags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab
from .text import clean, has, joined, let, low_has, nonblank, norm, normal


def looks_like_role(c: Column, strict: bool = False) -> Column:
    def test(text: Column) -> Column:
        ok = F.length(text).between(2, 140) & ~text.rlike(vocab.ROLE_NOISE)
        ok = ok & ~text.rlike("^[0-9]+$") & ~text.rlike(r"^[^\p{L}\p{N}]+$")
        return ok & text.rlike(vocab.ROLE_WORD) if strict else ok

    return F.coalesce(let(clean(c), test), F.lit(False))


def infer_graduation(c: Column) -> Column:
    """Written cohort, two-digit cohort, or a bare year beside a campus word."""
    long = F.regexp_extract(c, rf"(^|[^0-9])({vocab.COHORT_YEAR})\s*届", 2)
    short = F.regexp_extract(c, r"(^|[^0-9])(2[4-9]|3[0-9])\s*届", 2)
    bare = F.regexp_extract(c, rf"(^|[^\p{{L}}\p{{N}}_])({vocab.COHORT_YEAR})($|[^\p{{L}}\p{{N}}_])", 2)
    return (
        F.when(long != "", F.concat(long, F.lit("届")))
        .when(short != "", F.concat(F.lit("20"), short, F.lit("届")))
        .when((bare != "") & c.rlike(vocab.COHORT_HINT), F.concat(bare, F.lit("届")))
    )


def cohort_years(c: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({vocab.COHORT_YEAR})"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def graduation_year(c: Column) -> Column:
    """First year written as a cohort, else the latest year."""
    years = cohort_years(c)
    written = F.filter(years, lambda y: c.contains(F.concat(y, F.lit("届"))))
    return F.coalesce(F.get(written, F.lit(0)), F.try_element_at(years, F.lit(-1)))


def infer_degree(c: Column) -> Column:
    def read(low: Column) -> Column:
        return (
            F.when(low.contains("博士") | low.contains("phd"), "博士")
            .when(low.contains("硕士"), "硕士").when(low.contains("研究生"), "研究生").when(low.contains("master"), "硕士")
            .when(low.contains("本科"), "本科").when(low.contains("学士"), "学士").when(low.contains("bachelor"), "本科")
            .when(low.contains("大专"), "大专").when(low.contains("专科"), "专科")
        )

    return let(norm(c), read)


def first_degree(c: Column) -> Column:
    """Rank of the first degree word in ascending order, 0 when none."""
    low = norm(c)
    # --- fixed values: order in which degree words are tried ----------------
    tried = [("大专", 1), ("专科", 1), ("本科", 2), ("学士", 2), ("硕士", 3), ("研究生", 3), ("博士", 4), ("phd", 4), ("master", 3), ("bachelor", 2)]
    return F.coalesce(*[F.when(low.contains(w), r) for w, r in tried], F.lit(0))


def degree_rank(c: Column) -> Column:
    def read(low: Column) -> Column:
        return F.greatest(*[F.when(low.contains(word), rank).otherwise(0) for word, rank in vocab.DEGREES])

    return F.coalesce(let(norm(c), read), F.lit(0))


def campaign_batch(title: Column) -> Column:
    return (
        F.when(title.contains("实习"), "2027实习/人才储备").when(title.contains("秋招"), "2027秋招").otherwise("2027校园招聘")
    )


def platform_batch(visible: Column, role: Column, explicit: Column) -> Column:
    """An unknown cohort is labelled unconfirmed, never invented."""
    return (
        F.when(explicit | has(visible, vocab.TARGET_YEAR), "2027校园招聘")
        .when(has(role, vocab.CAMPUS_FEED), "校园/实习招聘·年份待确认")
        .otherwise("当前公开岗位·年份待确认")
    )


def cohort_batch(blob: Column, commitment: Column) -> Column:
    cohort = infer_graduation(blob)
    kind = clean(commitment)
    dated = F.concat(cohort, F.lit("校园招聘"), F.coalesce(F.concat(F.lit(" · "), kind), F.lit("")))
    return F.when(cohort.isNotNull(), dated).when(has(blob, vocab.CAMPUS), "校园招聘").otherwise(kind)


def career_flags(role: Column, batch: Column, graduation: Column, jd: Column) -> Column:
    def read(blob: Column) -> Column:
        return F.struct(
            low_has(blob, vocab.CAMPUS).alias("campus"),
            low_has(blob, vocab.INTERN).alias("intern"),
            low_has(blob, vocab.SENIOR).alias("senior"),
            low_has(blob, vocab.SOCIAL).alias("social"),
        )

    return let(normal(joined(role, batch, graduation, jd)), read)


def career_level(role: Column, text: Column) -> Column:
    """'early', 'senior' or 'unknown' as the sixth scorer reads it."""

    def read(t: Column) -> Column:
        senior = has(t["role"], vocab.V6_SENIOR_TITLE) | low_has(t["low"], vocab.V6_SENIOR_TEXT, t["text"])
        return F.when(low_has(t["low"], vocab.V6_EARLY, t["text"]), "early").when(senior, "senior").otherwise("unknown")

    return let(F.struct(role.alias("role"), text.alias("text"), F.lower(text).alias("low")), read)


def city_list(names: list[str]) -> Column:
    return F.array(*map(F.lit, names))


def places_listed(c: Column, names: list[str] = vocab.CITIES, limit: int = 8) -> Column:
    """Known cities of the text in list order."""
    found = let(c, lambda text: F.filter(city_list(names), lambda city: text.contains(city)))
    return nonblank(F.array_join(F.slice(found, 1, limit), "/"))


def places_in_order(c: Column, names: list[str] = vocab.CARD_CITIES, limit: int = 6) -> Column:
    """Known cities in order of appearance."""

    def read(text: Column) -> Column:
        held = F.lit(False)
        for name in names:
            held = held | text.contains(name)
        found = F.regexp_extract_all(text, F.lit("(" + "|".join(names) + ")"), F.lit(1))
        return F.when(held, F.array_join(F.slice(F.array_distinct(found), 1, limit), "/"))

    # Names hold no space, so the text needs no cleaning.
    return let(F.coalesce(c, F.lit("")), read)


def inferred_city(location: Column, title: Column) -> Column:
    first = F.get(F.filter(city_list(vocab.TITLE_CITIES), lambda city: title.contains(city)), F.lit(0))
    return F.coalesce(nonblank(F.trim(location)), first)


def role_without_city(title: Column) -> Column:
    """Title with a trailing city cut, trying each city once in list order."""
    out = F.trim(title)
    for city in vocab.TITLE_CITIES:
        out = F.trim(F.regexp_replace(out, rf"[\s\-—–·（）()]*{city}[\s）)]*$", ""))
    return F.lower(clean(out))


def salary_text(low: Column, high: Column) -> Column:
    def number(c: Column) -> Column:
        short = F.regexp_replace(F.format_string("%.4f", c.cast("double")), r"\.?0+$", "")
        return F.when(c == F.floor(c), F.floor(c).cast("string")).when(c.isNotNull(), short)

    both = F.concat(number(low), F.lit("-"), number(high), F.lit("K/月"))
    return F.coalesce(both, F.concat(number(F.coalesce(low, high)), F.lit("K/月")))


def completeness(jd: Column, apply_url: Column) -> Column:
    size = F.coalesce(F.length(F.trim(jd)), F.lit(0))
    body = F.when(size >= 220, 2).when(size >= 80, 1).otherwise(0)
    return F.least(F.lit(3), body + F.when(clean(apply_url).isNotNull(), 1).otherwise(0))


def is_sparse(jd: Column, below: int = 70) -> Column:
    return F.coalesce(F.length(F.trim(jd)), F.lit(0)) < below
