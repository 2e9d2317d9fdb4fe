"""The fit score of a profile and a posting, with its evidence confidence.

Functions over a frame of pairs (``features.candidate_pairs``). Direction and
skill points are exact integers (tenths, ten-thousandths) until the end.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import once, one_decimal, round_half_up
from ..taxonomy import Taxonomy
from .tallies import Part, counted

C = F.col
#: Words in common: their weight (``skill_hit``) and number, as pairs of ``features.all_pairs`` come with them.
TALLIES = {
    "skill_hit": [p for w in (35, 170, 125, 100) for p in (Part(f"sk_{w}", "all_ids", w * 100), Part(f"sk_{w}", "title_ids", w * 65))] + [Part("kw", "all_ids", 2800)],
    "words_met": [Part(f"sk_{w}", "all_ids", 1) for w in (35, 170, 125, 100)] + [Part("kw", "all_ids", 1)],
}


def overlap(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_intersect(a, b))


def domain_fit(pairs: DataFrame) -> DataFrame:
    """Adds direction10 (tenths of 30), exact, related, mismatch."""
    code = F.coalesce(F.greatest(*[F.get("p_codes", F.get("j_top", F.lit(k)) * 4 + k) for k in range(4)]), F.lit(0))
    out = pairs.withColumn("__code", code).withColumn("__v", F.floor(C("__code") / 100).cast("int"))
    both = (F.size("p_top") > 0) & (F.size("j_top") > 0)
    wanted = F.arrays_overlap("p_targets", "j_top")
    return out.withColumns(
        {
            "direction10": F.when(both & wanted, F.least(F.lit(300), C("__v") + 20)).otherwise(C("__v")),
            "exact": (C("__code") % 2) == 1,
            "related": C("__v") > 0,
            "mismatch": both & (C("__v") == 0) & (C("p_conf") >= 65) & (C("j_conf") >= 55),
        }
    ).drop("__code", "__v")


def skill_fit(pairs: DataFrame) -> DataFrame:
    """Adds skill_points (0..24) and skill_hits.

    Pairs come with the words in common counted, or the posting's long word list
    is met once, looked up in the profile's short one, and everything else is
    counted on the few words in common.
    """
    if "words_met" in pairs.columns:
        out = pairs.withColumn("__hit", C("skill_hit")).withColumn("skill_hits", C("words_met").cast("int"))
    else:
        found = pairs.withColumn("__all", F.array_intersect("all_ids", "p_words")).withColumn("__in_title", F.array_intersect("__all", "title_ids"))
        hit, count = F.lit(0), F.lit(0)
        for w in (35, 170, 125, 100):
            title, anywhere = overlap(f"sk_{w}", "__in_title"), overlap(f"sk_{w}", "__all")
            hit = hit + title * (w * 65) + anywhere * (w * 100)
            count = count + anywhere
        words = overlap("kw", "__all")
        out = found.withColumns({"__hit": hit + words * 2800, "skill_hits": count + words}).drop("__all", "__in_title")
    denominator = F.greatest(F.lit(5.0), F.least(F.lit(18.0), C("sk_total") / 100))
    coverage = F.least(F.lit(1.0), C("__hit") / 10000 / denominator)
    return out.withColumn("skill_points", F.least(F.lit(24.0), 24 * F.pow(coverage, F.lit(0.88)))).drop("__hit")


def career_fit(pairs: DataFrame) -> DataFrame:
    """Adds career (0..13), career_penalty and is_campus."""
    start = F.when(C("stage_points") > 0, C("stage_points")).when(C("p_year").isNotNull(), 1).otherwise(0)
    named = F.when(F.array_contains("blob_years", C("p_year")), 5).otherwise(0)
    return pairs.withColumns({"career": F.least(F.lit(13), start + named), "career_penalty": C("stage_penalty"), "is_campus": C("stage_points") > 0})


def stage_of(flags: Column) -> dict[str, Column]:
    """What a posting's career flags give and take, for every profile."""
    return {
        "stage_points": F.when(flags["campus"], 8).when(flags["intern"], 5).otherwise(0),
        "stage_penalty": F.when(flags["senior"], 20).when(flags["social"] & ~flags["campus"], 8).otherwise(0),
    }


def wanted_here(pairs: DataFrame) -> Column:
    """Whether the posting's location names a place the profile wants."""
    return counted(pairs, "here", F.exists("target_locations", lambda t: F.coalesce(C("location"), F.lit("")).contains(t)))


def place_eligibility(pairs: DataFrame) -> DataFrame:
    """Adds place (0 or 10), place_required, eligibility10 and degree_unmet."""
    required = F.size("target_locations") > 0
    here = wanted_here(pairs)
    both = (C("j_degree") > 0) & (C("p_degree") > 0)
    met = C("p_degree") >= C("j_degree")
    degree = F.when(C("j_degree") == 0, 15).when(both & met, 40).otherwise(0)
    cohort = F.when(~C("has_cohort"), 10).when(F.array_contains("cohort_years", C("p_year")), 30).otherwise(0)
    return pairs.withColumns(
        {
            "place_required": required,
            "place": F.when(here, 10).otherwise(0),
            "eligibility10": F.least(F.lit(80), degree + cohort + F.when(C("exact"), 20).otherwise(0)),
            "degree_unmet": both & ~met,
        }
    )


def score_base(pairs: DataFrame) -> DataFrame:
    """Adds base_cap and base_score from the parts above."""
    direction, eligibility = C("direction10") / 10, C("eligibility10") / 10
    pairs = pairs.withColumn("__clash", F.when(C("mismatch") & (C("p_conf") >= 75) & (C("j_conf") >= 65), 2).when(C("mismatch"), 1).otherwise(0))
    penalty = (
        C("career_penalty")
        + F.when(C("__clash") == 2, 26).when(C("__clash") == 1, 18).otherwise(0)
        + F.when(C("sparse"), 2).otherwise(0)
    )
    caps = [
        F.when(C("__clash") == 2, 38).when(C("__clash") == 1, 48).otherwise(99),
        F.when((C("direction10") < 50) & (C("skill_points") < 7) & (C("p_conf") >= 55), 48).otherwise(99),
        F.when((C("direction10") < 100) & (C("skill_points") < 10) & (C("p_conf") >= 60), 62).otherwise(99),
        F.when(C("p_year").isNotNull() & ~C("is_campus") & (C("career_penalty") > 0), 70).otherwise(99),
    ]
    elite = (
        C("exact") & (C("direction10") >= 260) & (C("skill_points") >= 15) & (C("career") >= 8) & (C("source") >= 6)
        & (~C("place_required") | (C("place") == 10))
    )
    perfect = elite & (C("skill_points") >= 20) & (C("eligibility10") >= 50) & (C("fresh") >= 4) & (C("complete") >= 2)
    caps += [F.when(~elite, 94).otherwise(99), F.when(~perfect, 98).otherwise(99)]
    raw = direction + C("skill_points") + C("career") + C("place") + eligibility + C("source") + C("fresh") + C("complete") - penalty
    return pairs.withColumns({"base_cap": F.least(*caps), "base_penalty": penalty}).withColumn(
        "base_score", F.greatest(F.lit(0.0), F.least(C("base_cap").cast("double"), one_decimal(raw)))
    ).drop("__clash")


def score_final(pairs: DataFrame) -> DataFrame:
    """Adds fit_core, cap and score: fit only, source quality left out."""
    # parts are at most 300, 24, 13 and 80, so their shares are at most 1
    d, s, c, e = C("direction10") / 10 / 30, one_decimal(C("skill_points")) / 24, C("career") / 13, C("eligibility10") / 10 / 8
    weights = [F.when(C("place_required"), placed).otherwise(free) for placed, free in ((0.42, 0.46), (0.26, 0.28), (0.14, 0.16), (0.08, 0.10), (0.10, 0.0))]
    summed = reduce(add, [part * weight for part, weight in zip((d, F.sqrt(s), c, e, C("place") / 10), weights)])
    fit = F.least(F.lit(1.0), summed)
    weak, distant = C("direction10") < 180, C("direction10") < 120
    conflict = C("p_year").isNotNull() & (F.size("any_years") > 0) & ~F.coalesce(F.array_contains("any_years", C("p_year")), F.lit(False))
    caps = [
        F.when(C("mismatch"), 42).when(C("base_cap") <= 48, 48).when(C("base_cap") <= 62, 66).when(C("base_cap") <= 70, 70).otherwise(99),
        F.when(C("place_required") & (C("place") == 0), 78).otherwise(99),
        F.when(C("degree_unmet"), 62).otherwise(99),
        F.when(conflict, 68).otherwise(99),
        F.when(C("skill_hits") == 0, 84).when(C("skill_hits") == 1, 89).otherwise(99),
        F.when(~C("exact") & weak & (C("skill_hits") <= 1), 50).when(~C("exact") & distant, 62).otherwise(99),
    ]
    # once: a chain of expressions this long is otherwise one method, too long for the JVM to compile
    out = once(pairs.withColumn("__fit", fit), "cap", F.least(*caps))
    score = one_decimal(F.least(C("cap").cast("double"), 15 + 84 * F.pow("__fit", F.lit(0.62))))
    return out.withColumns({"score": score, "fit_core": one_decimal(C("__fit") * 100)}).drop("__fit")


def evidence_confidence() -> Column:
    """How far the score can be trusted, as its posting's features say."""
    return C("trust")


def trust_of() -> Column:
    """Evidence confidence of a posting, for every profile: source, freshness, completeness, domain."""
    return round_half_up(
        100 * (C("source") / 7 * 0.35 + C("fresh") / 5 * 0.25 + C("complete") / 3 * 0.25 + C("j_conf") / 100 * 0.15)
    ).cast("int")


def fit_band(score: Column) -> Column:
    # --- fixed values: names of the fit bands -----------------------------
    return (
        F.when(score >= 92, "强烈推荐").when(score >= 85, "高度匹配").when(score >= 78, "值得优先").when(score >= 68, "可投 · 有缺口")
        .when(score >= 55, "谨慎评估").otherwise("低匹配")
    )


def evidence_band(confidence: Column) -> Column:
    # --- fixed values: names of the evidence bands -------------------------
    return F.when(confidence >= 85, "高可信").when(confidence >= 68, "中高可信").when(confidence >= 48, "中等可信").otherwise("证据偏弱")


def score_pairs(pairs: DataFrame) -> DataFrame:
    """All parts, the base score and the final score of every pair."""
    return score_final(score_base(place_eligibility(career_fit(skill_fit(domain_fit(pairs))))))


def explain(pairs: DataFrame, limit: int = 9) -> DataFrame:
    """Adds hits: words of the profile found, title first. For rows to be shown."""

    def named(ids: Column, n: int) -> Column:
        return F.transform(F.slice(ids, 1, n), lambda i: F.get(F.filter("p_names", lambda x: x["n"] == i), F.lit(0))["w"])

    title = F.array_intersect("sk_all", "title_ids")
    body = F.array_except(F.array_intersect("sk_all", "all_ids"), "title_ids")
    hits = F.concat(named(title, 5), named(body, 7), named(F.array_intersect("kw", "all_ids"), 5))
    return pairs.withColumn("hits", F.slice(F.array_distinct(hits), 1, limit))


def reasons(pairs: DataFrame, taxonomy: Taxonomy, limit: int = 7) -> DataFrame:
    """Adds reasons in the published wording and order; needs ``hits``."""
    names = taxonomy.names()
    mine, theirs = F.get(names, F.get("p_top", F.lit(0))), F.get(names, F.get("j_top", F.lit(0)))
    # --- fixed values: wording of the reasons --------------------------------
    domain = (
        F.when(C("exact"), F.concat(mine, F.lit(" · 岗位领域直接匹配")))
        .when(C("related"), F.concat(mine, F.lit(" · 相邻职业领域")))
        .when(C("mismatch"), F.concat(mine, F.lit(" ↔ "), theirs, F.lit(" 领域冲突")))
        .otherwise("职业领域证据较弱")
    )
    f = C("flags")
    dated = F.coalesce(F.array_contains("blob_years", C("p_year")), F.lit(False))
    career = (
        F.when(f["senior"], "资深/经验要求冲突").when(f["social"] & ~f["campus"], "社会招聘")
        .when(dated, F.concat(C("p_year"), F.lit("届符合"))).when(f["campus"], "校招 / 应届").when(f["intern"], "实习")
    )
    degree = F.when(C("degree_unmet"), "学历可能不满足").when((C("j_degree") > 0) & (C("p_degree") > 0), "学历满足")
    place = F.when(C("place") > 0, "目标城市")
    source = F.get(
        F.lit(["公开聚合来源", "公开聚合来源", "公开聚合来源", "高校就业网发现", "国家就业平台", "权威/已验证招聘来源", "企业官方招聘源", "企业官网直连"]),
        C("source"),
    )
    skills = F.when(F.size("hits") > 0, F.concat(F.lit("技能 "), F.array_join(F.slice("hits", 1, 3), " · ")))
    listed = F.array_compact(F.array(domain, skills, career, place, degree, source))
    return pairs.withColumn("reasons", F.slice(F.array_distinct(listed), 1, limit))
