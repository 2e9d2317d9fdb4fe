"""Profiles against postings: parts of the score, ranking, search, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures, vocab
from ..fixtures import DEMO_ALIASES, DEMO_TAXONOMY as TAX
from ..operators import features, profiles as P, scoring, search
from ..plans import recommend as plan
from ..session import stage
from . import CHECKS, career_sql as K, sqlx as S
from .columns import COMPLETE_SQL, FRESH_SQL, PROVENANCE_TEXTS, big, blank, degree_sql, rank_sql, score_sql, year_sql
from .profiles import CLEAN_CV, JOB_CTES, keyword_ctes, skills_ctes

C = F.col
AS_OF = fixtures.AS_OF


def batch(spark, sf):
    people = fixtures.personas(spark, sf)

    def listed(c):
        return F.when(C(c) == "", F.array().cast("array<string>")).otherwise(F.array(C(c)))

    people = people.withColumns({"target_locations": listed("target_location"), "target_directions": listed("target_direction")})
    return features.make_batch(P.profile(people, TAX), TAX)


def pairs(spark, sf):
    b = batch(spark, sf)
    return b, features.all_pairs(features.job_features(fixtures.postings(spark, sf), b, AS_OF), b)


GENERIC = ", ".join(map(S.q, vocab.GENERIC_SKILLS))
STRONG = ", ".join(
    f"({i}, {S.q(w)})" for i in range(len(TAX.domains)) for w in dict.fromkeys(features.norm_py(t) for t in TAX.strong_terms(i))
)
NAME_ROWS = K.domains()

PEOPLE_CTES = {
    "resumes": f"select * replace ({CLEAN_CV} as text) from ({S.PERSONAS})",
    **{k: v for k, v in JOB_CTES.items()},
    "cv": f"select profile_id, coalesce({S.norm('text')}, '') as body, '' as title, coalesce({S.norm(K.major('text'))}, '') as major from resumes",
    **K.scored("cv", "profile_id", 14),
    **skills_ctes("cv", "cv_top", "profile_id"),
    **keyword_ctes("resumes", "profile_id"),
    "names": NAME_ROWS,
    "edges": K.edges(),
    "strong_words": f"select * from (values {STRONG}) t(d, w)",
    "person": f"""select profile_id, {year_sql('text')} as p_year, {rank_sql('text')} as p_degree, {degree_sql('text')} as p_degree_name, target_location, target_direction,
      coalesce((select confidence from cv_top t where t.profile_id = r.profile_id and i = 0), 0) as p_conf,
      coalesce((select d from cv_top t where t.profile_id = r.profile_id and i = 0), -1) as p_first from resumes r""",
    "skill": f"""select s.profile_id, {S.norm('term')} as w, s.n, case when {S.norm('term')} in ({GENERIC}) then 35
      when exists (select 1 from strong_words x where x.d = p.p_first and x.w = {S.norm('term')}) then 170 when length({S.norm('term')}) >= 7 then 125 else 100 end as w100
      from skill_list s join person p on p.profile_id = s.profile_id where s.n <= 64 and length({S.norm('term')}) >= 2""",
    "skill_total": "select profile_id, sum(w100) as total from skill group by profile_id",
    "kw": f"select profile_id, {S.norm('word')} as w, n from ranked_words where n <= 40 and length({S.norm('word')}) >= 3 and {S.norm('word')} not in ({GENERIC})",
    "posting_text": f"select ord, coalesce({S.norm('role')}, '') as title, coalesce({S.norm(S.joined('jd', 'department', 'industry'))}, '') as body from postings",
    "vocabulary": "select distinct w from (select w from skill union all select w from kw)",
    "word_hit": "select ord, w, contains(title, w) as in_title from posting_text, vocabulary where contains(title, w) or contains(body, w)",
    "pair_grid": """select profile_id, ord, p.i as pi, j.i as ji, p.d = j.d as same, case when p.d = j.d then 300 - 45 * p.i - 40 * j.i else 140 - 22 * p.i - 20 * j.i end as v
      from cv_top p join edges on p.d = a join job_top j on j.d = b where p.i < 4 and j.i < 4""",
    "best_pair": "select * from pair_grid qualify row_number() over (partition by profile_id, ord order by v desc, pi, ji) = 1",
    "pair": "select p.profile_id, o.ord, coalesce(same, false) as same, coalesce(v, 0) as v from person p cross join postings o left join best_pair b on b.profile_id = p.profile_id and b.ord = o.ord",
    "wanted": f"""select distinct profile_id, ord from person p, job_top j join names using (d) where j.i < 4 and target_direction <> ''
      and p_first >= 0 and (contains(lower(name), lower(target_direction)) or contains(lower(target_direction), lower(name)))""",
    "domain_part": "select profile_id, ord, same as exact, v, case when w.ord is not null then least(300, v + 20) else v end as d10 from pair left join wanted w using (profile_id, ord)",
    "skill_part": """select profile_id, ord, sum(case when in_title then w100 * 165 else w100 * 100 end) as hit, count(*) as n from skill join word_hit using (w) group by profile_id, ord""",
    "kw_part": "select profile_id, ord, count(*) as n from kw join word_hit using (w) group by profile_id, ord",
    "job_facts": f"""select ord, updated_at, location, company, {S.rx(S.norm(S.joined('role', 'batch', 'graduation', 'jd')), vocab.CAMPUS)} as campus,
      {S.rx(S.norm(S.joined('role', 'batch', 'graduation', 'jd')), vocab.INTERN)} as intern, {S.rx(S.norm(S.joined('role', 'batch', 'graduation', 'jd')), vocab.SENIOR)} as senior,
      {S.rx(S.norm(S.joined('role', 'batch', 'graduation', 'jd')), vocab.SOCIAL)} as social, {S.norm(S.joined('role', 'batch', 'graduation', 'jd'))} as blob,
      regexp_extract_all({S.joined('graduation', 'batch', 'role')}, '20[0-9][0-9]') as years, graduation, {rank_sql('education')} as j_degree,
      {score_sql('source_tier', *PROVENANCE_TEXTS)} as source, {COMPLETE_SQL} as complete, length(trim(jd)) < 70 as sparse, {S.age('updated_at')} as age,
      coalesce((select confidence from job_top t where t.ord = p.ord and i = 0), 0) as j_conf, exists (select 1 from job_top t where t.ord = p.ord) as j_first from postings p""",
    "parts": """select d.profile_id, d.ord, exact, d10, p_first >= 0 and j_first and v = 0 and p_conf >= 65 and j_conf >= 55 as mismatch, p_conf >= 75 and j_conf >= 65 as sure_both, p_year, p_degree, p_conf, target_location, f.*,
      coalesce(s.n, 0) + coalesce(k.n, 0) as hits,
      least(24.0::double, 24 * pow(least(1.0::double, (coalesce(hit, 0) + 2800 * coalesce(k.n, 0)) / 10000 / greatest(5.0::double, least(18.0::double, coalesce(total, 0) / 100))), 0.88::double)) as skill_points,
      least(13, case when campus then 8 when intern then 5 when p_year is not null then 1 else 0 end + case when contains(blob, p_year) then 5 else 0 end) as career,
      case when senior then 20 when social and not campus then 8 else 0 end as cpen,
      target_location <> '' as need_place, case when target_location <> '' and contains(location, target_location) then 10 else 0 end as place,
      least(80, case when j_degree > 0 and p_degree > 0 then case when p_degree >= j_degree then 40 else 0 end when j_degree = 0 then 15 else 0 end
        + case when p_year is not null and graduation <> '' then case when contains(graduation, p_year) then 30 else 0 end when graduation = '' then 10 else 0 end + case when exact then 20 else 0 end) as e10,
      j_degree > 0 and p_degree > 0 and p_degree < j_degree as unmet
      from domain_part d join person p using (profile_id) join job_facts f on f.ord = d.ord left join skill_total st using (profile_id)
      left join skill_part s on s.profile_id = d.profile_id and s.ord = d.ord left join kw_part k on k.profile_id = d.profile_id and k.ord = d.ord""".replace("f.*", "f.* exclude (ord)"),
    "base": f"""select *, elite and skill_points >= 20 and e10 >= 50 and fresh >= 4 and complete >= 2 as perfect from (select *, {FRESH_SQL} as fresh,
      exact and d10 >= 260 and skill_points >= 15 and career >= 8 and source >= 6 and (not need_place or place = 10) as elite from parts)""",
    "based": f"""select *, greatest(0.0::double, least(bcap::double, {S.one_dp('d10 / 10 + skill_points + career + place + e10 / 10 + source + fresh + complete - (cpen + case when mismatch and sure_both then 26 when mismatch then 18 else 0 end + case when sparse then 2 else 0 end)')})) as base_score
      from (select *, least(case when mismatch and sure_both then 38 when mismatch then 48 else 99 end, case when d10 < 50 and skill_points < 7 and p_conf >= 55 then 48 else 99 end, case when d10 < 100 and skill_points < 10 and p_conf >= 60 then 62 else 99 end,
        case when p_year is not null and not (campus or intern) and cpen > 0 then 70 else 99 end, case when elite then 99 else 94 end, case when perfect then 99 else 98 end) as bcap from base)""",
    "fitted": f"""select *, least(1.0::double, case when need_place then dd * 0.42::double + sqrt(ss) * 0.26::double + cc * 0.14::double + ee * 0.08::double + place / 10 * 0.10::double
        else dd * 0.46::double + sqrt(ss) * 0.28::double + cc * 0.16::double + ee * 0.10::double end) as fit from
      (select *, least(1.0::double, d10 / 10 / 30) as dd, least(1.0::double, {S.one_dp('skill_points')} / 24) as ss, least(1.0::double, career / 13) as cc, least(1.0::double, e10 / 10 / 8) as ee from based)""",
    "final": f"""select *, {S.one_dp('fit * 100')} as fit_core, {S.one_dp('greatest(0.0::double, least(cap::double, 15 + 84 * pow(fit, 0.62::double)))')} as score,
      floor(100 * (source / 7 * 0.35::double + fresh / 5 * 0.25::double + complete / 3 * 0.25::double + j_conf / 100 * 0.15::double) + 0.5)::bigint as sure from
      (select *, least(case when mismatch then 42 when bcap <= 48 then 48 when bcap <= 62 then 66 when bcap <= 70 then 70 else 99 end, case when need_place and place = 0 then 78 else 99 end, case when unmet then 62 else 99 end,
        case when p_year is not null and len(years) > 0 and not list_contains(years, p_year) then 68 else 99 end, case when hits = 0 then 84 when hits = 1 then 89 else 99 end,
        case when not exact and d10 < 180 and hits <= 1 then 50 when not exact and d10 < 120 then 62 else 99 end) as cap from fitted)""",
}


def with_people(body: str, **more: str) -> str:
    text = S.with_postings(body, **PEOPLE_CTES, **more)
    for name in ("cv_top", "job_top", "word_hit", "pair", "skill_list", "ranked_words", "final", "job_facts", "skill", "kw", "person", "shown", "hit_words", "chosen"):
        text = text.replace(f"\n{name} as (", f"\n{name} as materialized (")
    return text


def both(df, *cols):
    return df.select("profile_id", "ord", *cols)


@CHECKS.add("domain_fit", with_people("select profile_id, ord, d10::bigint as d10, exact::bigint as exact, mismatch::bigint as mismatch from parts"))
def domain_fit(spark, sf):
    b, p = pairs(spark, sf)
    return both(scoring.domain_fit(p), big(C("direction10")).alias("d10"), big(C("exact")).alias("exact"), big(C("mismatch")).alias("mismatch"))


@CHECKS.add("skill_fit", with_people(f"select profile_id, ord, {S.one_dp('skill_points')} as points, hits::bigint as hits from parts"))
def skill_fit(spark, sf):
    b, p = pairs(spark, sf)
    return both(scoring.skill_fit(p), scoring.one_decimal(C("skill_points")).alias("points"), big(C("skill_hits")).alias("hits"))


@CHECKS.add("career_fit", with_people("select profile_id, ord, career::bigint as career, cpen::bigint as penalty from parts"))
def career_fit(spark, sf):
    b, p = pairs(spark, sf)
    return both(scoring.career_fit(p), big(C("career")).alias("career"), big(C("career_penalty")).alias("penalty"))


@CHECKS.add("place_eligibility", with_people("select profile_id, ord, place::bigint as place, e10::bigint as e10, unmet::bigint as unmet from parts"))
def place_eligibility(spark, sf):
    b, p = pairs(spark, sf)
    df = scoring.place_eligibility(scoring.domain_fit(p))
    return both(df, big(C("place")).alias("place"), big(C("eligibility10")).alias("e10"), big(C("degree_unmet")).alias("unmet"))


@CHECKS.add("score_base", with_people("select profile_id, ord, base_score, bcap::bigint as cap from based"))
def score_base(spark, sf):
    b, p = pairs(spark, sf)
    return both(scoring.score_pairs(p), "base_score", big(C("base_cap")).alias("cap"))


@CHECKS.add("score_final", with_people("select profile_id, ord, score, cap::bigint as cap, fit_core from final"))
def score_final(spark, sf):
    b, p = pairs(spark, sf)
    return both(scoring.score_pairs(p), "score", big(C("cap")).alias("cap"), "fit_core")


BAND_SQL = """case when score >= 92 then '强烈推荐' when score >= 85 then '高度匹配' when score >= 78 then '值得优先' when score >= 68 then '可投 · 有缺口' when score >= 55 then '谨慎评估' else '低匹配' end"""
SURE_SQL = "case when sure >= 85 then '高可信' when sure >= 68 then '中高可信' when sure >= 48 then '中等可信' else '证据偏弱' end"


@CHECKS.add("evidence_bands", with_people(f"select profile_id, ord, sure, {BAND_SQL} as band, {SURE_SQL} as sure_band from final"))
def evidence_bands(spark, sf):
    b, p = pairs(spark, sf)
    df = scoring.score_pairs(p).withColumn("sure", scoring.evidence_confidence())
    return both(df, big(C("sure")).alias("sure"), scoring.fit_band(C("score")).alias("band"), scoring.evidence_band(C("sure")).alias("sure_band"))


@CHECKS.add("recommend", with_people("select profile_id, ord, score, sure from final where score >= 70"))
def recommend(spark, sf):
    df = plan.recommend(fixtures.postings(spark, sf), batch(spark, sf), AS_OF)
    return both(df, "score", big(scoring.evidence_confidence()).alias("sure"))


@CHECKS.add("recommend_fresh", with_people("select profile_id, ord, score from final where score >= 70 and (age <= 30 or age = 999)"))
def recommend_fresh(spark, sf):
    return both(plan.recommend(fixtures.postings(spark, sf), batch(spark, sf), AS_OF, fresh_only=True), "score")


HITS = """list_concat(
  (select coalesce(list(s.term order by s.n)[1:5], []) from hit_words s where s.profile_id = f.profile_id and s.ord = f.ord and s.in_title and s.kind = 0),
  (select coalesce(list(s.term order by s.n)[1:7], []) from hit_words s where s.profile_id = f.profile_id and s.ord = f.ord and not s.in_title and s.kind = 0),
  (select coalesce(list(s.term order by s.n)[1:5], []) from hit_words s where s.profile_id = f.profile_id and s.ord = f.ord and s.kind = 1))"""


HIT_CTES = {
    "hit_words": """select profile_id, ord, w, n, in_title, 0 as kind from shown join skill using (profile_id) join word_hit using (w, ord)
          union all select profile_id, ord, w, n, in_title, 1 from shown join kw using (profile_id) join word_hit using (w, ord)""",
    "placed": "select *, case when kind = 1 then 2 when in_title then 0 else 1 end as grp, row_number() over (partition by profile_id, ord, kind, case when kind = 1 then false else in_title end order by n) as r from hit_words",
    "chosen": "select profile_id, ord, w, min(grp * 1000 + r) as place from placed where r <= case grp when 1 then 7 else 5 end group by profile_id, ord, w",
    "joined": """select profile_id, ord, string_agg(w, ';' order by place) as hits from (select * from chosen qualify row_number() over (partition by profile_id, ord order by place) <= 9) group by profile_id, ord""",
}


@CHECKS.add(
    "explain_hits",
    with_people(
        "select profile_id, ord, score, coalesce(hits, '') as hits from shown left join joined using (profile_id, ord)",
        shown="select profile_id, ord, score from final where score >= 80",
        **HIT_CTES,
    ),
)
def explain_hits(spark, sf):
    b = batch(spark, sf)
    df = plan.recommend(fixtures.postings(spark, sf), b, AS_OF, threshold=80)
    return both(scoring.explain(df), "score", F.array_join("hits", ";").alias("hits"))


WORDING = """list_filter([
  case when exact then mine || ' · 岗位领域直接匹配' when v > 0 then mine || ' · 相邻职业领域' when mismatch then mine || ' ↔ ' || theirs || ' 领域冲突' else '职业领域证据较弱' end,
  case when coalesce(hits, '') <> '' then '技能 ' || array_to_string(string_split(hits, ';')[1:3], ' · ') end,
  case when senior then '资深/经验要求冲突' when social and not campus then '社会招聘' when contains(blob, p_year) then p_year || '届符合' when campus then '校招 / 应届' when intern then '实习' end,
  case when place > 0 then '目标城市' end, case when unmet then '学历可能不满足' when j_degree > 0 and p_degree > 0 then '学历满足' end,
  ['公开聚合来源', '公开聚合来源', '公开聚合来源', '高校就业网发现', '国家就业平台', '权威/已验证招聘来源', '企业官方招聘源', '企业官网直连'][source + 1]], lambda x: x is not null)"""


@CHECKS.add(
    "reasons",
    with_people(
        f"""select profile_id, ord, array_to_string(list_filter(told, lambda x, i: list_position(told, x) = i)[1:7], ';') as reasons from (select s.profile_id, s.ord, {WORDING} as told
          from shown s left join joined using (profile_id, ord) left join my_domain using (profile_id) left join their_domain using (ord) left join pair using (profile_id, ord))""",
        shown="select * exclude (hits) from final where score >= 80",
        my_domain="select t.profile_id, n.name as mine from cv_top t join names n using (d) where t.i = 0",
        their_domain="select t.ord, n.name as theirs from job_top t join names n using (d) where t.i = 0",
        **HIT_CTES,
    ),
)
def reasons(spark, sf):
    df = plan.recommend(fixtures.postings(spark, sf), batch(spark, sf), AS_OF, threshold=80)
    return both(scoring.reasons(scoring.explain(df), TAX), F.array_join("reasons", ";").alias("reasons"))


PRE_CTES = {
    "hay": f"select ord, updated_at, source_tier, coalesce({S.norm(S.joined('role', 'department', 'jd'))}, '') as hay, {S.rx(S.joined('role', 'batch', 'graduation'), vocab.QUICK_CAMPUS)} as campus, {S.age('updated_at')} as age from postings",
    "strong22": "select * from (values "
    + ", ".join(f"({i}, {S.q(w)})" for i in range(len(TAX.domains)) for w in dict.fromkeys(features.norm_py(t) for t in TAX.strong_terms(i, 22)))
    + ") t(d, w)",
    "pull": """select profile_id, w, sum(points) as points from (select profile_id, w, case when i = 0 then 4 else 2 end as points from cv_top join strong22 using (d) where i < 3
      union all select profile_id, w, 1 from skill where n <= 14 and length(w) >= 3) group by profile_id, w""",
    "affinity": "select profile_id, ord, sum(points) as pts from pull, hay where contains(hay, w) group by profile_id, ord",
    "pre": f"select p.profile_id, h.ord, h.updated_at, 10 * (coalesce(pts, 0) + case when campus and p_first >= 0 then 2 else 0 end) + greatest(1, least(7, coalesce(source_tier, 1))) * 1.5::double + {FRESH_SQL} as prerank from person p cross join hay h left join affinity a on a.profile_id = p.profile_id and a.ord = h.ord",
    "chosen_pairs": "select * from pre qualify row_number() over (partition by profile_id order by prerank desc, updated_at desc, ord) <= 2500",
}


@CHECKS.add("prerank", with_people("select profile_id, ord, prerank from chosen_pairs", **PRE_CTES))
def prerank(spark, sf):
    return both(plan.prerank_pairs(fixtures.postings(spark, sf), batch(spark, sf), AS_OF, k=2500), "prerank")


@CHECKS.add(
    "recommend_preranked",
    with_people("select profile_id, ord, score from final join chosen_pairs using (profile_id, ord) where score >= 66", **PRE_CTES),
)
def recommend_preranked(spark, sf):
    return both(plan.recommend(fixtures.postings(spark, sf), batch(spark, sf), AS_OF, threshold=66, prerank=2500), "score")


@CHECKS.add("metadata_filter", S.with_postings("select ord from postings where contains(location, '深圳') and company_type = '民营企业' and batch = '校招'"))
def metadata_filter(spark, sf):
    return search.metadata_filter(fixtures.postings(spark, sf), "深圳", "民营企业", "校招").select("ord")


QUERY = "Lucky seven 工程师"
COMPANY = S.blank(S.norm("company"))
HAY = "concat_ws(' ', " + ", ".join(S.blank(S.norm(x)) for x in ("company", "role", "department", "location", "industry", "jd")) + ")"


def alias_sql(query: str) -> tuple[str, str]:
    import re

    q = features.norm_py(query)
    tokens = [t for t in re.split(r"[\s,，、/]+", q) if t]
    every = " and ".join("(" + " or ".join(f"contains({HAY}, {S.q(a)})" for a in search.aliases_for(t, DEMO_ALIASES)) + ")" for t in tokens)
    exact = " or ".join(f"starts_with({COMPANY}, {S.q(a)}) or starts_with({S.q(a)}, {COMPANY})" for a in search.aliases_for(q, DEMO_ALIASES))
    boost = f"case when {exact} then 100 when contains({COMPANY}, {S.q(q)}) then 70 when contains({S.blank(S.norm('role'))}, {S.q(q)}) then 50 else 20 end"
    return every, boost


@CHECKS.add(
    "search_alias",
    S.with_postings(
        " union all ".join(f"select {S.q(q)} as query, ord, ({alias_sql(q)[1]})::bigint as boost from postings where {alias_sql(q)[0]}" for q in ("S7", "dozen 工程师"))
    ),
)
def search_alias(spark, sf):
    df = fixtures.postings(spark, sf)
    found = [search.search_alias(df, q, DEMO_ALIASES).select(F.lit(q).alias("query"), "ord", big(C("boost")).alias("boost")) for q in ("S7", "dozen 工程师")]
    return found[0].unionByName(found[1])


def literal_sql(query: str) -> str:
    q = S.q(query.strip().lower())
    blob = f"lower({S.joined('company', 'role', 'location', 'department', 'batch', 'graduation', 'jd')})"
    every, boost = alias_sql(query)
    return f"""select {S.q(query)} as query, ord, boost::bigint as boost from (select ord, case when starts_with(lower(company), {q}) then 100 when contains(lower(company), {q}) then 70
      when contains(lower(role), {q}) then 50 when contains({blob}, {q}) then 20 when {every} then {boost} end as boost from postings) where boost is not null"""


@CHECKS.add("search_literal", S.with_postings(" union all ".join(map(literal_sql, ("widget", "s7")))))
def search_literal(spark, sf):
    df = fixtures.postings(spark, sf)
    found = [search.search_literal(df, q, DEMO_ALIASES).select(F.lit(q).alias("query"), "ord", big(C("boost")).alias("boost")) for q in ("widget", "s7")]
    return found[0].unionByName(found[1])


def weighted_sql(query: str) -> str:
    """(ord, updated_at, boost) of rows matching every token."""
    q = features.norm_py(query)
    fields = search.SEARCHED
    every = " and ".join("(" + " or ".join(f"contains(n_{c}, {S.q(t)})" for c in fields) + ")" for t in q.split())
    boost = f"""case when n_role = {S.q(q)} then 260 when contains(n_role, {S.q(q)}) then 150 else 0 end + case when n_company = {S.q(q)} then 240 when contains(n_company, {S.q(q)}) then 135 else 0 end
      + case when contains(n_location, {S.q(q)}) then 55 else 0 end + case when contains(n_department, {S.q(q)}) then 38 else 0 end + case when contains(n_industry, {S.q(q)}) then 24 else 0 end"""
    for t in q.split():
        for c, v in (("role", 28), ("company", 24), ("location", 8), ("jd", 3)):
            boost += f" + case when contains(n_{c}, {S.q(t)}) then {v} else 0 end"
    return f"select ord, updated_at, ({boost})::bigint as boost from (select ord, updated_at, {', '.join(f'{S.blank(S.norm(c))} as n_{c}' for c in fields)} from postings) where {every}"


SEARCH_QUERY = "widget"


@CHECKS.add("search_weighted", S.with_postings(f"select ord, boost from ({weighted_sql(SEARCH_QUERY)})"))
def search_weighted(spark, sf):
    return search.search_weighted(fixtures.postings(spark, sf), SEARCH_QUERY).select("ord", big(C("boost")).alias("boost"))


@CHECKS.add(
    "search_scored",
    with_people(
        """select f.ord, boost, coalesce(case when r.ord is not null then coalesce(n.score, 0) end, -1.0::double) as scored from found f left join ranked r on r.ord = f.ord
          left join (select ord, score from final where profile_id = (select profile_id from person order by p_conf desc, profile_id limit 1)) n on n.ord = r.ord""",
        found=weighted_sql(SEARCH_QUERY),
        ranked="select ord from found order by boost desc, updated_at desc, ord",
    ),
)
def search_scored(spark, sf):
    b = batch(spark, sf)
    first = b.profiles.orderBy(C("p_conf").desc(), "profile_id").first()["profile_id"]
    df = plan.search_scored(fixtures.postings(spark, sf), b, first, SEARCH_QUERY, AS_OF)
    return df.select("ord", big(C("boost")).alias("boost"), F.coalesce("score", F.lit(-1.0)).alias("scored"))


@CHECKS.add("fresh_filter", S.with_postings(f"select ord, age::bigint as age from (select ord, {S.age('updated_at')} as age from postings) where age <= 30 or age = 999"))
def fresh_filter(spark, sf):
    return plan.unranked(fixtures.postings(spark, sf), AS_OF, fresh_only=True).select("ord", big(C("age")).alias("age"))


@CHECKS.add(
    "order_results",
    with_people(
        """select 'match' as mode, profile_id, ord from (select * from final order by score desc, fit_core desc, ord, profile_id limit 60)
        union all select 'fresh', profile_id, ord from (select * from final order by updated_at desc, score desc, ord, profile_id limit 60)"""
    ),
)
def order_results(spark, sf):
    b, p = pairs(spark, sf)
    # Both orders read the scored pairs; without the table every pair would be made and scored twice.
    scored = stage(scoring.score_pairs(p).select("profile_id", "ord", "score", "fit_core", "updated_at"), "scored")
    shown = [search.order_results(scored.withColumn("ord", F.struct("ord", "profile_id")), m, 60).select(F.lit(m).alias("mode"), "profile_id", C("ord.ord").alias("ord")) for m in ("match", "fresh")]
    return shown[0].unionByName(shown[1])


DECISIONS = "select id as job_id, case when salary_low is null then 'hidden' when salary_high is null then 'saved' end as decision from {postings} where salary_low is null or salary_high is null"


@CHECKS.add("exclude_hidden", S.with_postings("select ord from postings where salary_low is not null"))
def exclude_hidden(spark, sf):
    df = fixtures.postings(spark, sf)
    return search.exclude_hidden(df, spark.sql(DECISIONS, postings=df)).select("ord")


@CHECKS.add(
    "market_summary",
    with_people(
        f"""select count(*) filter (score >= 90) as over_90, count(*) filter (score >= 80) as over_80, count(*) as scored,
        (select floor(count(*) filter (coalesce(source_tier, 0) >= 6 or {S.rx("coalesce(nullif(source_label, ''), source)", '(?i)官方|官网|direct-official')}) / count(*) * 100 + 0.5)::bigint from postings) as official_pct from final"""
    ),
)
def market_summary(spark, sf):
    b, p = pairs(spark, sf)
    df = search.market_summary(scoring.score_pairs(p), fixtures.postings(spark, sf))
    return df.select(*[big(C(c)).alias(c) for c in df.columns])


@CHECKS.add(
    "facets",
    S.with_postings(
        """select distinct 'location' as kind, value from (select unnest(regexp_split_to_array(location, '[ ,，、/]+')) as value from postings) where length(value) between 2 and 10
        union all select distinct 'company_type', company_type from postings union all select distinct 'batch', batch from postings where batch <> ''"""
    ),
)
def facets(spark, sf):
    return search.facets(fixtures.postings(spark, sf))


@CHECKS.add(
    "source_fallback",
    "select s_name as company, 'https://' || lower(s_name) || '.example.com' as url, case when s_acctbal > 5000 then 'signal-found' when s_acctbal > 0 then 'reachable' else 'unreachable' end as state from supplier where s_suppkey = 7",
)
def source_fallback(spark, sf):
    people = fixtures.table(spark, sf, "supplier")
    registry = people.select(C("s_suppkey").alias("ord"), C("s_name").alias("company"), F.concat(F.lit("https://"), F.lower("s_name"), F.lit(".example.com")).alias("url"))
    health = people.select(C("s_name").alias("company"), (C("s_acctbal") > 0).alias("ok"), (C("s_acctbal") > 5000).alias("year_seen"))
    nothing = search.search_weighted(fixtures.postings(spark, sf), "lucky-seven-careers")
    return search.source_fallback(nothing, "lucky-seven-careers", registry, health, {"Lucky-Seven-Careers": "Supplier#000000007"})
