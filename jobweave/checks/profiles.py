"""Text to profile, over all documents and résumés."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures, vocab
from ..fixtures import DEMO_TAXONOMY as TAX
from ..operators import profiles as P
from . import CHECKS, career_sql as K, sqlx as S
from .columns import big, blank, degree_sql, year_sql

C = F.col


def exploded(df, key, array, *cols):
    return df.select(key, F.posexplode(array).alias("i", "r")).select(key, big(C("i")).alias("i"), *cols)


def list_of(c, sep=";"):
    return F.array_join(c, sep)


DOC_CTES = {"entries": K.entries(), "docs": f"select doc_id, {S.norm('text')} as body from documents", "hits": K.plain_hits("docs", "doc_id")}


def with_ctes(body, **ctes):
    return "with " + ",\n".join(f"{n} as ({t})" for n, t in ctes.items()) + "\n" + body


@CHECKS.add("term_hits", with_ctes("select doc_id, d::bigint as d, score::double as score, array_to_string(terms[1:8], ';') as terms from hits", **DOC_CTES))
def term_hits(spark, sf):
    df = P.term_hits(fixtures.table(spark, sf, "documents"), TAX, C("text"))
    return exploded(df, "doc_id", "term_scores", big(C("r.d")).alias("d"), (C("r.score10") / 10).alias("score"), list_of(C("r.evidence")).alias("terms")).drop("i")


DIRECTION_SQL = """select doc_id, i::bigint as i, d::bigint as d, score::double as score,
  greatest(18, least(96, floor(34 + 62 * (score / peak * case when i = 0 then 1.0::double else 0.92::double end) + 0.5)))::bigint as confidence
  from (select *, row_number() over (partition by doc_id order by score desc, d) - 1 as i, max(score) over (partition by doc_id) as peak from hits) where i < 6"""


@CHECKS.add("direction_scores", with_ctes(DIRECTION_SQL, **DOC_CTES))
def direction_scores(spark, sf):
    df = P.term_hits(fixtures.table(spark, sf, "documents"), TAX, C("text")).withColumn("top", P.direction_scores(C("term_scores"), TAX))
    return exploded(df, "doc_id", "top", big(C("r.d")).alias("d"), C("r.score").alias("score"), big(C("r.confidence")).alias("confidence"))


JOB_TEXT = S.joined("role", "department", "industry", "jd")
JOB_CTES = {"entries": K.entries(), "job": f"select ord, coalesce({S.norm(JOB_TEXT)}, '') as body, coalesce({S.norm('role')}, '') as title, '' as major from postings", **K.scored("job", "ord", 5)}


def job_text():
    from ..functions.text import joined

    return joined(C("role"), C("department"), C("industry"), C("jd"))


@CHECKS.add(
    "domain_scores",
    S.with_postings("select ord, d::bigint as d, score10 / 10 as score, anchors::bigint as anchors, array_to_string(evidence, ';') as evidence from job_dom", **JOB_CTES),
)
def domain_scores(spark, sf):
    df = P.domain_scores(fixtures.postings(spark, sf), TAX, job_text(), title=C("role"))
    return exploded(
        df, "ord", "domains", big(C("r.d")).alias("d"), (C("r.score10") / 10).alias("score"), big(C("r.anchors")).alias("anchors"), list_of(C("r.evidence")).alias("evidence")
    ).drop("i")


@CHECKS.add("classify", S.with_postings("select ord, i::bigint as i, d::bigint as d, score10 / 10 as score, confidence from job_top", **JOB_CTES))
def classify(spark, sf):
    df = P.classify(fixtures.postings(spark, sf), TAX, job_text(), title=C("role"))
    return exploded(df, "ord", "scores", big(C("r.d")).alias("d"), C("r.score").alias("score"), big(C("r.confidence")).alias("confidence"))


RESUME = {"resumes": S.RESUMES}


@CHECKS.add("major_window", with_ctes(f"select profile_id, {K.major('text')} as window_text from resumes", **RESUME))
def major_window(spark, sf):
    return fixtures.resumes(spark, sf).select("profile_id", P.major_window(C("text")).alias("window_text"))


SECTION_CTES = {**RESUME, **K.sections("resumes")}


@CHECKS.add(
    "split_sections",
    with_ctes("select profile_id, row_number() over (partition by profile_id order by sec) - 1 as i, name, weight::bigint as weight, text from sections", **SECTION_CTES),
)
def split_sections(spark, sf):
    df = fixtures.resumes(spark, sf).withColumn("s", P.split_sections(C("text")))
    return exploded(df, "profile_id", "s", C("r.name").alias("name"), big(C("r.weight")).alias("weight"), C("r.text").alias("text"))


def profile_ctes(resumes: str) -> dict[str, str]:
    """CTEs up to prof_dom(profile_id, i, d, total, confidence, evidence)."""
    return {
        "resumes": resumes,
        **K.sections("resumes"),
        "entries": K.entries(),
        "roles": K.roles(),
        "cv_parts": f"""select *, profile_id * 1000 + no as pid from (select profile_id, 0 as no, 72 as weight, '全文' as label, text from resumes
          union all select profile_id, sec + 1, weight, label, text from sections where length({K.tidy('text')}) >= 12)""",
        "part": f"select profile_id, pid, no, weight, label, coalesce({S.norm('text')}, '') as body, '' as title, coalesce({S.norm(K.major('text'))}, '') as major from cv_parts",
        **K.scored("part", "pid", 14),
        "mixed": "select profile_id, no, label, t.d, t.i, score10 * weight as v, evidence from part_top t join part using (pid)",
        "totals": "select profile_id, d, sum(v) as total from mixed group by profile_id, d",
        "tagged": "select profile_id, d, tag, min(ppos) as ppos from (select profile_id, d, unnest(list_transform(evidence, lambda x: label || ':' || x)) as tag, no * 1000 + generate_subscripts(evidence, 1) as ppos from mixed) group by profile_id, d, tag",
        "prof_dom": """select t.profile_id, i, t.d, total, greatest(20, least(97, floor(36 + 61 * (total / peak * case when i = 0 then 1.0::double else 0.94::double end) + 0.5)))::bigint as confidence,
          (select list(tag order by ppos)[1:10] from tagged g where g.profile_id = t.profile_id and g.d = t.d) as evidence
          from (select *, row_number() over (partition by profile_id order by total desc, d) - 1 as i, max(total) over (partition by profile_id) as peak from totals) t where i < 6""",
        "voted": """select profile_id, role, sum(weight) as votes, min(ppos) as ppos from (select profile_id, role, weight, pid, min(no * 10000 + i * 100 + pos) as ppos, row_number() over (partition by pid order by min(i * 100 + pos)) as nth
          from part_top t join part using (pid) join roles r on r.d = t.d where i < 4 group by profile_id, role, weight, pid) where nth <= 18 group by profile_id, role""",
        "prof_roles": "select profile_id, list(role order by n) as roles from (select *, row_number() over (partition by profile_id order by votes desc, ppos) as n from voted) where n <= 14 group by profile_id",
    }


PROFILE_CTES = profile_ctes(S.RESUMES)


@CHECKS.add(
    "section_profile",
    with_ctes(
        """select profile_id, i::bigint as i, d::bigint as d, floor((total + 50) / 100) / 10 as score, confidence, array_to_string(evidence, ';') as evidence,
        coalesce((select array_to_string(roles, ';') from prof_roles r where r.profile_id = p.profile_id), '') as roles from prof_dom p""",
        **PROFILE_CTES,
    ),
)
def section_profile(spark, sf):
    df = P.section_profile(fixtures.resumes(spark, sf), TAX, C("text")).withColumn("roles", list_of(C("recommended_roles")))
    return df.select("profile_id", "roles", F.posexplode("domains").alias("i", "r")).select(
        "profile_id", big(C("i")).alias("i"), big(C("r.d")).alias("d"), C("r.score").alias("score"), big(C("r.confidence")).alias("confidence"),
        list_of(C("r.evidence")).alias("evidence"), "roles",
    )


def skills_ctes(part: str, top: str, key: str) -> dict[str, str]:
    """CTE skill_list(key, n, term): strong domain terms, then core terms."""
    generic = ", ".join(map(S.q, vocab.PROFILE_GENERIC))
    return {
        "strong": f"""select {key}, term, row_number() over (partition by {key} order by length(term) desc, min(i * 1000 + e)) as n from {top} t join entries using (d) join {part} p using ({key})
          where i < 4 and kind = 'term' and w >= 5 and contains(body, nterm) and nterm not in ({generic}) group by {key}, term""",
        "core": f"select {key}, term, row_number() over (partition by {key} order by length(term) desc, min(e)) as n from {part}, entries where kind = 'term' and contains(body, nterm) group by {key}, term",
        "skill_list": f"""select {key}, term, row_number() over (partition by {key} order by min(ppos)) as n from (select {key}, term, n as ppos from strong where n <= 64
          union all select {key}, term, 1000 + n from core where n <= 48) group by {key}, term""",
    }


WHOLE_CTES = {
    **RESUME, "entries": K.entries(),
    "cv": f"select profile_id, coalesce({S.norm('text')}, '') as body, '' as title, coalesce({S.norm(K.major('text'))}, '') as major from resumes",
    **K.scored("cv", "profile_id", 14), **skills_ctes("cv", "cv_top", "profile_id"),
}


@CHECKS.add(
    "extract_skills",
    with_ctes("select profile_id, coalesce((select string_agg(term, ';' order by n) from skill_list s where s.profile_id = r.profile_id), '') as skills from resumes r", **WHOLE_CTES),
)
def extract_skills(spark, sf):
    return P.extract_skills(fixtures.resumes(spark, sf), TAX, C("text")).select("profile_id", list_of(C("skills")).alias("skills"))


def keyword_ctes(source: str, key: str) -> dict[str, str]:
    def tokens(x, pattern, stop):
        return f"list_filter(regexp_extract_all({x}, {S.q(pattern)}), lambda w: not list_contains({S.arr(stop)}, w))"

    latin = tokens(S.blank(S.norm("text")), vocab.LATIN_WORD, vocab.LATIN_STOP)
    return {
        "tokens": f"select {key}, list_concat({latin}, {tokens('text', vocab.HAN_RUN, vocab.HAN_STOP)}) as ws from {source}",
        "words": f"select {key}, word, count(*) as n, min(pos) as pos from (select {key}, unnest(ws) as word, generate_subscripts(ws, 1) as pos from tokens) group by {key}, word",
        "ranked_words": f"select {key}, word, row_number() over (partition by {key} order by words.n desc, pos) as n from words qualify row_number() over (partition by {key} order by words.n desc, pos) <= 60",
    }


@CHECKS.add(
    "keywords",
    with_ctes("select doc_id, string_agg(word, ';' order by n) as keywords from ranked_words group by doc_id", **keyword_ctes("documents", "doc_id")),
)
def keywords(spark, sf):
    return P.keywords(fixtures.table(spark, sf, "documents"), "doc_id", C("text")).select("doc_id", list_of(C("keywords")).alias("keywords"))


CLEAN_CV = K.trim_all("regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
CLEANED = f"select * replace ({CLEAN_CV} as text) from ({S.RESUMES})"
NAME_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda l: {K.trim_all('l')}), lambda l: l <> '')[1:8]"
QUALITY_CTES = profile_ctes(CLEANED)


@CHECKS.add(
    "profile",
    with_ctes(
        f"""select profile_id, coalesce(list_filter({NAME_LINES}, lambda l: regexp_matches(l, '^[\\x{{4e00}}-\\x{{9fa5}}·]{{2,6}}$'))[1], regexp_replace(file_name, '(?i)\\.(pdf|docx|txt)$', '')) as display_name,
        {S.blank(degree_sql('text'))} as degree, {S.blank(year_sql('text'))} as graduation_year,
        array_to_string(list_filter({S.arr(vocab.PROFILE_CITIES)}, lambda c: contains(text, c))[1:16], '/') as cities,
        coalesce((select string_agg(word, ';' order by n) from ranked_words w where w.profile_id = r.profile_id), '') as keywords,
        coalesce((select d from prof_dom p where p.profile_id = r.profile_id and i = 0), -1)::bigint as primary_domain,
        coalesce((select array_to_string(roles, ';') from prof_roles p where p.profile_id = r.profile_id), '') as roles from resumes r""",
        **QUALITY_CTES, **keyword_ctes("resumes", "profile_id"),
    ),
)
def profile(spark, sf):
    df = P.profile(fixtures.resumes(spark, sf), TAX)
    return df.select(
        "profile_id", "display_name", blank(C("degree")).alias("degree"), blank(C("graduation_year")).alias("graduation_year"),
        F.array_join("cities", "/").alias("cities"), list_of(C("keywords")).alias("keywords"),
        F.coalesce(big(F.get("domains", F.lit(0))["d"]), F.lit(-1).cast("bigint")).alias("primary_domain"), list_of(C("recommended_roles")).alias("roles"),
    )


@CHECKS.add(
    "profile_quality",
    with_ctes(
        f"""select *, case when sections >= 4 and evidence >= 8 then 'clear' when sections >= 2 and evidence >= 4 then 'usable' else 'check' end as label from (
        select profile_id, length({K.tidy('text')})::bigint as chars, (select count(*) from sections s where s.profile_id = r.profile_id and name <> 'other') as sections,
        (select coalesce(sum(len(evidence)), 0)::bigint from prof_dom p where p.profile_id = r.profile_id) as evidence,
        (select count(*) from prof_dom p where p.profile_id = r.profile_id) as domains from resumes r)""",
        **QUALITY_CTES,
    ),
)
def profile_quality(spark, sf):
    df = P.section_profile(fixtures.resumes(spark, sf).withColumn("raw", P.clean_resume(C("text"))), TAX, C("raw"))
    q = P.profile_quality(C("raw"), C("sections"), C("domains"))
    return df.select("profile_id", q.alias("q")).select("profile_id", *[big(C(f"q.{k}")).alias(k) for k in ("chars", "sections", "evidence", "domains")], C("q.label").alias("label"))
