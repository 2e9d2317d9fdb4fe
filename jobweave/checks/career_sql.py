"""SQL for taxonomy scoring: documents or sections against weighted terms."""

from __future__ import annotations

from .. import vocab
from ..fixtures import DEMO_TAXONOMY
from ..taxonomy import Taxonomy, norm_py
from . import sqlx as S


def entries(tax: Taxonomy = DEMO_TAXONOMY) -> str:
    rows = ", ".join(
        f"({i}, {e.domain}, {S.q(e.kind)}, {S.q(e.term)}, {S.q(norm_py(e.term))}, {e.weight})" for i, e in enumerate(tax.entries())
    )
    return f"select * from (values {rows}) t(e, d, kind, term, nterm, w)"


def domains(tax: Taxonomy = DEMO_TAXONOMY) -> str:
    rows = ", ".join(f"({i}, {S.q(d.id)}, {S.q(d.name)})" for i, d in enumerate(tax.domains))
    return f"select * from (values {rows}) t(d, id, name)"


def roles(tax: Taxonomy = DEMO_TAXONOMY) -> str:
    rows = ", ".join(f"({i}, {j}, {S.q(r)})" for i, d in enumerate(tax.domains) for j, r in enumerate(d.roles))
    return f"select * from (values {rows}) t(d, pos, role)"


def edges(tax: Taxonomy = DEMO_TAXONOMY) -> str:
    n = range(len(tax.domains))
    rows = ", ".join(f"({a}, {b})" for a in n for b in n if tax.related(tax.domains[a].id, tax.domains[b].id))
    return f"select * from (values {rows}) t(a, b)"


COUNT = "least(2, (length(body) - length(replace(body, nterm, ''))) // length(nterm))"


def plain_hits(source: str, key: str) -> str:
    """(key, d, score, hits): P1 over ``source(key, body)``."""
    return (
        f"select {key}, d, sum(w * {COUNT}) as score, list(term order by e) as terms from {source}, entries "
        f"where kind = 'term' and contains(body, nterm) group by {key}, d having sum(w * {COUNT}) > 0"
    )


def scored(source: str, key: str, major_points: int) -> dict[str, str]:
    """CTEs {source}_dom and {source}_top over ``source(key, body, title, major)``."""
    value = (
        f"case when kind = 'major' then {major_points} * 10000 else w * {COUNT} * case when contains(title, nterm) then 185 else 100 end "
        "* case when contains(major, nterm) then 155 else 100 end end"
    )
    return {
        f"{source}_dom": f"""select * from (select {key}, d, cast(floor((sum({value}) + 500) / 1000) as bigint) as score10,
          sum(case when kind = 'major' or w >= 7 then 1 else 0 end) as anchors, list(term order by e)[1:12] as evidence
          from {source}, entries where contains(body, nterm) or (kind = 'major' and contains(major, nterm)) group by {key}, d) where score10 > 0""",
        f"{source}_rank": f"select *, row_number() over (partition by {key} order by score10 desc, d) - 1 as i, first_value(score10) over (partition by {key} order by score10 desc, d) as raw10, "
        f"first_value(anchors) over (partition by {key} order by score10 desc, d) as lead_anchors, coalesce(nth_value(score10, 2) over (partition by {key} order by score10 desc, d rows between unbounded preceding and unbounded following), 0) as second10 from {source}_dom",
        f"{source}_conf": f"""select *, case when (raw10 - second10) / 10 < 2 then least(c, 58) else c end as sure from (select *, case when raw10 / 10 < 7 then least(c0, 42) else c0 end as c from
          (select *, floor(least(98.0::double, 24 + least(42.0::double, raw10 / 10 * 1.7::double) + least(24.0::double, (raw10 - second10) / 10 * 1.7::double) + case when lead_anchors >= 2 then 8 else 0 end) + 0.5) as c0 from {source}_rank))""",
        f"{source}_top": f"""select {key}, i, d, score10, anchors, evidence, cast(case when i = 0 then sure else greatest(18, least(94, floor(sure * ((score10 / 10) / greatest(1.0::double, raw10 / 10)) * 0.94::double + 0.5))) end as bigint) as confidence
          from {source}_conf where i < 7""",
    }


def trim_all(x: str) -> str:
    space = f"[ {vocab.OTHER_SPACE}]+"
    return f"regexp_replace({x}, {S.q(f'^{space}|{space}$')}, '', 'g')"


def tidy(x: str) -> str:
    return trim_all(f"regexp_replace(regexp_replace({x}, '[\\t\\r]+', ' ', 'g'), ' {{2,}}', ' ', 'g')")


def major(x: str) -> str:
    lines = f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {trim_all('l')}), lambda l: l <> '' and regexp_matches(l, {S.q(vocab.MAJOR_LINE)}))"
    return f"array_to_string({lines}[1:20], ' ')"


def sections(source: str) -> dict[str, str]:
    """CTE sections(profile_id, sec, name, label, weight, text) from ``source``."""
    value = trim_all("regexp_replace(" + tidy("line") + r", '[【】\[\]#*]', '', 'g')")
    cases = " ".join(
        f"when regexp_matches({value}, {S.q(rf'(?i)^({words})\s*[:：]?$')}) then {i}" for i, (_, _, _, words) in enumerate(vocab.SECTIONS)
    )
    known = ", ".join(f"({i}, {S.q(n)}, {S.q(l)}, {w})" for i, (n, l, w, *_) in enumerate([*vocab.SECTIONS, vocab.OTHER_SECTION]))
    return {
        "known": f"select * from (values {known}) t(no, name, label, weight)",
        "lines": f"select profile_id, line, i from (select profile_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from {source})",
        "heads": f"select *, case when length({value}) > 32 then -1 {cases} else -1 end as head from lines",
        "groups": "select *, sum(case when head >= 0 then 1 else 0 end) over (partition by profile_id order by i) as sec from heads",
        "bodies": f"select profile_id, sec, max(case when head >= 0 then head else -1 end) as head, {trim_all('coalesce(string_agg(case when head < 0 then line end, chr(10) order by i), ' + S.q('') + ')')} as text from groups group by profile_id, sec",
        "sections": f"select profile_id, sec, name, label, weight, text from bodies join known on no = case when head < 0 then {len(vocab.SECTIONS)} else head end where text <> ''",
    }
