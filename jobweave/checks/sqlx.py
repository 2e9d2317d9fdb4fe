"""DuckDB SQL pieces the checks are written with.

These state each column function a second time, in SQL text, so a query and
its check do not share code beyond the fixed patterns.
"""

from __future__ import annotations

from .. import fixtures, vocab


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(vocab.SPACE)}, ' ', 'g'))"


def clean(x: str) -> str:
    return f"nullif({squeeze(x)}, '')"


def norm(x: str) -> str:
    return f"translate(lower({clean(x)}), {q(vocab.DASHES)}, {q('-' * len(vocab.DASHES))})"


def joined(*xs: str) -> str:
    return "concat_ws(' ', " + ", ".join(f"coalesce({x}, '')" for x in xs) + ")"


def rx(x: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({x}, {q(pattern)}), false)"


def sid(*xs: str) -> str:
    return "substr(sha1(concat_ws('|', " + ", ".join(f"lower({clean(x)})" for x in xs) + ")), 1, 18)"


def company(x: str) -> str:
    out = f"lower({clean(x)})"
    for word in vocab.LEGAL_FORMS:
        out = f"replace({out}, {q(word)}, '')"
    return clean(out)


def compact(x: str, n: int) -> str:
    return f"case when length({clean(x)}) > {n} then rtrim(substr({clean(x)}, 1, {n})) || '…' else {clean(x)} end"


def blank(x: str) -> str:
    return f"coalesce({x}, '')"


def fmt(template: str) -> str:
    """Plain table names into the shared view texts."""
    return template.format(**{t: t for t in fixtures.TABLES})


POSTINGS = fmt(fixtures.POSTINGS)
RESUMES = fmt(fixtures.RESUMES.replace("@ROLE", "user"))
PERSONAS = fmt(fixtures.RESUMES.replace("@ROLE", "system"))
EVENTS = fmt(fixtures.STAGE_EVENTS)


def with_postings(body: str, **ctes: str) -> str:
    extra = "".join(f",\n{name} as ({text})" for name, text in ctes.items())
    return f"with postings as ({POSTINGS}){extra}\n{body}"


def arr(names: list[str]) -> str:
    return "[" + ", ".join(q(n) for n in names) + "]"


def age(x: str) -> str:
    day = f"try_cast({x} as date)"
    return f"(case when {day} is null then 999 else greatest(0, date_diff('day', {day}, date '{fixtures.AS_OF}')) end)"


def half_up(x: str) -> str:
    return f"floor({x} + 0.5)"


def one_dp(x: str) -> str:
    return f"(floor(({x}) * 10 + 0.5) / 10)"
