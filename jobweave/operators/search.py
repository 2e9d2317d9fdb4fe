"""Filtering, searching, ordering and summarising the catalogue."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import is_fresh
from ..functions.text import clean, has, joined, let, nonblank, normal
from ..taxonomy import norm_py

C = F.col
SEARCHED = ["company", "role", "location", "department", "industry", "jd", "batch", "graduation"]
ALL = "all"


def metadata_filter(jobs: DataFrame, location: str = ALL, company_type: str = ALL, batch: str = ALL) -> DataFrame:
    if location != ALL:
        jobs = jobs.filter(C("location").contains(location))
    if company_type != ALL:
        jobs = jobs.filter(C("company_type") == company_type)
    return jobs.filter(C("batch") == batch) if batch != ALL else jobs


def aliases_for(query: str, aliases: Mapping[str, Sequence[str]]) -> list[str]:
    q = norm_py(query)
    out = [q]
    for name, others in aliases.items():
        known = [norm_py(a) for a in others]
        if norm_py(name) == q or q in known or q in norm_py(name):
            out += known
    return list(dict.fromkeys(a for a in out if a))


def _text(c: Column) -> Column:
    return normal(c)


def _alias_match(query: str, aliases: Mapping[str, Sequence[str]]) -> tuple[Column, Column]:
    """(matched, boost): every token or one of its aliases occurs in the row."""
    q = norm_py(query)
    tokens = [t for t in re.split(r"[\s,，、/]+", q) if t]
    whole = aliases_for(q, aliases)
    fields = [C(c) for c in ("company", "role", "department", "location", "industry", "jd")]

    def every(hay: Column) -> Column:
        found = F.lit(True)
        for t in tokens:
            any_of = F.lit(False)
            for a in aliases_for(t, aliases):
                any_of = any_of | hay.contains(a)
            found = found & any_of
        return found

    matched = let(F.concat_ws(" ", *map(_text, fields)), every)

    def boost(company: Column) -> Column:
        exact = F.lit(False)
        for a in whole:
            exact = exact | (company == a) | company.startswith(a) | F.lit(a).startswith(company)
        return F.when(exact, 100).when(company.contains(q), 70).when(_text(C("role")).contains(q), 50).otherwise(20)

    return matched, let(_text(C("company")), boost)


def search_alias(jobs: DataFrame, query: str, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    matched, boost = _alias_match(query, aliases)
    return jobs.filter(matched).withColumn("boost", boost)


def search_literal(jobs: DataFrame, query: str, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Plain text first; the alias rule only where that finds nothing."""
    q = query.strip().lower()
    low = {c: F.lower(F.coalesce(C(c), F.lit(""))) for c in ("company", "role")}
    blob = F.lower(joined(*[C(c) for c in ("company", "role", "location", "department", "batch", "graduation", "jd")]))
    matched, boost = _alias_match(query, aliases)
    literal = (
        F.when(low["company"].startswith(q), 100).when(low["company"].contains(q), 70).when(low["role"].contains(q), 50).when(blob.contains(q), 20)
    )
    return jobs.withColumn("boost", F.coalesce(literal, F.when(matched, boost))).filter("boost is not null")


def _holds(c: Column, token: str) -> Column:
    """Whether a token without spaces occurs in the normalised text.

    Squeezing spaces touches no such token, and dashes matter only to one that
    holds a hyphen, so most texts are ruled out without being squeezed.
    """
    return _text(c).contains(token) if "-" in token else F.lower(F.coalesce(c, F.lit(""))).contains(token)


def search_weighted(jobs: DataFrame, query: str) -> DataFrame:
    """All tokens somewhere in the row; weighted by where the query occurs."""
    q = norm_py(query)
    tokens = q.split()
    step = jobs
    for t in tokens:
        anywhere = F.lit(False)
        for c in SEARCHED:
            anywhere = anywhere | _holds(C(c), t)
        step = step.filter(anywhere)
    step = step.withColumns({f"__{c}": _text(C(c)) for c in SEARCHED})
    f = {c: C(f"__{c}") for c in SEARCHED}

    def points(test: Column, value: int) -> Column:
        return F.when(test, value).otherwise(0)

    boost = F.when(f["role"] == q, 260).when(f["role"].contains(q), 150).otherwise(0)
    boost = boost + F.when(f["company"] == q, 240).when(f["company"].contains(q), 135).otherwise(0)
    boost = boost + points(f["location"].contains(q), 55) + points(f["department"].contains(q), 38) + points(f["industry"].contains(q), 24)
    for t in tokens:
        for c, value in (("role", 28), ("company", 24), ("location", 8), ("jd", 3)):
            boost = boost + points(f[c].contains(t), value)
    return step.withColumn("boost", boost).drop(*[f"__{c}" for c in SEARCHED])


def updated() -> Column:
    return F.coalesce(clean(C("updated_at")), F.lit(""))


def order_results(rows: DataFrame, mode: str, n: int | None = None, score: str = "score", fit: str = "fit_core") -> DataFrame:
    """``match``: score, fit; ``fresh``: newest, score; ``company``: name, score; ``boost``: boost, score, newest."""
    by = {
        "boost": [C("boost").desc(), C(score).desc_nulls_last(), updated().desc()],
        "match": [C(score).desc_nulls_last(), C(fit).desc_nulls_last()],
        "fresh": [updated().desc(), C(score).desc_nulls_last()],
        "company": [F.collate(F.coalesce(C("company"), F.lit("")), "zh").asc(), C(score).desc_nulls_last()],
    }[mode]
    ordered = rows.orderBy(*by, "ord")
    return ordered.limit(n) if n is not None else ordered


def exclude_hidden(jobs: DataFrame, decisions: DataFrame) -> DataFrame:
    hidden = decisions.filter(C("decision") == "hidden").select(C("job_id").alias("__hidden"))
    return jobs.join(hidden, C("id") == C("__hidden"), "left_anti")


def fresh_filter(jobs: DataFrame, age: str = "age", days: int = 30) -> DataFrame:
    return jobs.filter(is_fresh(C(age), days))


def market_summary(scored: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row: strong and good fits among the scored rows, official share of the
    whole catalogue."""
    fits = scored.agg(
        F.count_if(C("score") >= 90).alias("over_90"), F.count_if(C("score") >= 80).alias("over_80"), F.count_if(C("score").isNotNull()).alias("scored")
    )
    label = F.coalesce(nonblank(C("source_label")), C("source"))
    official = (F.coalesce(C("source_tier"), F.lit(0)) >= 6) | has(label, "(?i)官方|官网|direct-official")
    share = catalogue.agg(
        F.coalesce(F.floor(F.count_if(official) / F.count("*") * 100 + 0.5), F.lit(0)).cast("int").alias("official_pct")
    )
    return fits.select("*", share.scalar().alias("official_pct"))


def facets(jobs: DataFrame, cap: int | None = None) -> DataFrame:
    """Distinct places, types and batches in Chinese collation; with ``cap``, the first so many of each."""
    places = F.filter(F.split(F.coalesce("location", F.lit("")), "[ ,，、/]+"), lambda x: F.length(x).between(2, 10))
    kinds = {"location": places, "company_type": F.array(nonblank(C("company_type"))), "batch": F.array(nonblank(C("batch")))}
    total = None
    for kind, values in kinds.items():
        one = jobs.select(F.explode(values).alias("value")).filter("value is not null").distinct()
        one = one.orderBy(F.collate("value", "zh"), "value")
        one = (one if cap is None else one.limit(cap)).withColumn("kind", F.lit(kind))
        total = one if total is None else total.unionByName(one)
    return total.select("kind", "value")


def source_fallback(found: DataFrame, query: str, registry: DataFrame, health: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """When a query finds nothing: the official source of the company meant.

    ``registry(ord, company, url)``, ``health(company, ok, year_seen)``.
    """
    q = query.strip().lower()
    name = {a.lower(): n for a, n in aliases.items()}.get(q, q)
    hit = registry.filter((F.lower("company") == name.lower()) | F.lower("company").contains(name.lower()))
    empty = found.select(F.lit(1).alias("one")).limit(1).agg((F.count("*") == 0).alias("none"))
    first = hit.orderBy("ord").limit(1).filter(empty.scalar())
    state = F.when(C("year_seen"), "signal-found").when(F.coalesce("ok", F.lit(True)), "reachable").otherwise("unreachable")
    return first.join(health, "company", "left").select("company", "url", state.alias("state"))
