"""Identities rows are merged and de-duplicated on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import signals, urls
from ..functions.text import canonical_company, clean, nonblank, stable_id

C = F.col


def low(c: Column) -> Column:
    return F.coalesce(F.lower(clean(c)), F.lit(""))


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """First row per key. ``order`` must end in a unique column.

    ``row_number() = 1`` is pruned to one row per key inside every map task
    (WindowGroupLimit) before the shuffle, so a key that holds a third of the
    rows reaches its reducer as at most one row per task.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = df.withColumns(dict(zip(names, keys)))
    w = Window.partitionBy(*names).orderBy(*order)
    return keyed.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", *names)


def drop_nameless(df: DataFrame) -> DataFrame:
    return df.filter(clean(C("company")).isNotNull() & clean(C("role")).isNotNull())


def catalogue_key() -> Column:
    """Cross-source identity: canonical company, role, place."""
    return stable_id(canonical_company(C("company")), canonical_company(C("role")), canonical_company(C("location")))


def listing_identity() -> Column:
    """(company, role, place, link), lower-cased."""
    link = F.coalesce(clean(C("apply_url")), clean(C("notice_url")))
    return F.concat_ws("\x1f", low(C("company")), low(C("role")), low(C("location")), low(link))


def position_identity() -> Column:
    """As listing_identity with the position id ahead of the link."""
    link = F.coalesce(clean(C("position_id")), clean(C("apply_url")))
    return F.concat_ws("\x1f", low(C("company")), low(C("role")), low(C("location")), low(link))


def opportunity_key() -> Column:
    """company|role without city|city, null when company or role is missing."""
    company, role = F.lower(clean(C("company"))), signals.role_without_city(C("role"))
    city = low(signals.inferred_city(C("location"), C("role")))
    return F.when(company.isNotNull() & role.isNotNull(), F.concat_ws("|", company, role, city))


def feed_key(position_params: list[str] = ["positionId", "position_id"], product: str = "pdd") -> Column:
    """source:position id, else the id in the link's query, else link, else names."""
    position = F.concat(clean(C("source")), F.lit(":"), clean(C("position_id")))
    link = F.coalesce(clean(C("apply_url")), clean(C("notice_url")))
    in_query = F.coalesce(*[nonblank(F.regexp_extract(link, rf"[?&]{p}=([^&#]+)", 1)) for p in position_params])
    plain = F.concat(F.lit("url:"), F.regexp_replace(link, "/+$", ""))
    names = F.concat_ws("|", low(C("company")), low(C("role")), low(C("location")))
    return F.lower(F.coalesce(position, F.concat(F.lit(f"{product}:"), in_query), plain, names))


def any_keys(later: bool = False) -> Column:
    """Up to five keys of a row for the greedy de-duplication."""
    company, role, place = (F.lower(clean(C(c))) for c in ("company", "role", "location"))
    names = F.concat_ws("|", company, role)
    named = company.isNotNull() & role.isNotNull()
    params = urls.vocab.TRACKING_PARAMS_LATER if later else urls.vocab.TRACKING_PARAMS

    def by_link(c: str) -> Column:
        return F.when(named, F.concat(F.lit("url:"), urls.canonical_url(C(c), params), F.lit("|"), names))

    candidates = [by_link("apply_url"), by_link("notice_url")]
    if not later:
        candidates.append(F.concat(F.lit("position:"), company, F.lit("|"), F.lower(clean(C("position_id")))))
    candidates.append(F.when(named, F.concat(F.lit("fallback:"), names, F.lit("|"), place)))
    keys = F.array_distinct(F.array_compact(F.array(*candidates)))
    by_role = F.when(named, F.concat(F.lit("role:"), names))
    last = by_role if later else F.coalesce(by_role, F.concat(F.lit("id:"), F.lower(clean(C("id")))))
    return F.when(F.size(keys) > 0, keys).otherwise(F.array_compact(F.array(last)))
