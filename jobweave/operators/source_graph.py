"""The graph of official sources, its health, and source statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab
from ..functions import urls
from ..functions.text import clean, has, nonblank
from .keys import keep_first

C = F.col
# --- fixed values: priorities by how a source became known ----------------------
WATCH, REVIEWED, SPIDER, OBSERVED_DIRECT, OBSERVED = 95, 70, 100, 78, 42
ORIGINS = {"watch": "priority-registry", "source": "reviewed-registry", "spider": "career-spider"}


def _clamped(c: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(100), c))


def build_source_graph(registry: DataFrame, jobs: DataFrame) -> DataFrame:
    """One node per company and board.

    ``registry(ord, company, url, category, kind, priority, authoritative)``.
    A company with an authoritative source keeps only its authoritative
    entries and learns nothing from postings. Per node the highest priority
    wins, the earliest on ties; origins of the others are kept beside it.
    """
    reg = registry.withColumn("company", clean(C("company"))).filter("company is not null")
    preferred = reg.filter("authoritative and kind = 'source'").select(C("company").alias("__p")).distinct()
    settled = reg.filter("authoritative").unionByName(
        reg.filter("not authoritative").join(preferred, C("company") == C("__p"), "left_anti")
    )
    origin, own = F.lit(None).cast("string"), F.lit(None).cast("int")
    for kind, points in (("watch", F.lit(WATCH)), ("source", F.coalesce("priority", F.lit(REVIEWED))), ("spider", F.lit(SPIDER))):
        origin = F.when(C("kind") == kind, ORIGINS[kind]).otherwise(origin)
        own = F.when(C("kind") == kind, points).otherwise(own)
    known = settled.select("ord", "company", urls.source_url(C("url")).alias("url"), clean(C("category")).alias("category"), own.alias("priority"), origin.alias("origin"))

    label = F.coalesce(C("source_label"), F.lit(""))
    direct = label.contains("官网") | label.contains("企业官方") | has(clean(C("source")), "^(direct-official:|ats:|china-official)")
    seen = (
        jobs.withColumn("company", clean(C("company")))
        .filter("company is not null")
        .join(preferred, C("company") == C("__p"), "left_anti")
        .select(
            "ord", "company", clean(C("industry")).alias("category"), F.when(direct, OBSERVED_DIRECT).otherwise(OBSERVED).alias("priority"),
            F.posexplode(F.array("apply_url", "notice_url")).alias("pos", "raw"),
        )
        .withColumn("url", urls.board_root(C("raw")))
        .filter("url is not null")
        .filter(has(C("url"), vocab.CAREER_HINT) | has(urls.host(C("url")), vocab.BOARD_HINT))
        .select((C("ord") * 2 + C("pos") + 1_000_000_000_000).alias("ord"), "company", "url", "category", "priority", F.lit("observed-job").alias("origin"))
    )
    nodes = (
        known.filter("url is not null").withColumn("ord", C("ord").cast("bigint")).unionByName(seen)
        .withColumns({"priority": _clamped(C("priority")), "host": urls.host(C("url"))})
        .withColumn("key", urls.board_key(C("company"), C("url")))
    )
    # Winner and origins come out of one pass over the nodes: per origin the first node and their number, then per key.
    fields = ["company", "category", "url", "host", "priority", "origin"]
    place = F.struct((-C("priority")).alias("less"), C("ord"))
    counted = nodes.groupBy("key", "origin").agg(F.count("*").alias("n"), F.min(F.struct(place.alias("place"), *fields[:-1])).alias("first"))
    merged = counted.groupBy("key").agg(
        F.min(F.struct(C("first.place").alias("place"), *[C(f"first.{f}").alias(f) for f in fields[:-1]], "origin")).alias("first"),
        F.array_sort(F.collect_list(F.struct("origin", "n"))).alias("all"),
    )
    others = F.filter("all", lambda o: (o["origin"] != C("first.origin")) | (o["n"] > 1))
    return merged.select("key", *[C(f"first.{f}").alias(f) for f in fields], F.transform(others, lambda o: o["origin"]).alias("origins"))


def ranked(graph: DataFrame) -> DataFrame:
    return graph.orderBy(C("priority").desc(), "company", "host", "url")


def carry_health(graph: DataFrame, previous: DataFrame) -> DataFrame:
    """Attach the health a node had before; ``previous(key, health)``."""
    return graph.join(previous.select("key", "health"), "key", "left")


def visit_status(http_status: Column, jobs: Column) -> Column:
    reached = F.coalesce(http_status < 400, F.lit(False))
    return F.when(jobs > 0, "jobs-found").when(reached, "reachable-no-concrete-job").otherwise("request-failed")


def apply_health(graph: DataFrame, visits: DataFrame) -> DataFrame:
    """Overwrite health by the results of visits ``(key, http_status, jobs)``."""
    new = visits.select("key", visit_status(C("http_status"), C("jobs")).alias("__new"))
    return graph.join(new, "key", "left").withColumn("health", F.coalesce("__new", "health")).drop("__new")


def visit_summary(visits: DataFrame) -> DataFrame:
    ok = F.coalesce(C("http_status") < 400, F.lit(False))
    return visits.agg(F.count("*").alias("sampled"), F.count_if(ok).alias("reachable"), F.coalesce(F.sum("jobs"), F.lit(0)).alias("jobs"))


def status_key() -> Column:
    return F.lower(F.coalesce(clean(C("name")), clean(C("label")), clean(C("url"))))


def merge_status(priority: DataFrame, base: DataFrame) -> DataFrame:
    """First report per source, priority reports first; nameless ones all stay."""
    both = priority.withColumn("side", F.lit(0)).unionByName(base.withColumn("side", F.lit(1)))
    named = keep_first(both.filter(status_key().isNotNull()), [status_key()], [C("side"), C("ord")])
    return named.unionByName(both.filter(status_key().isNull()))


def later_stamp(priority: DataFrame, base: DataFrame) -> DataFrame:
    """One row: the later generated_at of the two reports."""
    return priority.select("generated_at").unionByName(base.select("generated_at")).agg(F.max("generated_at").alias("generated_at"))


def upsert_status(old: DataFrame, new: DataFrame, retired: list[str]) -> DataFrame:
    """Replace reports by name, new ones first, retired names dropped."""
    kept = old.join(new.select("name").distinct(), "name", "left_anti").withColumn("side", F.lit(1))
    return new.withColumn("side", F.lit(0)).unionByName(kept).filter(~C("name").isin(sorted(retired)))


def source_stats(jobs: DataFrame, by: str = "source", place: str = vocab.CAPITAL) -> DataFrame:
    """Counts per source: rows, distinct postings, companies, and signal rows."""
    return jobs.groupBy(by).agg(
        F.count("*").alias("rows"),
        F.countDistinct(clean(C("company"))).alias("companies"),
        F.count_if(C("location").contains(place)).alias("in_place"),
        F.count_if(C("company_type").contains("国有企业")).alias("state_owned"),
        F.count_if(C("graduation") == "2027届").alias("explicit_year"),
    )


def top_groups(jobs: DataFrame, by: str, group: str, n: int = 30, missing: str = "未分类") -> DataFrame:
    """Most frequent values of a column per source, by count then name."""
    counted = jobs.groupBy(by, F.coalesce(nonblank(C(group)), F.lit(missing)).alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(C("n").desc(), "value")
    return counted.withColumn("place", F.row_number().over(w)).filter(C("place") <= n)


def feed_state(feeds: DataFrame, status: DataFrame, as_of: str, stale_hours: int = 6) -> DataFrame:
    """One row saying which catalogue to serve and how healthy it is.

    ``feeds(feed, ok, rows)`` for priority, domestic, global, previous;
    ``status(name, ok, advertised, generated_at)``. A status that advertises
    rows while both catalogues are empty or failed is an inconsistency, not an
    empty market.
    """
    def of(feed: str, what: str) -> Column:
        return F.max(F.when(C("feed") == feed, C(what)))

    f = feeds.agg(
        *[F.coalesce(of(k, "rows"), F.lit(0)).alias(f"n_{k}") for k in ("priority", "domestic", "global", "previous")],
        F.count_if(C("feed").isin("priority", "domestic") & ~C("ok")).alias("failed"),
    )
    s = status.agg(
        F.coalesce(F.max("advertised"), F.lit(0)).alias("expected"), F.count_if("ok").alias("ok_sources"), F.count("*").alias("all_sources"),
        F.max("generated_at").alias("newest"),
    )
    both = f.select("*", *[s.select(c).scalar().alias(c) for c in ("expected", "ok_sources", "all_sources", "newest")])
    own = C("n_priority") + C("n_domestic")
    empty = own == 0
    chosen = (
        F.when(~empty, "merged").when((C("n_global") > 0) & ((C("expected") > 0) | (C("failed") == 2)), "global").when(C("n_previous") > 0, "previous").otherwise("none")
    )
    late = (F.lit(as_of).cast("timestamp").cast("bigint") - C("newest").cast("timestamp").cast("bigint")) > stale_hours * 3600
    return both.select(
        "expected", chosen.alias("chosen"),
        F.when(chosen == "none", "failed").when((chosen == "merged") & (C("failed") == 0), "healthy").otherwise("degraded").alias("state"),
        ((C("expected") > 0) & empty & (C("n_global") == 0)).alias("inconsistent"), F.coalesce(late, F.lit(True)).alias("stale"), "ok_sources", "all_sources",
    )
