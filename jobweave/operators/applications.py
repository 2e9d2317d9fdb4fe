"""Tracking of applications through their stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab

C = F.col
# --- fixed values: score from which a tracked posting is top priority -----------
TOP_PRIORITY = 72


def promote(matches: DataFrame, applications: DataFrame, day: str, resume: str) -> DataFrame:
    """New records for matches not tracked yet."""
    tracked = applications.select(C("source_job_id").alias("__t"))
    return matches.join(tracked, C("id") == C("__t"), "left_anti").select(
        C("id").alias("source_job_id"), "company", "role", "location",
        F.when(C("score") >= TOP_PRIORITY, "A").otherwise("B").alias("priority"),
        F.lit(vocab.STAGES[0]).alias("status"), F.lit(day).alias("status_date"), F.lit(resume).alias("resume_version"), C("score").alias("match_at_save"),
    )


def previous_value(df: DataFrame, key: str, value: str, order: list[str], slice_of: Column, out: str = "previous") -> DataFrame:
    """``lag(value)`` per key without ever holding a whole key in one task.

    Rows are cut into time slices. Inside a slice an ordinary window works;
    the first row of a slice takes the last value of the key's previous slice,
    found among one row per key and slice.
    """
    sliced = df.withColumn("__slice", slice_of)
    inside = Window.partitionBy(key, "__slice").orderBy(*order)
    near = sliced.withColumns({"__near": F.lag(value).over(inside), "__n": F.row_number().over(inside)})
    ends = sliced.groupBy(key, "__slice").agg(F.max_by(value, F.struct(*order)).alias("__end"))
    across = Window.partitionBy(key).orderBy("__slice")
    before = ends.select(key, "__slice", F.lag("__end").over(across).alias("__far"))
    joined = near.join(before, [key, "__slice"])
    return joined.withColumn(out, F.when(C("__n") == 1, C("__far")).otherwise(C("__near"))).drop("__slice", "__near", "__n", "__far")


def stage_transitions(events: DataFrame, slice_of: Column | None = None) -> DataFrame:
    """Events where the status differs from the one before; ``events(event_id,
    job_no, ts, status)``."""
    by_day = F.date_trunc("day", "ts") if slice_of is None else slice_of
    rows = previous_value(events, "job_no", "status", ["ts", "event_id"], by_day)
    return rows.filter(C("previous").isNull() | (C("previous") != C("status")))


def with_current(timeline: Column, status: Column, day: Column) -> Column:
    """Recorded events, and the current state unless it is the last of them."""
    last = F.try_element_at(timeline, F.lit(-1))
    current = F.array(F.struct(status.alias("status"), F.coalesce(day, F.lit("")).alias("date")))
    differs = last.isNull() | (last["status"] != status) | (F.coalesce(last["date"], F.lit("")) != F.coalesce(day, F.lit("")))
    kept = F.filter(timeline, lambda e: e["status"].isNotNull() & (e["status"] != ""))
    return F.when(status.isNotNull() & (status != "") & differs, F.concat(kept, current)).otherwise(kept)


def timeline(applications: DataFrame, visible: int = 4) -> DataFrame:
    """Last events of every application and how many are hidden before them."""
    rows = applications.withColumn("__all", with_current(C("timeline"), C("status"), C("status_date")))
    n = F.size("__all")
    return rows.withColumns(
        {"events": n, "hidden": F.greatest(F.lit(0), n - visible), "shown": F.slice("__all", F.greatest(F.lit(1), n - visible + 1), visible)}
    ).filter(C("events") > 0).drop("__all")


def recent_timelines(transitions: DataFrame, keep: int = 4) -> DataFrame:
    """Per job the number of transitions and the last ``keep`` of them."""
    w = Window.partitionBy("job_no").orderBy(C("ts").desc(), C("event_id").desc())
    last = transitions.withColumn("__n", F.row_number().over(w)).filter(C("__n") <= keep)
    shown = last.groupBy("job_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "status", "day"))), lambda e: F.struct(e["status"].alias("status"), e["day"].alias("date"))).alias("shown")
    )
    return transitions.groupBy("job_no").agg(F.count("*").alias("events")).join(shown, "job_no")


def stage_counts(applications: DataFrame, priority: str | None = None, direction: str | None = None, text: str = "") -> DataFrame:
    """Applications per stage in stage order, empty stages included."""
    rows = applications
    if priority is not None:
        rows = rows.filter(C("priority") == priority)
    if direction is not None:
        rows = rows.filter(C("direction") == direction)
    if text.strip():
        blob = F.lower(F.concat_ws(" ", *[F.coalesce(C(c), F.lit("")) for c in ("company", "role", "location", "direction")]))
        rows = rows.filter(blob.contains(text.strip().lower()))
    stages = applications.sparkSession.createDataFrame(list(enumerate(vocab.STAGES)), "stage_no int, status string")
    counted = rows.groupBy("status").agg(F.count("*").alias("n"))
    return F.broadcast(stages).join(counted, "status", "left").select("stage_no", "status", F.coalesce("n", F.lit(0)).alias("n"))


def funnel(applications: DataFrame) -> DataFrame:
    """Selected, applied, interviewed, offered; a rejection counts as applied."""
    one = applications.agg(
        F.count("*").alias("selected"), F.count_if(~C("status").isin(vocab.NOT_APPLIED)).alias("applied"),
        F.count_if(C("status").isin(vocab.INTERVIEW + vocab.OFFERS)).alias("interviewed"), F.count_if(C("status").isin(vocab.OFFERS)).alias("offered"),
    )
    steps = ["selected", "applied", "interviewed", "offered"]
    widest = F.greatest(F.lit(1), *[C(s) for s in steps])
    rows = F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(s).alias("step"), C(s).alias("n"), (C(s) / widest * 100).alias("width")) for i, s in enumerate(steps)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def cycle_times(events: DataFrame) -> DataFrame:
    """Per job the days from its first application to its first interview."""
    firsts = events.groupBy("job_no").agg(
        *[F.min_by("day", F.when(test, F.struct("ts", "event_id"))).alias(name) for name, test in (("applied", C("status") == "applied"), ("met", C("status").isin(vocab.INTERVIEW)))]
    )
    days = F.greatest(F.lit(0), F.datediff(C("met").cast("date"), C("applied").cast("date")))
    return firsts.filter("applied is not null and met is not null").select("job_no", days.alias("days"))


def cycle_time(events: DataFrame) -> DataFrame:
    """One row: rounded mean of cycle_times, null without any."""
    return cycle_times(events).agg(F.floor(F.avg("days") + 0.5).alias("mean_days"), F.count("*").alias("jobs"))


def match_feedback(applications: DataFrame, min_n: int = 3) -> DataFrame:
    scored = C("match_at_save").isNotNull()
    met = scored & C("status").isin(vocab.INTERVIEW + vocab.OFFERS)
    one = applications.agg(F.count_if(scored).alias("scored"), F.count_if(met).alias("interviewed"))
    return one.select("scored", F.when(C("scored") >= min_n, C("interviewed")).alias("interviewed"))


def reviews_with_job(reviews: DataFrame, applications: DataFrame) -> DataFrame:
    """Reviews newest first with the company they belong to."""
    jobs = applications.select(C("id").alias("job_id"), "company")
    return reviews.join(jobs, "job_id", "left").withColumn("chars", F.length("content")).orderBy(C("day").desc(), "id")


def library_usage(applications: DataFrame, decisions: DataFrame) -> DataFrame:
    """Applications per résumé version, and decisions by kind."""
    used = applications.groupBy(C("resume_version").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("resume"))
    decided = decisions.groupBy(C("decision").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("decision"))
    return used.unionByName(decided).select("kind", "name", "n")
