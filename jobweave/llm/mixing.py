"""Mixing sources to target weights by temperature.

Shares of tokens by source are raised to an exponent and normalised. The
exponent is bisected: it is the largest one up to 1 whose weights reach the
target entropy, raised where a source would otherwise be repeated more often
than allowed. The weights times the budget give each source a quota, which is
filled with whole passes over its blocks and one last, partial pass; every pass
takes the blocks in an order of its own. DataFrame operations throughout.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stage

#: Jobs and bits a job of the bisection: 2**BITS - 1 exponents are tried at once.
JOBS, BITS = 6, 5
BLANKS = " \t\n\x0b\f\r"


def tokens(text: Column) -> Column:
    """White-space words of a text; null and blank texts have none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def scramble(*parts: Column | str) -> Column:
    """A number from 0 to 2**60 - 1 that any SQL engine can recompute."""
    joined = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long")


def _bisect(sources: DataFrame, measure: str, ok, rising: bool) -> float:
    """The end of [0, 1] or the point within where ``ok`` of the measured value turns.

    ``rising``: ok holds from some exponent on (its smallest is returned), else
    up to some exponent (its largest is returned).
    """
    low, high = 0.0, 1.0
    for job in range(JOBS + 1):
        points = [0.0, 1.0] if not job else [low + (high - low) * k / 2**BITS for k in range(1, 2**BITS)]
        values = sources.agg(*[F.expr(measure.format(a=repr(p))).alias(f"v{i}") for i, p in enumerate(points)]).first()
        flags = [ok(v) for v in values]
        if not job:
            if flags[0 if rising else 1]:
                return 0.0 if rising else 1.0
            if not flags[1 if rising else 0]:
                return 1.0 if rising else 0.0
            continue
        turn = flags.index(True) if rising and True in flags else flags.index(False) if not rising and False in flags else len(points)
        step = (high - low) / 2**BITS
        low, high = low + step * turn, low + step * (turn + 1)
    return high if rising else low


def weigh(sources: DataFrame, budget: float | None = None, entropy: float = 0.95, repeats: float = 2.0) -> DataFrame:
    """``sources`` (source, tokens > 0) with weight, quota and the exponent.

    ``entropy`` is the target as a share of that of equal weights, ``repeats``
    how often a token may be used on average, ``budget`` the tokens wanted in
    all (None: as many as there are). A budget of more than ``repeats`` times
    all tokens keeps the given shares, for no exponent can meet the limit.
    The driver sees sums over sources only.
    """
    total = sources.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not total.n:
        return sources.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"), F.lit(1.0).alias("exponent"))
    budget = float(total.t if budget is None else budget)
    share = f"(tokens / {float(total.t)!r}D)"
    power = f"pow({share}, {{a}}D)"
    spread = f"ln(sum({power})) - {{a}}D * sum({power} * ln({share})) / sum({power})"
    target = entropy * math.log(total.n)
    by_entropy = _bisect(sources, spread, lambda v: v >= target - 1e-12, rising=False)
    most = f"max({power} / tokens) * {budget!r}D / sum({power})"
    by_repeats = _bisect(sources, most, lambda v: v <= repeats + 1e-12, rising=True)
    exponent = max(by_entropy, by_repeats)
    scale = sources.agg(F.expr(f"sum({power.format(a=repr(exponent))})").alias("s")).first().s
    weight = F.expr(power.format(a=repr(exponent))) / F.lit(scale)
    return sources.select("source", "tokens", weight.alias("weight"), F.round(weight * F.lit(budget)).cast("long").alias("quota"), F.lit(exponent).alias("exponent"))


def mix(docs: DataFrame, budget: float | None = None, entropy: float = 0.95, repeats: float = 2.0, block_tokens: int = 200_000, salt: str = "mix") -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source, ...) the mixture takes, with tokens, epoch, block and block_rank.

    A source's documents are dealt to blocks of about ``block_tokens`` tokens
    by a hash of doc_id. In every epoch its blocks have another order; the last
    epoch ends within the block in which the quota is met, with the document
    that meets it. So a source exceeds its quota by less than one document.
    Documents appear once an epoch.

    Null sources are one source of their own, named ''. Sources without a token have
    no share and give no rows; documents without a token follow their block.
    Repeated rows count each. Columns with the names added are replaced. An
    empty table gives an empty result.
    """
    added = ["tokens", "epoch", "block", "block_rank"]
    rows = docs.drop(*added).withColumn("_source", F.coalesce("source", F.lit(""))).withColumn("tokens", tokens(F.col("text")))
    sources = stage(rows.groupBy(F.col("_source").alias("source")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "sources")
    weighed = stage(weigh(sources, budget, entropy, repeats), "weights")
    blocks_of = weighed.select(F.col("source").alias("_source"), F.ceil(F.col("tokens") / block_tokens).cast("long").alias("_blocks"))
    # One row a source: broadcast by the planner where small, else a join whose hot sources are split.
    rows = rows.join(blocks_of, "_source").withColumn("block", F.pmod(scramble(salt, F.col("doc_id")), "_blocks")).drop("_blocks")

    sizes = stage(rows.groupBy("_source", "block").agg(F.sum("tokens").alias("size")), "blocks")
    epochs = weighed.where("quota > 0").select(F.col("source").alias("_source"), "quota", F.col("tokens").alias("all"), F.explode(F.expr("sequence(0L, (quota - 1) div tokens)")).alias("epoch"))
    turn = sizes.join(epochs, "_source").withColumn("_order", scramble(salt, F.col("_source"), F.col("epoch"), F.col("block")))
    order = Window.partitionBy("_source", "epoch").orderBy("_order", "block")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turn = turn.withColumn("block_rank", F.row_number().over(order).cast("long")).withColumn("_need", F.col("quota") - F.col("epoch") * F.col("all") - before)
    taken = stage(turn.where("_need > 0").select("_source", "block", "epoch", "block_rank", F.when(F.col("_need") < F.col("size"), F.col("_need")).alias("_need")), "turns")

    whole = rows.join(taken.where("_need is null"), ["_source", "block"])
    # The block in which a quota is met, one a source: a running sum within the block.
    last = rows.join(taken.where("_need is not null"), ["_source", "block"])
    within = Window.partitionBy("_source", "block", "epoch").orderBy(scramble(salt, "within", F.col("doc_id")), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("_before", F.coalesce(F.sum("tokens").over(within), F.lit(0))).where("_before < _need")
    kept = [c for c in docs.columns if c not in added]
    return whole.select(*kept, *added).union(last.select(*kept, *added))


def oracle_sql(entropy: float = 0.95, repeats: float = 2.0, block_tokens: int = 200_000, salt: str = "mix") -> str:
    """doc_id, source, tokens, epoch, block and block_rank over the table ``documents`` in DuckDB's SQL."""
    def number(*parts: str) -> str:
        return f"cast('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15) as bigint)"

    steps = JOBS * BITS
    return rf"""
with recursive
rows as (
  select doc_id, coalesce(source, '') as source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::bigint as tokens from documents),
sources as (select source, sum(tokens)::bigint as tokens from rows group by source having sum(tokens) > 0),
total as (select sum(tokens)::double as t, count(*) as n from sources),
shares as (select source, tokens, tokens / t as p, t, n from sources, total),
entropy(step, low, high) as (
  select 0, 0.0::double, 1.0::double
  union all
  select step + 1, case when h >= goal then mid else low end, case when h >= goal then high else mid end from (
    select step, low, high, (low + high) / 2 as mid, {entropy} * ln(any_value(n)) - 1e-12 as goal,
      ln(sum(pow(p, (low + high) / 2))) - (low + high) / 2 * sum(pow(p, (low + high) / 2) * ln(p)) / sum(pow(p, (low + high) / 2)) as h
    from entropy, shares where step < {steps} group by step, low, high)),
repeat(step, low, high) as (
  select 0, 0.0::double, 1.0::double
  union all
  select step + 1, case when r <= {repeats} + 1e-12 then low else mid end, case when r <= {repeats} + 1e-12 then mid else high end from (
    select step, low, high, (low + high) / 2 as mid, max(pow(p, (low + high) / 2) / tokens) * any_value(t) / sum(pow(p, (low + high) / 2)) as r
    from repeat, shares where step < {steps} group by step, low, high)),
ends as (
  select -sum(p * ln(p)) >= {entropy} * ln(any_value(n)) - 1e-12 as given, ln(any_value(n)) >= {entropy} * ln(any_value(n)) - 1e-12 as reachable,
    max(1 / tokens) * any_value(t) / any_value(n) <= {repeats} + 1e-12 as equal_ok, {repeats} + 1e-12 >= 1 as given_ok from shares),
exponent as (
  select greatest(
    case when given then 1.0 when not reachable then 0.0 else (select low from entropy where step = {steps}) end,
    case when equal_ok then 0.0 when not given_ok then 1.0 else (select high from repeat where step = {steps}) end) as a from ends),
weights as (
  select source, tokens, round(pow(p, a) / sum(pow(p, a)) over () * t)::bigint as quota, ceil(tokens / {block_tokens})::bigint as blocks from shares, exponent),
dealt as (select r.*, {number(f"'{salt}'", "doc_id::varchar")} % w.blocks as block from rows r join weights w using (source)),
sizes as (select source, block, sum(tokens)::bigint as size from dealt group by source, block),
epochs as (select source, quota, tokens as everything, unnest(range(0, (quota - 1) // tokens + 1)) as epoch from weights where quota > 0),
turns as (
  select source, block, epoch, size, row_number() over o as block_rank, quota - epoch * everything - (sum(size) over o - size) as need
  from (select *, {number(f"'{salt}'", "source", "epoch::varchar", "block::varchar")} as ord from sizes join epochs using (source))
  window o as (partition by source, epoch order by ord, block rows unbounded preceding)),
placed as (
  select d.doc_id, d.source, d.tokens, t.epoch, d.block, t.block_rank, t.need, t.size,
    sum(d.tokens) over (partition by d.source, d.block, t.epoch order by {number(f"'{salt}'", "'within'", "d.doc_id::varchar")}, d.doc_id rows unbounded preceding) - d.tokens as before
  from dealt d join turns t on t.source = d.source and t.block = d.block where t.need > 0)
select doc_id, source, tokens, epoch::bigint as epoch, block::bigint as block, block_rank::bigint as block_rank from placed where need >= size or before < need
"""
