"""Merkle manifest of a dataset: per level, lag and lead columns supply siblings, first children hash parents.

Leaves of one tree ascend by position; while a tree has more than one node,
every ``ARITY`` consecutive nodes become their hash. Trees of all groups grow
together, one level a round: a window over (tree, parent) holds at most
``ARITY`` rows, so a group with a third of all rows is dealt like any other.
Proofs come down the same way, one join a level, and each document folds its
own proof.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fold, narrow, stage
from .ordering import numbered

ARITY = 3
#: Rows of one stretch of positions that find their tree's bounds together.
CELL = 256


def _nothing() -> Column:
    return F.array().cast("array<struct<left:string,right:string>>")
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the parts' text, one behind the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """Digest of one document; ``changed`` gives other values than the column of that name."""
    return digest(*[field(changed.get(name, F.col(name))) for name in FIELDS])


def placed(leaves: DataFrame, group: str, *order: str) -> DataFrame:
    """Rows with ``tree`` (position of their group's first row), ``place`` in it and its ``size``.

    Groups ascend with nulls first, and so do their ``tree`` numbers. Rows find
    their group's bounds by (cell of ``CELL`` positions, group), so a large
    group's rows stay dealt over as many keys as it has cells.
    """
    rows = numbered(leaves, group, *order).withColumn("cell", F.expr(f"position div {CELL}"))
    spans = rows.groupBy("cell", group).agg(F.min("position").alias("first"), F.count("*").alias("n"))
    bounds = spans.groupBy(F.col(group).alias("of")).agg(F.min("first").alias("tree"), F.sum("n").alias("size"))
    spans = spans.select(F.col("cell").alias("at"), F.col(group).alias("own"))
    known = stage(spans.join(bounds, F.col("own").eqNullSafe(F.col("of"))).drop("of"), "spans")
    found = rows.join(known, (F.col("cell") == F.col("at")) & F.col(group).eqNullSafe(F.col("own")))
    return found.withColumn("place", F.col("position") - F.col("tree")).drop("cell", "at", "own", "position")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Nodes of one level (tree, place, size, hash) with their parent's place and the hashes beside them.

    ``slot`` is a node's place in its run and ``run`` that run's length: lags
    reach back no further than the slot, leads no further than the run.
    ``beside`` holds the one (left, right) pair, and is empty for a lone root.
    First children of longer trees get ``above``, the hash of their run; it is
    null for all others.
    """
    within = Window.partitionBy("tree", "parent").orderBy("place")
    ranged = nodes.withColumn("parent", F.expr(f"place div {ARITY}")).withColumn("slot", F.col("place") % ARITY)
    ranged = ranged.withColumn("run", F.least(F.lit(ARITY), F.col("size") - F.col("parent") * ARITY))
    back = [F.when(F.col("slot") >= k, F.lag("hash", k).over(within)) for k in range(ARITY - 1, 0, -1)]
    ahead = [F.when(F.col("slot") + k < F.col("run"), F.lead("hash", k).over(within)) for k in range(1, ARITY)]
    sided = ranged.withColumn("left", F.concat_ws("", *back)).withColumn("right", F.concat_ws("", *ahead))
    sided = sided.withColumn("above", F.when((F.col("slot") == 0) & (F.col("size") > 1), digest(F.col("hash"), F.col("right"))))
    return sided.withColumn("beside", F.when(F.col("size") > 1, F.array(F.struct("left", "right"))).otherwise(_nothing())).drop("slot", "run", "left", "right")


def grow(leaves: DataFrame) -> list[DataFrame]:
    """The levels of all trees, leaves first, each a table of the shared folder.

    ``leaves`` has tree, place, size and hash; further columns stay on the
    first level. A tree ends at the level where its size is 1. The number of
    levels is the logarithm of the largest tree.
    """
    largest = leaves.agg(F.max("size")).first()[0] or 0
    levels = [stage(with_siblings(leaves), "level")]
    while largest > 1:
        largest = -(-largest // ARITY)
        size = F.expr(f"(size + {ARITY - 1}) div {ARITY}").alias("size")
        parents = levels[-1].where("above is not null").select("tree", F.col("parent").alias("place"), size, F.col("above").alias("hash"))
        levels.append(stage(with_siblings(parents), "level"))
    return levels


def prove(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The first level with ``proof``, the (left, right) pairs from a leaf to the end, and the columns of ``tops``.

    ``tops`` has one row a tree: ``tree``, ``rest`` (the pairs above that
    tree's root) and any columns to hand down. It meets each tree at its root,
    one row a tree, so no tree's size can skew that join.
    """
    given = [c for c in tops.columns if c not in ("tree", "rest")]
    above = None
    for level in reversed(levels):
        ends = level.where("size = 1").join(tops, "tree").withColumn("proof", F.concat("beside", "rest")).drop("rest")
        if above is not None:
            inner = level.where("size > 1").join(above, ["tree", "parent"]).withColumn("proof", F.concat("beside", "higher")).drop("higher")
            ends = ends.unionByName(inner)
        proven = ends
        above = proven.select("tree", F.col("place").alias("parent"), F.col("proof").alias("higher"), *given)
    return proven.drop("beside", "above", "parent")


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, root) of every tree."""
    ends = [level.where("size = 1").select("tree", F.col("hash").alias("root")) for level in levels]
    out = ends[0]
    for more in ends[1:]:
        out = out.union(more)
    return out


def folded(start: Column, proof: Column) -> Column:
    """The root that a digest leads to by its proof."""
    return F.aggregate(proof, start, lambda held, pair: digest(pair["left"], held, pair["right"]))


def proof_digest(proof: Column) -> Column:
    return digest(F.concat_ws("", F.transform(proof, lambda pair: F.concat(pair["left"], pair["right"]))))


def manifest(docs: DataFrame, changed_text: Column | None = None, changed: Column | None = None) -> DataFrame:
    """Digests and verdict of every row of ``docs`` (the columns of ``FIELDS``).

    Returns doc_id, leaf, subroot (of the row's source), root (over all
    sources), proof_sha256, folded_root and verified. Where ``changed`` holds,
    the text is ``changed_text`` when the proof is folded, so ``verified`` tells
    whether that alters the leaf; without it all rows are folded as they are.

    Rows ascend by doc_id, nulls first; rows with one doc_id by their leaf, so
    repeated rows get neighbouring places and a proof each. A null source is a
    source of its own, before all others; null fields hash as ``-``. Empty texts
    hash as ``0:``. No rows give no rows. Texts are read once and never
    shuffled. Extra columns are ignored.
    """
    told = narrow(docs, *FIELDS).withColumn("hash", leaf())
    altered = leaf(text=F.when(F.coalesce(changed, F.lit(False)), changed_text).otherwise(F.col("text"))) if changed is not None else F.col("hash")
    told = told.withColumn("seen", altered).select("source", "doc_id", "hash", "seen")
    levels = grow(placed(told, "source", "doc_id", "hash").drop("source"))
    subroots = numbered(roots(levels), "tree", position="place")
    n = F.lit(subroots.count()).cast("long")
    crown = grow(subroots.select(F.col("tree").alias("of"), F.lit(0).cast("long").alias("tree"), "place", n.alias("size"), F.col("root").alias("hash")))
    proven = prove(crown, roots(crown).withColumn("rest", _nothing()))
    tops = stage(proven.select(F.col("of").alias("tree"), F.col("hash").alias("subroot"), "root", F.col("proof").alias("rest")), "tops")
    rows = prove(levels, tops).withColumn("folded_root", folded(F.col("seen"), F.col("proof")))
    return rows.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def without_line_ends(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, folded from texts without line ends in every second document by hash of its id."""
    return manifest(docs, F.translate(docs.text, "\n", ""), fold(docs.doc_id, 2) == 0)
