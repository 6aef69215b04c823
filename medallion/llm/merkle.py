"""Merkle manifest of a table: leaf digests, a subtree per group, proofs, and roots folded from proofs.

A node's digest is the lower-case hex sha256 of its children's hex digests put together.  Leaves of a group ascend by
their key; while more than one node remains, every ``arity`` neighbours have one parent.  The groups' roots, in order
of the group, are the leaves of one more tree, whose root stands for the table.

Leaves are numbered by a range shuffle and one row per range.  ``arity ** depth`` leaves with one number of block lie in
one partition of one window, in order; there, level ``l`` lives on the rows that are the first of ``arity ** l``
leaves.  On these rows, lag and lead columns of the fixed offsets ``j * arity ** l`` hold the siblings, masked by the
row's slot among its siblings and by the number of nodes of the level; rows of slot 0 hash the parent.  Carrying the
last value forward gives every leaf the siblings of its ancestors.  A block's root is one row of the next table, built in
the same way, until a group has one row.  So a group of any size is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

ARITY = 2
#: Levels within one block: 2 ** 14 leaves share a window.
DEPTH = 14
#: Rows of a counted side that is broadcast: at most a kilobyte or two each.
BROADCAST_ROWS = 10_000


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of texts put together."""
    return F.sha2(F.concat(*parts), 256)


def field(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


def _sized(side: DataFrame, rows: int) -> DataFrame:
    """Broadcast up to a counted number of rows; beyond, the join is shuffled, and split where a key is hot."""
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def _numbered(leaves: DataFrame) -> DataFrame:
    """``idx`` of each row within its group from 0, and ``n``, the rows of the group.

    The sorted ranges are written with each row's place; a group's rows in a range have places one after another, so
    one row per group and range (at most as many as ranges and groups) gives the number of its first row.
    """
    ranged = leaves.repartitionByRange("g", "key", "leaf", "row").sortWithinPartitions("g", "key", "leaf", "row").drop("row")
    ranged = written(ranged.withColumn("place", F.monotonically_increasing_id()).withColumn("range", F.spark_partition_id()), "merkle-ranges")
    runs = ranged.groupBy("g", "range").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    group = W.partitionBy("g").orderBy("range")
    runs = runs.select(
        F.col("g").alias("_g"), F.col("range").alias("_range"),
        (F.coalesce(F.sum("rows").over(group.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(W.partitionBy("g")).alias("n"))
    joined = ranged.join(runs, ranged["g"].eqNullSafe(runs["_g"]) & (ranged["range"] == runs["_range"]))
    return joined.withColumn("idx", F.col("place") + F.col("shift")).drop("place", "shift", "range", "_g", "_range")


def _levels(nodes: DataFrame, arity: int, depth: int) -> DataFrame:
    """Adds to rows ``g, idx, n, h`` the column ``steps`` (siblings left and right, per level) and ``top``.

    ``top`` is the digest of the block's root on the block's first row.  A level with one node in the group is none.
    """
    block = F.floor(F.col("idx") / F.lit(arity ** depth)).cast("long")
    rows = nodes.withColumn("block", block)
    ordered = W.partitionBy("g", "block").orderBy("idx")
    carried = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    node, steps = F.col("h"), []
    for level in range(depth):
        span = arity ** level
        slot = F.floor(F.col("idx") / F.lit(span)).cast("long") % arity
        more = F.col("n") > F.lit(span)  # more than one node on this level
        first = (F.col("idx") % span == 0) & more
        rows = rows.withColumn(f"h{level}", node)
        lags = [F.when(first & (slot >= j), F.lag(f"h{level}", j * span).over(ordered)) for j in range(arity - 1, 0, -1)]
        leads = [F.when(first & (slot < arity - j) & (F.col("idx") + j * span < F.col("n")), F.lead(f"h{level}", j * span).over(ordered))
                 for j in range(1, arity)]
        rows = rows.withColumn(f"s{level}", F.when(first, F.struct(F.concat_ws("", *lags).alias("l"), F.concat_ws("", *leads).alias("r"))))
        parent = F.sha2(F.concat(F.col(f"h{level}"), F.col(f"s{level}.r")), 256)
        node = F.when(first & (slot == 0), parent).when(~more, F.col(f"h{level}"))
        steps.append(F.last(f"s{level}", ignorenulls=True).over(carried))
    rows = rows.withColumn("top", F.when(F.col("idx") % (arity ** depth) == 0, node))
    found = rows.select(*nodes.columns, "block", "top", F.array(*steps).alias("steps"))
    return found.withColumn("steps", F.filter("steps", lambda s: s.isNotNull()))


def tree(nodes: DataFrame, arity: int = ARITY, depth: int = DEPTH, most: int | None = None) -> DataFrame:
    """Rows ``g, idx, n, h`` with ``root`` of the group and ``steps``, the siblings on the way up to it.

    ``most``: the rows of the largest group, if known; blocks of blocks are built until a group of it has one row.
    """
    if most is None:
        most = nodes.agg(F.max("n")).first()[0] or 0
    depth = next((d for d in range(1, depth) if arity ** d >= most), depth)  # no more windows than levels
    levels = written(_levels(nodes, arity, depth), "merkle-levels")
    size = arity ** depth
    tops = levels.where(F.col("idx") % size == 0).select(
        "g", F.col("block").alias("idx"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("top").alias("h"))
    if most <= size:
        none = F.array().cast(levels.schema["steps"].dataType)
        above = tops.select(F.col("g").alias("_g"), F.col("idx").alias("_idx"), F.col("h").alias("root"), none.alias("upper"))
    else:
        above = tree(tops, arity, depth, -(-most // size)).select(
            F.col("g").alias("_g"), F.col("idx").alias("_idx"), "root", F.col("steps").alias("upper"))
    above = _sized(above, tops.count())
    joined = levels.join(above, levels["g"].eqNullSafe(above["_g"]) & (levels["block"] == above["_idx"]))
    return joined.withColumn("steps", F.concat("steps", "upper")).drop("upper", "_g", "_idx", "block", "top")


def proof(steps: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]), 256))


def manifest(
    df: DataFrame, group: str, key: str, fields: Sequence[str], check: Column | None = None,
    carry: Sequence[str] = (), arity: int = ARITY, depth: int = DEPTH,
) -> DataFrame:
    """Columns ``c0``, ... (those of ``carry``), ``leaf``, ``subroot``, ``root``, ``steps`` and, with ``check``, ``checked``.

    A leaf is the digest of ``fields``, each as ``field`` writes it.  ``check``: another leaf column per row, carried along
    so that ``fold(checked, steps)`` can be held against ``root``.  Groups: null first, then by the bytes of the text.
    Only keys, digests and siblings are shuffled, never the fields.

    Null key: first.  Null field: ``-``, unlike the empty text.  Equal keys: by leaf digest; repeated rows are leaves
    each.  One row in all: its leaf is the root and it has no siblings.  Empty table: no rows.  Long texts are hashed
    where they are read.  Other columns are not read, and may have any name.
    """
    leaf = digest(*(field(_column(f)) for f in fields))
    extra = {f"c{i}": _column(c) for i, c in enumerate(carry)} | ({"checked": check} if check is not None else {})
    leaves = written(df.select(
        _column(group).cast("string").alias("g"), _column(key).alias("key"), leaf.alias("leaf"), F.monotonically_increasing_id().alias("row"),
        *(c.alias(n) for n, c in extra.items())), "merkle-leaves")
    below = tree(_numbered(leaves).withColumn("h", F.col("leaf")), arity, depth)
    roots = below.where("idx = 0").select(F.lit(0).alias("g"), F.col("g").alias("key"), F.col("root").alias("h"))
    roots = written(roots, "merkle-roots")  # one row per group
    n_groups = roots.count()
    ranked = _numbered(roots.select("g", F.col("key"), F.col("h").alias("leaf"), F.lit(0).alias("row"), "h"))
    above = tree(ranked, arity, depth, n_groups).select(
        F.col("key").alias("_g"), F.col("root").alias("table_root"), F.col("steps").alias("upper"))
    joined = below.join(_sized(above, n_groups), below["g"].eqNullSafe(above["_g"]))
    return joined.select(
        *extra, "leaf", F.col("root").alias("subroot"), F.col("table_root").alias("root"), F.concat("steps", "upper").alias("steps"))
