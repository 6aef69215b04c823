"""Windows over keys that may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Sampled rows per range: ranges then differ in size by a factor of two at most, almost surely.
SAMPLED_PER_RANGE = 20


@dataclass(frozen=True)
class Ranges:
    """Where the ranges of (keys, order) begin but for the first: one struct per boundary, in order."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    types: tuple[str, ...]
    starts: tuple[tuple, ...]

    def _literals(self, count: int) -> Column:
        fields = [[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(s, self.types, strict=True))][:count] for s in self.starts]
        return F.array(*[F.struct(*f) for f in fields])

    def number(self, df: DataFrame) -> Column:
        """The range of a row: how many boundaries are not after it, found by halving."""
        if not self.starts:
            return F.lit(0)
        place = F.struct(*[_comparable(df, c).alias(f"k{i}") for i, c in enumerate((*self.keys, *self.order))])
        starts, n = self._literals(len(self.types)), len(self.starts)
        steps = F.array(*[F.lit(1 << b) for b in range(n.bit_length() - 1, -1, -1)])
        return F.aggregate(steps, F.lit(0), lambda at, s: F.when(
            (at + s <= n) & (F.get(starts, at + s - 1) <= place), at + s).otherwise(at))

    def goes_on(self, df: DataFrame, number: str) -> Column:
        """Whether the row's key may have rows in another range: it is the key of a boundary of its own range."""
        key = F.struct(*[_comparable(df, c).alias(f"k{i}") for i, c in enumerate(self.keys)])
        starts = self._literals(len(self.keys))
        below, above = F.get(starts, F.col(number) - 1), F.get(starts, F.col(number))
        return ((F.col(number) > 0) & below.eqNullSafe(key)) | ((F.col(number) < len(self.starts)) & above.eqNullSafe(key))


def _comparable(df: DataFrame, name: str) -> Column:
    """A value that survives the way to the driver and back unchanged."""
    kind = df.schema[name].dataType.simpleString()
    if kind == "timestamp":
        return F.unix_micros(F.col(f"`{name}`"))
    return F.unix_date(F.col(f"`{name}`")) if kind == "date" else F.col(f"`{name}`")


def ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Ranges:
    """As many ranges of rows as the session has shuffle partitions, by a sample of keys and order columns.

    Every task keeps the sample's size at most; only the sample comes to the driver.
    """
    columns = [*keys, *order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = df.select(*[_comparable(df, c).alias(f"k{i}") for i, c in enumerate(columns)])
    sample = places.withColumn("_at", F.rand(1)).orderBy("_at").limit(n * SAMPLED_PER_RANGE).drop("_at")
    rows = [tuple(r) for r in sample.orderBy(*places.columns).collect()]
    starts = sorted(set(range(SAMPLED_PER_RANGE, len(rows), SAMPLED_PER_RANGE))) if n > 1 else []
    return Ranges(tuple(keys), tuple(order), tuple(places.schema[c].dataType.simpleString() for c in places.columns), tuple(rows[i] for i in starts))


def neighbour(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column | str, out: str, step: int = 1, known: Ranges | None = None,
) -> DataFrame:
    """Value of the next (``step=1``) or previous (``step=-1``) row of the same key.

    The rows get the number of their range of the key and the whole order, so a key of any size spreads over as many
    ranges as its rows fill, also where many rows share the first order column.  One shuffle brings each key's rows of
    a range together, sorted; there the neighbour is taken.  What lies beyond a range's edge is looked up among the
    edges: of each range, the two keys at most that may go on in another, aggregated before they are shuffled.
    ``known``: the ranges of an earlier call on rows of the same keys and order.
    """
    value = F.col(value) if isinstance(value, str) else value
    shift, edge = (F.lead, F.min_by) if step > 0 else (F.lag, F.max_by)
    found = known or ranges(df, keys, order)
    ranged = df.select("*", F.struct(value.alias("v")).alias("_v"), found.number(df).alias("_range"))
    near = ranged.withColumn("_near", shift("_v").over(W.partitionBy(*keys, "_range").orderBy(*order)))
    if not found.starts:
        return near.select(*df.columns, F.col("_near.v").alias(out))
    edges = ranged.where(found.goes_on(ranged, "_range")).groupBy(*keys, "_range").agg(edge("_v", F.struct(*order)).alias("_edge"))
    beyond = edges.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_range").alias("_at"),
        shift("_edge").over(W.partitionBy(*keys).orderBy("_range")).alias("_beyond"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    # Two rows per range at most.
    joined = near.join(F.broadcast(beyond), same & (F.col("_range") == F.col("_at")), "left")
    return joined.select(*df.columns, F.coalesce("_near", "_beyond")["v"].alias(out))


def following(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], target: Column, value: Column, out: str,
) -> DataFrame:
    """Value of the next row of the same key that is a ``target``, in one shuffle as ``neighbour``.

    The frame runs backwards over a key's rows of one range, so each row is visited once.
    """
    found = ranges(df, keys, order)
    own = F.when(target, F.struct(value.alias("v")))
    ranged = df.select("*", own.alias("_v"), found.number(df).alias("_range"))
    backwards = W.partitionBy(*keys, "_range").orderBy(*[F.col(c).desc() for c in order]).rowsBetween(W.unboundedPreceding, -1)
    near = ranged.withColumn("_near", F.last("_v", ignorenulls=True).over(backwards))
    if not found.starts:
        return near.select(*df.columns, F.col("_near.v").alias(out))
    edges = ranged.where(found.goes_on(ranged, "_range")).groupBy(*keys, "_range").agg(
        F.min_by(F.col("_v"), F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_edge"))
    later = W.partitionBy(*keys).orderBy(F.col("_range").desc()).rowsBetween(W.unboundedPreceding, -1)
    beyond = edges.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_range").alias("_at"),
        F.last("_edge", ignorenulls=True).over(later).alias("_beyond"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    joined = near.join(F.broadcast(beyond), same & (F.col("_range") == F.col("_at")), "left")
    return joined.select(*df.columns, F.coalesce("_near", "_beyond")["v"].alias(out))
