"""A uniform random shuffle into shards of exact size, by a hypergeometric communication matrix.

How many rows of each block go to each shard is drawn first, as exact counts: the rows of a uniform shuffle
would fall like that.  Then each block's rows are ordered at random and cut at the drawn counts, they are
exchanged, and each shard's rows are ordered at random again.  No task sorts more than a block or a bucket of
a shard, and everything that touches rows is DataFrame functions.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frame, fresh, written

SHARDS = 16
SEED = 20
#: A block has 2 to this power of rows at most; a bucket of a shard about as many.
BLOCK_BITS = 18
#: A matrix of more counts than this isn't broadcast.
BROADCAST_CELLS = 1_000_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Exact draw (to double precision) of how many of ``draws`` from an urn are good.

    The weights follow from each other by ratios, outward from the most likely count, so neither factorials nor
    the urn's size limit it; the work is a few standard deviations.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    weights = {mode: 1.0}
    weight, k = 1.0, mode
    while k < high and weight > 1e-20:
        weight *= (good - k) * (draws - k) / ((k + 1) * (bad - draws + k + 1))
        k += 1
        weights[k] = weight
    weight, k = 1.0, mode
    while k > low and weight > 1e-20:
        weight *= k * (bad - draws + k) / ((good - k + 1) * (draws - k + 1))
        k -= 1
        weights[k] = weight
    point = rng.random() * sum(weights.values())
    for k, weight in weights.items():
        point -= weight
        if point <= 0:
            return k
    return mode


def communication_matrix(blocks: list[int], shards: list[int], seed: int = SEED) -> list[list[int]]:
    """Rows of each block (sizes ``blocks``) for each shard (sizes ``shards``, of the same sum)."""
    rng, left, matrix = random.Random(seed), list(shards), []
    for size in blocks:
        row, rest, others = [], size, sum(left)
        for s, room in enumerate(left):
            others -= room
            take = hypergeometric(rng, room, others, rest)
            left[s], rest = room - take, rest - take
            row.append(take)
        matrix.append(row)
    return matrix


def result_columns(df: DataFrame) -> tuple[str, str]:
    """Names of the two columns that ``shuffle`` adds."""
    return fresh(df.columns, "shard"), fresh(df.columns, "slot")


def shuffle(df: DataFrame, shards: int = SHARDS, seed: int = SEED, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The rows of ``df`` with ``shard`` (from 0, sizes at most one apart) and ``slot`` (gapless from 0 in the shard).

    Every row counts on its own: nulls, empty and long texts, repeated rows and rows of one key or text are spread alike.
    The results are the last two columns; where ``df`` has a column of that name, theirs begins with underscores.  An
    empty table gives no rows.  The rows are written once, so that
    a lost executor cannot deal them out anew; the driver holds a count for each block and shard, and a block is
    hundreds of thousands of rows.
    """
    shard, slot = result_columns(df)
    row, block, rank, cuts, order, bucket, before = (
        fresh(df.columns, n) for n in ("row_no", "block_no", "block_rank", "block_cuts", "slot_order", "bucket_no", "bucket_start"))
    rows = written(df.withColumn(row, F.monotonically_increasing_id()), "to-shard")
    blocked = rows.withColumn(block, F.shiftright(row, block_bits))
    counts = sorted((r[0], r[1]) for r in blocked.groupBy(block).count().collect())
    total = sum(n for _, n in counts)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    ends = [(b, [sum(line[:s + 1]) for s in range(shards - 1)]) for (b, _), line in zip(counts, matrix, strict=True)]
    table = frame(df.sparkSession, ends, f"`{block}` long, `{cuts}` array<long>")
    if len(ends) * shards <= BROADCAST_CELLS:
        table = F.broadcast(table)  # else joined on the key the rows are partitioned by already

    within = Window.partitionBy(block).orderBy(F.xxhash64(F.lit(seed), row), row)
    dealt = (
        blocked.withColumn(rank, F.row_number().over(within) - 1)
        .join(table, block)
        .withColumn(shard, F.size(F.filter(cuts, lambda c: c <= F.col(rank))))
    )
    bits = max(0, (total // shards).bit_length() - block_bits)
    key = F.xxhash64(F.lit(seed + 1), row)
    dealt = dealt.withColumn(order, key).withColumn(
        bucket, F.shiftrightunsigned(order, 64 - bits) if bits else F.lit(0).cast("long"))
    starts = dealt.groupBy(shard, bucket).count().select(
        shard, bucket,
        (F.sum("count").over(Window.partitionBy(shard).orderBy(bucket)) - F.col("count")).alias(before))
    again = Window.partitionBy(shard, bucket).orderBy(order, row)
    return (
        dealt.withColumn(slot, F.row_number().over(again) - 1)
        .join(starts, [shard, bucket])
        .withColumn(slot, (F.col(slot) + F.col(before)).cast("long"))
        .select(*(F.col(f"`{c}`") for c in df.columns), shard, slot)
    )


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write the shuffled rows, one folder for each shard, in files sorted by slot."""
    shard, slot = result_columns(df)
    shuffle(df, shards, seed).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
