"""Stupid-backoff scores of documents from n-gram counts of the whole corpus.

The corpus is its own training text, so a document is scored by the counts of all other documents: its own
n-grams are taken off each count first.  A word scores ``count(n-gram) / count(context)`` with the longest
context whose n-gram other documents hold, times ``BACKOFF`` for each word of context given up; a word that
others never use counts as one in all their words and one.

N-grams are keys of 64 bits.  Blocks of documents explode into their distinct n-grams, which go to partitions by
hash together with the block's counts; there the count table of the partition's n-grams is summed and joined
back to the blocks' n-grams; each block then sums its documents' scores.  An n-gram crosses the network once per
block, packed into arrays by partition, so a frequent n-gram is never a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, text_of
from .decontaminate import words_of

ORDER = 3
BACKOFF = 0.4
#: Scores are summed in millionths as whole numbers, so their order doesn't matter.
MICRO = 1_000_000
#: Characters of text in a block, and bytes of text for each partition of n-grams.
BLOCK_CHARS = 4_000_000
PARTITION_BYTES = 8_000_000
#: N-grams are dealt out by this many leading bits of their key, in equal ranges.
CELL_BITS = 20

_LOW = 64 - CELL_BITS
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """Word keys of some documents one after another, and their n-grams.

    ``keys`` are the distinct n-grams of all orders, sorted; ``place[k - 1][i]`` is the place of the n-gram of
    ``k`` words that begins at word ``i``, or -1 where its document ends before.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, order: int = ORDER):
        self.words, self.sizes = words, sizes
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        end = np.repeat(self.ends, sizes)
        n, grams, where = len(words), [], []
        key = np.zeros(n, np.uint64)
        for k in range(1, order + 1):
            last = np.zeros(n, np.uint64)
            last[:n - k + 1] = words[k - 1:]
            key = _mix(key * _GOLDEN + last + np.uint64(k))
            at = np.flatnonzero(np.arange(k, n + k) <= end)
            grams.append(key[at])
            where.append(at)
        self.keys, inverse, self.counts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        self.place, begin = [], 0
        for at in where:
            own = np.full(n, -1, np.int64)
            own[at] = inverse[begin:begin + len(at)]
            self.place.append(own)
            begin += len(at)

    def scores(self, others: np.ndarray, total: int, backoff: float = BACKOFF) -> tuple[np.ndarray, np.ndarray]:
        """Millionths of the log score of each document and its words scored with the longest context.

        ``others``: each key's count in all other blocks.
        """
        order, n = len(self.place), len(self.words)
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        beyond = (others + self.counts).astype(np.int64)  # less the document's own, below
        left = []
        for place in self.place:
            there = place >= 0
            pair = doc[there] * len(self.keys) + place[there]
            _, inverse, own = np.unique(pair, return_inverse=True, return_counts=True)
            count = np.zeros(n, np.int64)
            count[there] = beyond[place[there]] - own[inverse]
            left.append(count)
        position = np.arange(n) - np.repeat(self.starts, self.sizes)
        rest = total - np.repeat(self.sizes, self.sizes)
        # Level 1: a single word among all words of others.
        ratio = np.where(left[0] > 0, left[0] / np.maximum(rest, 1), 1 / (rest + 1))
        level = np.ones(n, np.int64)
        for k in range(2, order + 1):  # the n-gram that ends at word i begins at word i - k + 1
            if n < k:
                break
            held = np.zeros(n, np.int64)
            held[k - 1:] = np.where(position[k - 1:] >= k - 1, left[k - 1][:n - k + 1], 0)
            context = np.ones(n, np.int64)
            context[k - 1:] = left[k - 2][:n - k + 1]
            ratio = np.where(held > 0, held / np.maximum(context, 1), ratio)
            level = np.where(held > 0, k, level)
        possible = np.minimum(position + 1, order)
        micro = np.rint((np.log(ratio) + (possible - level) * np.log(backoff)) * MICRO).astype(np.int64)
        sums = np.concatenate(([0], np.cumsum(micro)))
        full = np.concatenate(([0], np.cumsum(level == possible)))
        return sums[self.ends] - sums[self.starts], full[self.ends] - full[self.starts]


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts of which most are zero and most others small."""
    held = counts[counts > 0]
    small = np.minimum(held, 255).astype(np.uint8)
    return np.packbits(counts > 0).tobytes() + small.tobytes() + (held[held >= 255]).astype("<u8").tobytes()


def _unpack_counts(data: bytes, n: int) -> np.ndarray:
    bits = -(-n // 8)
    out = np.zeros(n, np.int64)
    where = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, bits), count=n))
    held = np.frombuffer(data, np.uint8, len(where), bits).astype(np.int64)
    large = held == 255
    if large.any():
        held[large] = np.frombuffer(data[bits + len(where):], "<u8")
    out[where] = held
    return out


def _pack_words(words: dict[bytes, int], places: np.ndarray) -> bytes:
    """Words of a block: the distinct ones, commonest first, and their places, by bytes of equal weight.

    ``words`` has a place for each word, ``places`` those of the texts' words in order.
    """
    counts = np.bincount(places, minlength=len(words))
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(words), np.uint32)
    rank[order] = np.arange(len(words))
    planes = rank[places].astype("<u4").view(np.uint8).reshape(-1, 4).T.copy()
    names = list(words)
    body = b" ".join([names[i] for i in order.tolist()])
    return zstandard.ZstdCompressor(level=3).compress(len(body).to_bytes(8, "little") + body + planes.tobytes())


def _unpack_words(data: bytes) -> np.ndarray:
    """Keys of a block's words in order."""
    body = zstandard.ZstdDecompressor().decompress(data)
    end = 8 + int.from_bytes(body[:8], "little")
    keys = np.array([xxhash.xxh3_64_intdigest(w, seed=4) for w in body[8:end].split()], np.uint64)
    planes = np.frombuffer(body, np.uint8, -1, end).reshape(4, -1)
    return keys[np.ascontiguousarray(planes.T).view("<u4").reshape(-1)]


def _cells(bucket: int, buckets: int) -> tuple[int, int]:
    """Cells (values of the leading bits) of a partition."""
    all_cells = 1 << CELL_BITS
    return -(-bucket * all_cells // buckets), -(-(bucket + 1) * all_cells // buckets)


def _pack_keys(keys: np.ndarray, cells: tuple[int, int]) -> bytes:
    """Sorted keys of some cells: for each cell a one per key and a zero, then the 44 bits below."""
    n, width = len(keys), cells[1] - cells[0]
    ones = np.zeros(n + width, np.uint8)
    ones[(keys >> np.uint64(_LOW)).astype(np.int64) - cells[0] + np.arange(n)] = 1
    parts = np.append(keys, np.zeros(n % 2, np.uint64)).astype("<u8").view(np.uint8).reshape(-1, 8)
    half = parts[::2, 5] & 15 | parts[1::2, 5] << 4
    return n.to_bytes(8, "little") + np.packbits(ones).tobytes() + half.tobytes() + np.ascontiguousarray(parts[:n, :5]).tobytes()


def _unpack_keys(data: bytes, cells: tuple[int, int]) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), cells[1] - cells[0]
    bits = -(-(n + width) // 8)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, bits, 8), count=n + width))
    half = np.frombuffer(data, np.uint8, (n + 1) // 2, 8 + bits)
    whole = np.zeros((n, 8), np.uint8)
    whole[:, :5] = np.frombuffer(data, np.uint8, 5 * n, 8 + bits + len(half)).reshape(-1, 5)
    whole[::2, 5] = half & 15
    whole[1::2, 5] = half[:n // 2] >> 4
    return whole.view("<u8").reshape(-1) | (ones - np.arange(n) + cells[0]).astype(np.uint64) << np.uint64(_LOW)


def _blocks(df: DataFrame, keep: str, text: str) -> DataFrame:
    """Rows of documents as blocks: block, docs (the kept column), sizes in words, packed word keys."""
    narrow = df.select(F.col(f"`{keep}`").alias("keep"), text_of(df, text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, chars = TaskContext.get().partitionId(), 0, 0
        held: list[pa.Array] = []
        sizes: list[int] = []
        words: dict[bytes, int] = {}
        places: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            docs = pa.concat_arrays(held)
            return pa.RecordBatch.from_arrays([
                pa.array([part << 32 | n], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
                pa.array([sizes], pa.list_(pa.int64())), pa.array([_pack_words(words, np.concatenate(places))], pa.binary())],
                names=["block", "docs", "sizes", "words"])

        for batch in batches:
            for own in groups(batch, "text", BLOCK_CHARS // 4):
                for text in own.column("text").to_pylist():
                    split = words_of(text)
                    sizes.append(len(split))
                    places.append(np.array([words.setdefault(w, len(words)) for w in split], np.int64))
                held.append(own.column("keep"))
                chars += own.column("text").nbytes
                if chars >= BLOCK_CHARS:
                    yield block()
                    n, held, sizes, words, places, chars = n + 1, [], [], {}, [], 0
        if held:
            yield block()

    kind = narrow.schema["keep"].dataType.simpleString()
    return narrow.mapInArrow(run, f"block long, docs array<{kind}>, sizes array<long>, words binary")


def _word_total(df: DataFrame, text: str) -> tuple[int, int]:
    """Words and bytes of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = size = 0
        for batch in batches:
            for own in groups(batch, "text"):
                for t in own.column("text").to_pylist():
                    words, size = words + len(words_of(t)), size + len(t)
        yield pa.RecordBatch.from_pydict({"words": [words], "bytes": [size]})

    counted = df.select(text_of(df, text).cast("binary").alias("text")).mapInArrow(run, "words long, bytes long")
    row = counted.agg(F.sum("words"), F.sum("bytes")).first()
    return row[0] or 0, row[1] or 0


def score(df: DataFrame, keep: str = "doc_id", text: str = "text", order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """Per row: the kept column, ``n_words``, ``score_micro`` (sum of log scores in millionths), ``n_full`` (words
    scored with their longest context).

    Words are normalised as for decontamination.  Null and empty texts have no words and score 0; repeated rows
    are documents of their own, each other's training text; an empty table gives no rows.
    """
    total, size = _word_total(df, text)
    buckets = max(1, min(1 << CELL_BITS, -(-size // PARTITION_BYTES)))
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _blocks(df, keep, text).repartition(partitions, "block")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["block", "sizes", "words"]).to_pylist():
                own = Block(_unpack_words(row["words"]), np.array(row["sizes"], np.int64), order)
                bounds = [_cells(b, buckets)[0] << _LOW for b in range(1, buckets)]
                cuts = [0, *np.searchsorted(own.keys, np.array(bounds, np.uint64)).tolist(), len(own.keys)]
                out = [(row["block"], b, cuts[b + 1] - cuts[b], _pack_keys(own.keys[cuts[b]:cuts[b + 1]], _cells(b, buckets)),
                        _pack_counts(own.counts[cuts[b]:cuts[b + 1]] - 1)) for b in range(buckets) if cuts[b] < cuts[b + 1]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SLICE, strict=True)], schema=_SLICE)

    def count(table: pa.Table) -> pa.Table:
        """Add up one partition's n-grams and tell each block what the others have of its own."""
        bucket = table.column("bucket")[0].as_py()
        sizes = table.column("n").to_pylist()
        keys = np.concatenate([_unpack_keys(x, _cells(bucket, buckets)) for x in table.column("keys").to_pylist()])
        own = np.concatenate([_unpack_counts(x, n) for x, n in zip(table.column("counts").to_pylist(), sizes, strict=True)]) + 1
        ranked = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], keys[ranked][1:] != keys[ranked][:-1])))
        sums = np.add.reduceat(own[ranked], first)
        others = np.empty(len(keys), np.int64)
        others[ranked] = np.repeat(sums, np.diff(np.append(first, len(keys))))
        others -= own
        ends = np.cumsum(sizes)
        packed = [_pack_counts(others[e - n:e]) for e, n in zip(ends.tolist(), sizes, strict=True)]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "n": table.column("n"), "others": pa.array(packed, pa.binary())})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(["sizes", "words", "found"]).to_pylist()):
                sizes = np.array(row["sizes"], np.int64)
                own = Block(_unpack_words(row["words"]), sizes, order)
                found = sorted(row["found"] or [], key=lambda f: f["bucket"])
                others = np.concatenate([np.empty(0, np.int64), *(_unpack_counts(f["others"], f["n"]) for f in found)])
                sums, full = own.scores(others, total, backoff)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("docs")[i].values, pa.array(sizes), pa.array(sums), pa.array(full)],
                    names=["keep", "n_words", "score_micro", "n_full"])

    # All columns, so that both readers of the blocks share one exchange.
    slices = blocks.mapInArrow(explode, "block long, bucket int, n long, keys binary, counts binary")
    answers = slices.groupBy("bucket").applyInArrow(count, "block long, bucket int, n long, others binary")
    # As many small arrays as there are partitions, for each block.
    found = answers.repartition(partitions, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "others")).alias("found"))
    kind = df.schema[keep].dataType.simpleString()
    scored = blocks.join(found.hint("shuffle_hash"), "block", "left").select("docs", "sizes", "words", "found").mapInArrow(
        finish, f"keep {kind}, n_words long, score_micro long, n_full long")
    return scored.withColumnRenamed("keep", keep)


_SLICE = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
