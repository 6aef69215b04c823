"""Best-fit packing of documents into sequences, with lower bounds that certify the count.

Pieces are dealt out at random and each partition packs its own by best-fit decreasing.  Dual-feasible
functions bound from below how many sequences a partition's pieces need; a partition that meets its bound is
certified.  The others, and every sequence that is not full, give their pieces up for exchange: fewer
partitions take them in and pack them again, until the last round's one group is left or the whole count
meets the bound over all pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, text_of, written
from .tokens import END_ID, default_path, document_ids, encoder

CAPACITY = 4096
#: Pieces a partition packs at once at most; more pieces mean more partitions.
GROUP_PIECES = 50_000
#: Partitions whose open sequences meet in one partition of the next round.
FAN_IN = 32
#: Rounds of packing at most.
ROUNDS = 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def cut_pieces(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID,
    capacity: int = CAPACITY,
) -> DataFrame:
    """Documents as token pieces of at most ``capacity`` ids, with the checksum of the ids.

    Only longer documents are cut; the last piece may be shorter.  A null text is empty and so one piece of the
    end id.  Null and repeated doc_ids stay rows of their own.  ``salt`` spreads pieces, equal ones too.
    """
    path = tokenizer or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, n = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for own in groups(batch, "text"):
                rows = []
                for key, value in zip(own.column("doc_id").to_pylist(), own.column("text").to_pylist(), strict=True):
                    ids = document_ids(words, value, end_id)
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part_ids = ids[start:start + capacity]
                        rows.append((key, piece, start, len(part_ids), zlib.crc32(part_ids), part << 40 | n))
                        n += 1
                yield _batch(rows, _PIECE_TYPES)

    narrow = df.select(df[doc_id].cast("long").alias("doc_id"), text_of(df, text).alias("text"))
    return narrow.mapInArrow(cut, PIECES)


_PIECE_TYPES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("salt", pa.int64())])
_PACKED_TYPES = pa.schema([*_PIECE_TYPES, pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64()), pa.field("open", pa.bool_())])


def _batch(rows: list[tuple[object, ...]], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that pieces need at least; ``lengths[x]`` is how many pieces have ``x`` tokens.

    The largest sum over two families of dual-feasible functions: one counts pieces above ``capacity - k``
    whole and drops those below ``k``; one rounds ``(k + 1) x / capacity`` down where it is no whole number.
    """
    sizes = np.arange(capacity + 1, dtype=np.int64)
    counts = lengths.astype(np.int64)
    volume, number = np.cumsum(counts * sizes), np.cumsum(counts)
    best = -(-int(volume[-1]) // capacity)
    k = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - k]
    middle = volume[capacity - k] - volume[k - 1]
    best = max(best, int((large + -(-middle // capacity)).max(initial=0)))
    for k in range(1, 64):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, scaled * k // (k + 1), capacity * (scaled // capacity))  # in units of 1 / (k * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: of each piece its sequence and offset; of each sequence the tokens left."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open sequences by tokens left
    some = 0  # bit r is set where room[r] holds a sequence
    left: list[int] = []
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = some >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
        else:
            r, b = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        left[b] = r - size
        if r > size:
            room[r - size].append(b)
            some |= 1 << (r - size)
    return bins, offsets, np.array(left, np.int64)


def _pack_groups(pieces: DataFrame, capacity: int, round_no: int) -> DataFrame:
    """Pack each partition; ``open`` marks the pieces to exchange."""
    names = [f.name for f in _PIECE_TYPES]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        held = pa.Table.from_batches(parts).combine_chunks()
        lengths = held.column("length").to_numpy()
        bins, offsets, left = best_fit(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        # A certified partition gives up its fullest gaps only: the sequences that aren't full.
        gap = len(left) - bound
        open_bins = left > 0 if gap else left > capacity // 64
        first = (round_no << 56) + (TaskContext.get().partitionId() << 32)
        table = held.select(names).append_column("sequence_id", pa.array(bins + first)).append_column(
            "offset", pa.array(offsets)).append_column("open", pa.array(open_bins[bins]))
        yield from table.cast(_PACKED_TYPES).to_batches(65_536)

    return pieces.select(*names).mapInArrow(pack, f"{PACKED}, open boolean")


def histogram(pieces: DataFrame, capacity: int = CAPACITY) -> np.ndarray:
    """How many pieces have each length: at most ``capacity`` rows."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    return counts


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, fan_in: int = FAN_IN, rounds: int = ROUNDS,
) -> DataFrame:
    """Place every piece: ``sequence_id`` and a gapless ``offset``.  ``pieces`` has the columns of ``PIECES``.

    Every round is a written table; the next reads only the open sequences of the last, in ``fan_in`` times fewer
    partitions but never more than ``group_pieces`` pieces in one.  A round that saves no sequence is dropped.
    The rounds end when the count meets the bound over all pieces, when a single group gave no more, or after
    ``rounds``.  An empty table gives no rows.
    """
    pieces = written(pieces, "pieces")
    counts = histogram(pieces, capacity)
    bound = lower_bound(counts, capacity)
    n = max(1, -(-int(counts.sum()) // group_pieces))
    best = _pack_round(pieces, n, capacity, 0)
    done: list[DataFrame] = []
    closed = 0
    for round_no in range(1, rounds):
        # A sequence has one piece at offset 0.
        held = {r["open"]: (r["sequences"], r["pieces"]) for r in best.groupBy("open").agg(
            F.count_if(F.col("offset") == 0).alias("sequences"), F.count("*").alias("pieces")).collect()}
        (shut, _), (gaps, rest) = held.get(False, (0, 0)), held.get(True, (0, 0))
        if closed + shut + gaps <= bound or gaps < 2 or n == 1:
            break
        n = max(-(-rest // group_pieces), -(-n // fan_in))
        again = _pack_round(best.where("open"), n, capacity, round_no)
        if again.where("offset = 0").count() < gaps:
            done.append(best.where("NOT open"))
            closed, best = closed + shut, again
    out = best
    for part in done:
        out = out.unionByName(part)
    return out.drop("open", "salt")


def _pack_round(pieces: DataFrame, n: int, capacity: int, round_no: int) -> DataFrame:
    dealt = pieces.repartition(n, F.xxhash64("salt", F.lit(round_no))) if n > 1 else pieces.coalesce(1)
    return written(_pack_groups(dealt, capacity, round_no), f"packing-{round_no}")


def pack_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Whole documents to placed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut_pieces(df, doc_id, text, tokenizer, capacity=capacity), capacity)
