"""Benchmark passages in documents: a broadcast hash set of the test items' word windows, scanned and verified.

Words are runs of ASCII letters and digits and of all characters from U+0080 on, ASCII capitals lowered.  An
item's windows are its runs of ``n`` words; an item of fewer words, but not none, is one window.  A document's
windows are looked up by hash; every hit is compared word by word before it counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import groups, text_of, written

WINDOW = 10
#: Bytes of test items broadcast at a time (about ten times as many bytes of table); more items are scanned
#: for block by block, each block against all documents.  Only an item that is longer is a larger block.
BLOCK_CHARS = 4_000_000

_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

_FOUND = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start: int, end: int>>"
_FOUND_TYPES = [
    pa.field("n_words", pa.int64()), pa.field("n_hit", pa.int64()), pa.field("item_ids", pa.list_(pa.string())),
    pa.field("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
]


def words_of(text: bytes) -> list[bytes]:
    """Normalised words of a UTF-8 text: bytes from 0x80 on are parts of characters from U+0080 on."""
    return text.translate(_TABLE).split()


class Windows:
    """The windows of a block of test items, by length: sorted hashes, words for the check, owners."""

    def __init__(self, items: list[tuple[str, bytes]], n: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        grams: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(n, len(codes))
            for i in range(len(codes) - size + 1 if size else 0):
                grams.setdefault(tuple(codes[i:i + size]), set()).add(item)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[str, ...]]]] = {}
        for size in sorted({len(g) for g in grams}):
            own = [g for g in grams if len(g) == size]
            seed = 1
            while True:  # another set of factors where two windows of the block would share a hash
                factors = np.random.default_rng(seed).integers(1, 2**63, size, np.uint64) | np.uint64(1)
                matrix = np.array(own, np.int64)
                hashes = (matrix.astype(np.uint64) * factors).sum(1, dtype=np.uint64)
                if len(np.unique(hashes)) == len(hashes):
                    break
                seed += 1
            order = np.argsort(hashes)
            self.by_length[size] = (hashes[order], matrix[order], factors, [tuple(grams[own[i]]) for i in order])

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, int, set[str], np.ndarray]]:
        """Of each text: words, hit words, items, and the hit words' flags (empty without a hit)."""
        known = self.vocabulary.get
        split = [words_of(t) for t in texts]
        counts = np.array([len(w) for w in split], np.int64)
        starts = np.concatenate(([0], np.cumsum(counts + 1)))  # a zero after each text ends its windows
        codes = np.zeros(starts[-1] + 1, np.int64)
        flat = np.fromiter((known(w, 0) for w in chain.from_iterable((*w, b"") for w in split)), np.int64, starts[-1])
        codes[:-1] = flat
        unknown = np.concatenate(([0], np.cumsum(codes == 0)))
        change = np.zeros(len(codes) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for size, (hashes, matrix, factors, owners) in self.by_length.items():
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            at = at[at + size <= len(codes)]
            if not len(at):
                continue
            hashed = np.zeros(len(at), np.uint64)
            for j in range(size):
                hashed += codes[at + j].astype(np.uint64) * factors[j]
            place = np.minimum(np.searchsorted(hashes, hashed), len(hashes) - 1)
            same = hashes[place] == hashed
            at, place = at[same], place[same]
            same = (codes[at[:, None] + np.arange(size)] == matrix[place]).all(1)
            at, place = at[same], place[same]
            np.add.at(change, at, 1)
            np.add.at(change, at + size, -1)
            docs = np.searchsorted(starts, at, "right") - 1
            for doc, gram in np.unique(np.stack((docs, place)), axis=1).T.tolist():
                items.setdefault(doc, set()).update(owners[gram])
        hit = np.cumsum(change)[:-1] > 0
        for i, n in enumerate(counts.tolist()):
            flags = hit[starts[i]:starts[i] + n] if i in items else hit[:0]
            yield n, int(flags.sum()), items.get(i, set()), flags


def _spans(text: bytes, flags: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words in code points, end exclusive."""
    if not len(flags):
        return []
    places = [m.span() for m in _WORD.finditer(text.decode().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in edges.reshape(-1, 2).tolist()]


def _blocks(tests: DataFrame, limit: int) -> Iterator[list[Row]]:
    """Items in blocks cut by their running size; the driver holds one block and one partition of the table."""
    block: list[Row] = []
    held = 0
    for r in tests.toLocalIterator():
        if block and held + r["size"] > limit:
            yield block
            block, held = [], 0
        block.append(r)
        held += r["size"]
    if block:
        yield block


def _broadcast(spark: SparkSession, items: list[Row], n: int) -> Broadcast[Windows]:
    return spark.sparkContext.broadcast(Windows([(r["item"], bytes(r["text"])) for r in items], n))


def _scan(df: DataFrame, text: str, keep: list[str], windows: Broadcast[Windows]) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in groups(batch, "text"):
                texts = own.column("text").to_pylist()
                found: list[tuple[Any, ...]] = [
                    (n_words, n_hit, sorted(ids), _spans(t, flags))
                    for t, (n_words, n_hit, ids, flags) in zip(texts, windows.value.scan(texts), strict=True)
                ]
                new = [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _FOUND_TYPES, strict=True)]
                fields = [own.schema.field(i) for i in range(own.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], *new], schema=pa.schema([*fields, *_FOUND_TYPES]))

    narrow = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), text_of(df, text).cast("binary").alias("text"))
    kept = ", ".join(f"c{i} {narrow.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep)))
    return narrow.mapInArrow(scan, f"{kept}, {_FOUND}" if kept else _FOUND)


def find(
    df: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text",
    n: int = WINDOW, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Columns ``c0``, ``c1``, ... (those of ``keep``) with n_words, n_hit, item_ids and spans of every row of ``df``.

    Distinct items go to the tasks in blocks of at most ``block_chars`` bytes.  With more than one block, each
    block's finds are written before the next one is broadcast, and each row's finds are put together again.  Null
    texts have no words; a null item id is the id "null"; rows of one item id are one item; empty tables give no
    finds.  Columns of ``keep`` may have any name.
    """
    spark = df.sparkSession
    tests = items.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")).alias("item"), text_of(items, item_text).cast("binary").alias("text"),
    ).where(F.octet_length("text") > 0).distinct().withColumn("size", F.octet_length("item") + F.octet_length("text"))
    if (tests.agg(F.sum("size")).first()[0] or 0) <= block_chars:
        return _scan(df, text, keep, _broadcast(spark, tests.collect(), n))
    # The caller's columns are c0, c1, ... from here on, so no name of theirs meets one of these.
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    rows = written(df.select(*own, F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("row")), "to-scan")
    parts: list[DataFrame] = []
    for block in _blocks(written(tests, "test-items"), block_chars):
        windows = _broadcast(spark, block, n)
        found = _scan(rows, "text", ["row"], windows)
        # The first block's finds have every row, with its count of words; the others' those with a hit.
        parts.append(written(found.where("n_hit > 0") if parts else found, f"finds-{len(parts)}"))
        windows.destroy()
    files = [f for part in parts[1:] for f in part.inputFiles()]
    together = parts[0].unionByName(spark.read.schema(parts[0].schema).parquet(*files)) if files else parts[0]
    # One row per block and document; the spans of a document overlap only where blocks share its passages.
    together = together.groupBy("c0").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.flatten(F.collect_list("spans")).alias("spans"))
    return _merge(rows, together).select(*(f"c{i}" for i in range(len(keep))), "n_words", "n_hit", "item_ids", "spans")


def _merge(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Unite overlapping spans and count their words again."""
    ordered = F.array_sort(F.col("spans"))
    united = F.aggregate(
        ordered, F.expr("cast(array() as array<struct<start: int, end: int>>)"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(s))))
    pattern = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
    joined = rows.join(found.withColumnRenamed("c0", "row_of"), F.col("row") == F.col("row_of")).withColumn("spans", united)
    body = F.expr(f"""aggregate(spans, 0L, (n, s) -> n + size(regexp_extract_all(
        translate(substring(text, s.start + 1, s.end - s.start), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '{pattern.replace(chr(92), chr(92) * 2)}', 0)))""")
    return joined.withColumn("n_hit", body)


def decontaminate(
    df: DataFrame, items: DataFrame, action: str = "documents", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", n: int = WINDOW,
) -> DataFrame:
    """Rows of ``df`` without what the test items give away; the columns stay as they are.

    ``documents`` drops each row with a hit; ``spans`` cuts the hit words out of its text, neighbours joined by
    one space.  Null texts and rows without a hit stay as they are.
    """
    columns = df.columns
    found = find(df, items, columns, text, item_id, item_text, n)
    names = {f"c{i}": c for i, c in enumerate(columns)}
    if action == "documents":
        return found.where("n_hit = 0").select(*(F.col(c).alias(n) for c, n in names.items()))
    if action != "spans":
        raise ValueError(action)
    value = F.col(f"c{columns.index(text)}")
    cut = F.expr(f"""concat_ws(' ', filter(transform(
        arrays_zip(concat(array(0), spans.end), concat(spans.start, array(char_length(`c{columns.index(text)}`)))),
        p -> trim(substring(`c{columns.index(text)}`, p['0'] + 1, p['1'] - p['0']))), t -> t != ''))""")
    return found.select(*(
        (F.when(F.col("n_hit") > 0, cut).otherwise(value) if n == text else F.col(c)).alias(n) for c, n in names.items()))
