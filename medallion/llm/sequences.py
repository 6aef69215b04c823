"""Token ids as Arrow stream files of equal-length sequences with masks.

A file is one Arrow stream.  Each record batch holds ``batch_rows`` sequences as two fixed-size lists, ``ids``
and ``mask``; all batches but the last take the same number of bytes, so batch ``i`` starts at
``header + i * batch_bytes`` and is used where it lies in the mapped file, without copying.  Documents follow
each other without gaps; the last sequence of a file is filled with ``pad_id`` under a false mask.  A second
stream file beside it, ``.docs``, says where each document starts.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, groups, text_of, work_path, written
from .tokens import END_ID, default_path, document_ids, encoder

SEQUENCE_LENGTH = 2048
BATCH_ROWS = 256
PAD_ID = 0

MANIFEST = "part int, path string, n_docs long, n_tokens long, n_sequences long, header long, batch_bytes long"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def sequence_schema(length: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """One stream file and its ``.docs``; holds less than a record batch and one document."""

    def __init__(self, folder: str, part: int, length: int, batch_rows: int, wide: bool):
        self.uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrows"
        files, path = filesystem(self.uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.schema, self.length, self.batch_rows = sequence_schema(length, wide), length, batch_rows
        self.kind = np.uint32 if wide else np.uint16
        self.sink, self.doc_sink = files.open_output_stream(path), files.open_output_stream(f"{path}.docs")
        self.out, self.docs = pa.ipc.new_stream(self.sink, self.schema), pa.ipc.new_stream(self.doc_sink, _DOCS)
        self.header, self.batch_bytes = self.schema.serialize().size, 0  # the stream begins with its schema
        self.held: list[np.ndarray] = []
        self.rows: list[tuple[int | None, int, int]] = []
        self.n_held = self.n_tokens = self.n_docs = self.n_sequences = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.n_tokens, len(ids)))
        self.held.append(ids.astype(self.kind))
        self.n_tokens, self.n_docs, self.n_held = self.n_tokens + len(ids), self.n_docs + 1, self.n_held + len(ids)
        if self.n_held >= self.length * self.batch_rows:
            self._flush(False)
        if len(self.rows) >= 65_536:
            self._flush_docs()

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(ids), mask)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))
        self.n_sequences += len(ids) // self.length
        self.batch_bytes = self.batch_bytes or self.sink.tell() - self.header

    def _flush(self, end: bool) -> None:
        ids, size = np.concatenate(self.held), self.length * self.batch_rows
        full = len(ids) // size * size
        for i in range(0, full, size):
            self._batch(ids[i:i + size], size)
        rest = ids[full:]
        if end and len(rest):
            padding = -len(rest) % self.length
            self._batch(np.append(rest, np.full(padding, PAD_ID, self.kind)), len(rest))
            rest = rest[:0]
        self.held, self.n_held = [rest.copy()], len(rest)

    def _flush_docs(self) -> None:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), _DOCS, strict=True)]
            self.docs.write_batch(pa.record_batch(columns, schema=_DOCS))
        self.rows = []

    def close(self) -> tuple[str, int, int, int, int, int]:
        self._flush(True)
        self._flush_docs()
        for x in (self.out, self.docs, self.sink, self.doc_sink):
            x.close()
        return self.uri, self.n_docs, self.n_tokens, self.n_sequences, self.header, self.batch_bytes


class SequenceFile:
    """Random access to a written file: ``sequence(i)`` gives views of ids and mask in the mapped file."""

    def __init__(self, uri: str, header: int, batch_bytes: int, n_sequences: int, batch_rows: int = BATCH_ROWS):
        files, path = filesystem(uri)
        local = files.type_name == "local"
        self.source = pa.memory_map(path) if local else files.open_input_file(path)
        self.schema = pa.ipc.open_stream(self.source).schema
        self.header, self.batch_bytes, self.n_sequences, self.batch_rows = header, batch_bytes, n_sequences, batch_rows
        self.docs = lambda: pa.ipc.open_stream(pa.memory_map(f"{path}.docs") if local else files.open_input_file(f"{path}.docs"))

    def batch(self, i: int) -> pa.RecordBatch:
        buffer = self.source.read_at(self.batch_bytes, self.header + i * self.batch_bytes) if not isinstance(
            self.source, pa.MemoryMappedFile) else self._mapped(self.header + i * self.batch_bytes)
        return pa.ipc.read_record_batch(pa.ipc.read_message(pa.BufferReader(buffer)), self.schema)

    def _mapped(self, at: int) -> pa.Buffer:
        self.source.seek(at)
        return self.source.read_buffer(min(self.batch_bytes, self.source.size() - at))

    def batches(self) -> Iterator[pa.RecordBatch]:
        for i in range(-(-self.n_sequences // self.batch_rows)):
            yield self.batch(i)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        batch, row = self.batch(i // self.batch_rows), i % self.batch_rows
        ids, mask = batch.column("ids"), batch.column("mask")
        width = ids.type.list_size
        return ids.values.to_numpy()[row * width:(row + 1) * width], mask.values.slice(row * width, width)


def write_sequences(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID,
    length: int = SEQUENCE_LENGTH, batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """Encode whole texts and write them in ascending ``doc_id`` order; returns the manifest, one row per file.

    The manifest columns are those of ``MANIFEST`` and ``base``, the tokens in all files before.  Texts are dealt
    out by range of ``doc_id`` once and encoded where they are written.  A repeated task writes a file of another
    name; only the files of the tasks that counted stand in the manifest, which is a written table.

    Null text: empty, so the end id alone.  Null doc_id: first.  Rows of one doc_id: by text, each a document of
    its own.  Empty table: empty manifest.  Other columns are not read.
    """
    path, folder = tokenizer or default_path(), work_path(df.sparkSession, "sequences")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, writer, part = encoder(path), None, TaskContext.get().partitionId()
        for batch in batches:
            for own in groups(batch, "text"):
                for key, value in zip(own.column("doc_id").to_pylist(), own.column("text").to_pylist(), strict=True):
                    writer = writer or SequenceWriter(folder, part, length, batch_rows, words.vocabulary > 65_536)
                    writer.add(key, document_ids(words, value, end_id))
        if writer:
            row = (part, *writer.close())
            yield pa.RecordBatch.from_pydict(dict(zip(
                ("part", "path", "n_docs", "n_tokens", "n_sequences", "header", "batch_bytes"), ([x] for x in row), strict=True)),
                schema=pa.schema([("part", pa.int32()), ("path", pa.string()), *[(c, pa.int64()) for c in (
                    "n_docs", "n_tokens", "n_sequences", "header", "batch_bytes")]]))

    dealt = df.select(df[doc_id].cast("long").alias("doc_id"), text_of(df, text).alias("text"))
    dealt = dealt.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = written(dealt.mapInArrow(write, MANIFEST), "sequence-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(manifest: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Documents read back from the files: doc_id, start, n_tokens, ids_crc32.  One file is one task's work."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entry in (row for batch in batches for row in batch.to_pylist()):
            file = SequenceFile(entry["path"], entry["header"], entry["batch_bytes"], entry["n_sequences"], batch_rows)
            tokens = _real_ids(file)
            piece, at = np.empty(0, np.uint32), 0
            for docs in file.docs():
                sums = []
                for n in docs.column("n_tokens").to_pylist():
                    crc = 0
                    while n:
                        if at == len(piece):
                            piece, at = next(tokens), 0
                        take = min(n, len(piece) - at)
                        crc = zlib.crc32(piece[at:at + take].astype("<u4"), crc)
                        at, n = at + take, n - take
                    sums.append(crc)
                yield pa.RecordBatch.from_arrays(
                    [docs.column("doc_id"), pc.add(docs.column("start"), entry["base"]), docs.column("n_tokens"),
                     pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # A number given keeps adaptive execution from putting these tiny rows into one task.
    files = manifest.repartition(max(1, manifest.count()))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _real_ids(file: SequenceFile) -> Iterator[np.ndarray]:
    for batch in file.batches():
        real = int(pc.sum(batch.column("mask").values).as_py())
        yield batch.column("ids").values.to_numpy()[:real]
