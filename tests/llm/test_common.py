from __future__ import annotations

import os
import threading

import pyarrow as pa
import pytest

from medallion.llm import common


def test_scratch_deletes_what_nothing_reads(llm):
    with common.Scratch() as outer:
        with common.Scratch() as inner:
            a, b = (common.written(llm.range(3), n) for n in ("a", "b"))
            inner.drop(llm, b)
            c = common.written(llm.range(4), "c")
        assert b.count() == 3 and c.count() == 4
        with pytest.raises(Exception, match="(?i)exist|found"):
            a.count()
        folders = [p.removeprefix("file://") for p in outer.paths]
        assert len(folders) == 2 and all(map(os.path.isdir, folders))
        outer.drop(llm)
        assert outer.paths == [] and not any(map(os.path.exists, folders))
    assert common.written(llm.range(2), "d").count() == 2  # no scratch is open: it stays


def test_threads_have_their_own_scratch(llm):
    other = []
    with common.Scratch() as work:
        writer = threading.Thread(target=lambda: other.append(common.written(llm.range(5), "other")))
        writer.start()
        writer.join()
        common.written(llm.range(3), "own")
        assert len(work.paths) == 1
        work.drop(llm)
    assert work.paths == [] and other[0].count() == 5


def test_groups_hold_every_row_once():
    texts = ["", None, "abc", "x" * 50, "de", "f", "g" * 9]
    batch = pa.RecordBatch.from_pydict({"i": list(range(7)), "text": texts})
    slices = list(common.groups(batch, "text", 10))
    assert [i for s in slices for i in s.column("i").to_pylist()] == list(range(7))
    assert all(s.num_rows == 1 or sum(len(t or "") for t in s.column("text").to_pylist()) <= 10 for s in slices)
    assert list(common.groups(batch.slice(0, 0), "text", 10)) == []


def test_fresh_names():
    assert common.fresh(["Row", "_ROW", "x"], "row") == "__row" and common.fresh([], "row") == "row"
