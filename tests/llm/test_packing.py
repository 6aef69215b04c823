from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from medallion.llm import packing, tokens

from .conftest import ODD


def _check(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), min_size=1, max_size=9))
def test_bound_is_never_above_the_optimum(sizes):
    capacity = 16

    def fewest(left, bins):
        if not left:
            return len(bins)
        best, seen = len(bins) + len(left), set()
        for i, room in enumerate(bins):
            if room >= left[0] and room not in seen:
                seen.add(room)
                best = min(best, fewest(left[1:], bins[:i] + [room - left[0]] + bins[i + 1:]))
        return min(best, fewest(left[1:], [*bins, capacity - left[0]]))

    optimum = fewest(sorted(sizes, reverse=True), [])
    bound = packing.lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
    used = len(packing.best_fit(np.array(sizes), capacity)[2])
    assert -(-sum(sizes) // capacity) <= bound <= optimum <= used


@pytest.mark.parametrize(("group", "rounds"), [(50_000, 8), (40, 8), (40, 1)])
def test_every_piece_once(llm, group, rounds):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 65, 500).tolist()
    rows = [(i, 0, 0, n, i, i) for i, n in enumerate(lengths)]
    packed = packing.pack(llm.createDataFrame(rows, packing.PIECES), 64, group, 4, rounds).collect()
    assert sorted(r["doc_id"] for r in packed) == list(range(500))
    n, bound = _check(packed, 64), packing.lower_bound(np.bincount(lengths, minlength=65), 64)
    assert bound <= n <= bound * (1.06 if rounds > 1 else 1.15)


def test_exchange_saves_sequences(llm):
    rows = [(i, 0, 0, 33, i, i) for i in range(120)] + [(i, 0, 0, 31, i, i) for i in range(120, 240)]
    pieces = llm.createDataFrame(rows, packing.PIECES)
    alone, exchanged = (_check(packing.pack(pieces, 64, 20, 4, r).collect(), 64) for r in (1, 8))
    assert exchanged < alone


def test_odd_rows(odd, none):
    rows = packing.pack_documents(odd).collect()
    _check(rows, packing.CAPACITY)
    encoder = tokens.encoder(tokens.default_path())
    expected = []
    for key, text, _ in ODD:
        ids = tokens.document_ids(encoder, text)
        expected += [(key, i, at, len(ids[at:at + 4096]), zlib.crc32(ids[at:at + 4096])) for i, at in enumerate(range(0, len(ids), 4096))]
    order = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows), key=order) == sorted(expected, key=order)
    assert packing.pack_documents(none).count() == 0
