from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from math import comb

import pytest

from medallion.llm import sharding as s
from medallion.llm.common import table
from medallion.llm.queries import QUERIES


def test_hypergeometric_draws():
    rng = random.Random(5)
    seen = Counter(s.hypergeometric(rng, 12, 20, 9) for _ in range(20_000))
    for k in range(10):
        exact = comb(12, k) * comb(20, 9 - k) / comb(32, 9)
        assert abs(seen[k] / 20_000 - exact) < 0.015
    assert s.hypergeometric(rng, 0, 5, 3) == 0 and s.hypergeometric(rng, 5, 0, 3) == 3
    assert 0 <= s.hypergeometric(rng, 10**12, 10**13, 10**7) <= 10**7


def test_matrix_sums():
    blocks, shards = [5, 0, 17, 8], [8, 8, 7, 7]
    matrix = s.communication_matrix(blocks, shards, 1)
    assert [sum(r) for r in matrix] == blocks and [sum(c) for c in zip(*matrix, strict=True)] == shards


@pytest.mark.parametrize("bits", [18, 5])
def test_sizes_and_slots(llm, bits):
    df = llm.range(0, 1003, 1, 7).selectExpr("id", "'same' AS text")
    held = defaultdict(list)
    rows = s.shuffle(df, 16, 3, bits).collect()
    for r in rows:
        held[r["shard"]].append(r["slot"])
    assert sorted(r["id"] for r in rows) == list(range(1003))
    assert sorted(len(v) for v in held.values()) == [62] * 5 + [63] * 11
    assert all(sorted(v) == list(range(len(v))) for v in held.values())


def test_uniform(llm):
    df = llm.range(0, 24, 1, 3)
    shard, first = Counter(), Counter()
    for seed in range(60):
        for r in s.shuffle(df, 4, seed, 2).collect():
            shard[r["id"], r["shard"]] += 1
            first[r["id"]] += r["slot"] == 0
    # 60 draws of probability 1/4 and 1/6: far outside of six standard deviations is not chance.
    assert all(abs(shard[i, k] - 15) <= 21 for i in range(24) for k in range(4))
    assert all(first[i] <= 28 for i in range(24))


def test_odd_rows(odd, none):
    rows = s.shuffle(odd, 3)
    assert rows.columns == [*odd.columns, "shard", "slot"] and rows.count() == odd.count()
    assert s.shuffle(none).count() == 0
    clash = odd.withColumnsRenamed({"c0": "Shard", "source": "slot", "n": "a.b", "row": "row_no"})
    rows = s.shuffle(clash, 3)
    assert rows.columns == [*clash.columns, "_shard", "_slot"]
    assert sorted(map(str, rows.drop("_shard", "_slot").collect())) == sorted(map(str, clash.collect()))


def test_query_against_plain_sums(llm, sf):
    made = QUERIES["op6_uniform_shards"](llm, sf).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in table(llm, sf, "documents").collect()]
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in made) == sorted(want)
    held = Counter(r["shard"] for r in made)
    assert set(held) == set(range(16)) and max(held.values()) - min(held.values()) <= 1
    assert all(sorted(r["slot"] for r in made if r["shard"] == k) == list(range(n)) for k, n in held.items())


def test_native_plan(llm, odd):
    plan = s.shuffle(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
