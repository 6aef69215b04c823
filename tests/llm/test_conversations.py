from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from medallion.llm import conversations as c
from medallion.llm import record_queries
from medallion.llm.catalogue import QUERIES
from medallion.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]")


def _faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        letters = WORD.findall(text)
        fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def _cheapest(rows, faults):
    """Uniform-cost search over edit texts: the least cost first, of equal ones the ASCII-least text."""
    legal = re.compile(r"s?(ua)*u?$")
    queue, settled = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, roles, out = heapq.heappop(queue)
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit, out
        place = (i, roles[:1] == "s", roles[-1:])
        if place in settled:
            continue
        settled.add(place)
        for role in ("user", "assistant"):
            if legal.fullmatch(roles + role[0]):
                heapq.heappush(queue, (cost + 2, audit + "I", i, roles + role[0], (*out, f"{role}:")))
        if i == len(rows):
            continue
        _, own, text = rows[i]
        heapq.heappush(queue, (cost + 3, audit + "D", i + 1, roles, out))
        if faults[i] in ("blank", "duplicate"):
            continue
        more = int(faults[i] == "truncated")
        if own[:1] and own[:1] in "sua" and legal.fullmatch(roles + own[:1]):
            heapq.heappush(queue, (cost + more, audit + "K", i + 1, roles + own[:1], (*out, f"{own}:{text}")))
        for role in ("user", "assistant"):
            if legal.fullmatch(roles + role[0]):
                heapq.heappush(queue, (cost + 2 + more, audit + "R", i + 1, roles + role[0], (*out, f"{role}:{text}")))
    raise AssertionError


def _order(row):
    return (row[0] is not None, row[0] or 0, row[1].encode(), row[2].encode())


def _report(rows):
    rows = sorted(rows, key=_order)
    faults = _faults(rows)
    cost, audit, out = _cheapest(rows, faults)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), out


def _random(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "agent"]
    texts = ["Fine.", "Good!", "cut", " \t", "", "Other one?", "More. ", "and so", "Näh… 漢"]
    return [(k, t, rng.choice(roles), rng.choice(texts)) for k in range(n) for t in range(rng.randint(1, 9))]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def _by_conversation(rows):
    out = {}
    for key, turn, role, text in rows:
        out.setdefault(key, []).append((turn, " " if role is None else role, " " if text is None else text))
    return out


@pytest.mark.parametrize("spill", [c.SPILL_BYTES, 8])
def test_cheapest_edits_and_rows(llm, spill, monkeypatch):
    llm.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = _random(4, 400)
        df = _frame(llm, rows).repartition(4)
        reports = c.repair(df, spill_bytes=spill)
        repaired = {}
        for r in sorted(c.repaired_rows(df, reports).collect(), key=lambda r: (r["c0"], r["place"])):
            repaired.setdefault(r["c0"], []).append(f"{r['role']}:{r['text']}")
        got = {r["c0"]: tuple(r)[1:] for r in reports.collect()}
    finally:
        llm.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = _by_conversation(rows)
    assert got.keys() == want.keys()
    for key, own in want.items():
        report, out = _report(own)
        assert got[key] == report, own
        assert tuple(repaired.get(key, ())) == out


def test_odd_rows(llm):
    rows = [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (1, None, None, None), (1, 2, "user", None), (2, 5, "user", ""),
            (3, 1, "user", "Twice."), (3, 1, "user", "Twice."), (3, 1, "assistant", "Same turn."), (4, 9, "user", "long. " * 30_000),
            (5, -(2 ** 40), "user", "Far."), (5, 2 ** 40, "assistant", "Away.")]
    df = _frame(llm, rows).withColumn("print", F.lit(1)).withColumn("conv", F.lit("x")).withColumn("a.b", F.lit(2)).withColumn("present", F.lit(0))
    got = {r["c0"]: tuple(r)[1:] for r in c.repair(df).collect()}
    assert got == {key: _report(own)[0] for key, own in _by_conversation(rows).items()}
    assert c.repair(df.limit(0)).count() == 0 and c.repaired_rows(df.limit(0), c.repair(df.limit(0))).count() == 0


def test_conversations_without_rows(llm):
    df = _frame(llm, [(1, 1, "user", "Hi."), (2, 1, "user", "Hi."), (2, 2, "assistant", "Ho.")])
    got = {r["c0"]: tuple(r)[1:] for r in c.repair(df, present=F.col("conv_id") != 1).collect()}
    assert got == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()), 2: _report([(1, "user", "Hi."), (2, "assistant", "Ho.")])[0]}


def test_one_giant_conversation(llm):
    rows = [(7, i, "user" if i % 3 else "assistant", f"Line {i % 50}.") for i in range(3000)]
    got = c.repair(_frame(llm, rows).repartition(3), spill_bytes=1000).collect()
    assert len(got) == 1
    assert tuple(got[0])[1:] == _report([r[1:] for r in rows])[0]


def test_query_on_the_whole_table(llm, sf):
    want = {}
    for r in table(llm, sf, "conversations").collect():
        key, turn, role, text = (" " if v is None else v for v in r)
        own = want.setdefault(r["conv_id"], [])
        fate = zlib.crc32(f"{key}:{turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(r["turn"], "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](llm, sf).collect()}
    assert got == {key: _report(own)[0] for key, own in want.items()}
    assert record_queries.damaged(table(llm, sf, "conversations")).count() > 0
