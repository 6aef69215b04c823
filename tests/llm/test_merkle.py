from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from medallion.llm import merkle
from medallion.llm.catalogue import QUERIES
from medallion.llm.common import table

FIELDS = ("doc_id", "source", "text")


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def _root(leaves, arity):
    """The root and each leaf's siblings, level by level, left and right."""
    steps = [[] for _ in leaves]
    under = [[i] for i in range(len(leaves))]
    nodes = list(leaves)
    while len(nodes) > 1:
        for i in range(len(nodes)):
            run = i // arity * arity
            side = ("".join(nodes[run:i]), "".join(nodes[i + 1:run + arity]))
            for leaf in under[i]:
                steps[leaf].append(side)
        under = [sum(under[i:i + arity], []) for i in range(0, len(under), arity)]
        nodes = [_h(*nodes[i:i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], steps


def _brute(rows, arity=2):
    """Rows of (group, key, leaf) to their (subroot, root, steps)."""
    groups = sorted({r[0] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for g in groups}
    trees = {g: _root([r[2] for r in own[g]], arity) for g in groups}
    root, upper = _root([trees[g][0] for g in groups], arity)
    return root, [(g, r[1], r[2], trees[g][0], trees[g][1][i] + upper[k]) for k, g in enumerate(groups) for i, r in enumerate(own[g])]


def _fold(node, steps):
    for left, right in steps:
        node = _h(left, node, right)
    return node


def _got(df):
    return sorted((r["c0"] or "", -1 if r["c1"] is None else r["c1"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["steps"]]) for r in df.collect())


@pytest.mark.parametrize(("n", "arity", "depth"), [(1, 2, 14), (2, 2, 1), (37, 2, 2), (64, 2, 3), (65, 2, 3), (50, 3, 2), (23, 5, 1)])
def test_trees_of_any_shape(llm, n, arity, depth):
    rows = [(i * 7 % n, "abc"[min(i % 5, 2)] if i % 11 else None, f"text {i}") for i in range(n)]
    df = llm.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    found = merkle.manifest(df, "source", "doc_id", FIELDS, carry=["source", "doc_id"], arity=arity, depth=depth)
    root, want = _brute([(r[1], r[0], _h(*(_field(v) for v in r))) for r in rows], arity)
    assert _got(found) == sorted((g or "", k, leaf, sub, root, steps) for g, k, leaf, sub, steps in want)
    checked = found.select((merkle.fold(F.col("leaf"), F.col("steps")) == F.col("root")).alias("ok")).distinct().collect()
    assert [r["ok"] for r in checked] == [True]


def test_odd_rows(odd, none):
    named = odd.withColumn("a.b", odd["c0"]).withColumn("leaf", odd["n"]).withColumn("idx", odd["n"]).withColumn("g", odd["n"])
    fields = ("doc_id", "source", "text", "n")
    found = merkle.manifest(named, "source", "doc_id", fields, carry=["source", "doc_id", "a.b"], depth=1)
    rows = [(r["source"], r["doc_id"], _h(*(_field(r[f]) for f in fields))) for r in named.collect()]
    root, want = _brute(rows)
    assert _got(found) == sorted((g or "", -1 if k is None else k, leaf, sub, root, steps) for g, k, leaf, sub, steps in want)
    assert merkle.manifest(none, "source", "doc_id", fields).count() == 0


def test_repeated_rows_and_a_hot_group(llm):
    rows = [(4, "a", "same")] * 20 + [(i, "a", "x") for i in range(10)]
    df = llm.createDataFrame(rows, "doc_id long, source string, text string")
    found = merkle.manifest(df, "source", "doc_id", FIELDS, carry=["source", "doc_id"], depth=2)
    root, want = _brute([(r[1], r[0], _h(*(_field(v) for v in r))) for r in rows])
    assert _got(found) == sorted((g, k, leaf, sub, root, steps) for g, k, leaf, sub, steps in want)


def test_query_on_the_whole_table(llm, sf):
    docs = table(llm, sf, "documents").collect()
    names = ("doc_id", "source", "lang", "n_chars", "text")
    leaf = {d["doc_id"]: _h(*(_field(d[f]) for f in names)) for d in docs}
    root, want = _brute([(d["lang"], d["doc_id"], leaf[d["doc_id"]]) for d in docs])
    by_id = {d["doc_id"]: d for d in docs}
    got = {r["doc_id"]: r for r in QUERIES["op12_merkle_manifest"](llm, sf).collect()}
    assert len(got) == len(docs)
    for _, key, own, sub, steps in want:
        d, r = by_id[key].asDict(), got[key]
        hit = zlib.crc32(str(key).encode()) % 7 == 0
        held = _h(*(_field(d[f] + 1 if hit and f == "n_chars" else d[f]) for f in names))
        folded = _fold(held, steps)
        assert (r["leaf"], r["subroot"], r["root"]) == (own, sub, root)
        assert r["proof_sha256"] == _h(*(x for s in steps for x in s))
        assert (r["folded_root"], r["verified"]) == (folded, folded == root) and r["verified"] == (not hit)


def test_windows_hold_one_block(llm):
    df = llm.range(1000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.col("id").cast("string").alias("text"))
    nodes = merkle._numbered(df.select(F.col("source").alias("g"), F.col("doc_id").alias("key"), F.col("text").alias("leaf"), F.col("doc_id").alias("row")))
    assert sorted(r["idx"] for r in nodes.collect()) == list(range(1000))
    assert nodes.where("idx != key").count() == 0 and nodes.where("n != 1000").count() == 0
    levels = merkle._levels(nodes.withColumn("h", F.col("leaf")), 2, 4)
    assert levels.groupBy("g", "block").count().agg(F.max("count")).first()[0] == 16
