from __future__ import annotations

import re

import pytest

from medallion.llm import decontaminate as d
from medallion.llm.common import table


def _words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def _brute(text, items):
    words, hit, ids = _words(text), set(), set()
    for item, body in items:
        own = _words(body)
        size = min(10, len(own))
        grams = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i:i + size]) in grams:
                hit |= set(range(i, i + size))
                ids.add("null" if item is None else str(item))
    return len(words), len(hit), sorted(ids)


ITEMS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "short item"), (10, "kappa lambda mu alpha beta gamma delta epsilon zeta eta"), (None, "no key at all"), (3, None), (4, "!!"), (1, "second text of one"),
]
TEXTS = [
    (1, "X ALPHA, beta-gamma delta epsilon zeta eta theta iota kappa; then"), (2, "a short item, and a SHORT\nitem"),
    (3, "alpha beta gamma delta epsilon zeta eta theta iota KAPPA lambda mu alpha beta gamma delta epsilon zeta eta"),
    (4, "kappa lambda only"), (None, "no key at all"), (5, None), (6, ""), (2, "a short item, and a SHORT\nitem"), (7, "second text of one " * 3000),
]


@pytest.mark.parametrize("block_chars", [d.BLOCK_CHARS, 40])
def test_like_brute_force(llm, block_chars):
    docs = llm.createDataFrame(TEXTS, "doc_id long, text string")
    items = llm.createDataFrame(ITEMS, "item_id long, text string")
    got = d.find(docs, items, ["doc_id", "text"], block_chars=block_chars).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == _brute(r["c1"], ITEMS), r["c0"]


def test_blocks_are_bounded_and_one_at_a_time(llm, monkeypatch):
    items = [(1, ITEMS[0][1])] * 60 + [(i, f"item {i} of the long list of them all, with words enough {i}") for i in range(100, 120)]
    docs = [*TEXTS, (9, "see item 103 of the long list of them all with words enough 103 and item 117 of the long list of them all with words enough 117")]
    blocks, gone = [], []
    begin, kind = d.Windows.__init__, type(llm.sparkContext.broadcast(0))
    destroy = kind.destroy

    def init(self, own, n=d.WINDOW):
        assert len(gone) == len(blocks)  # the block before is gone
        blocks.append(sum(len(text) for _, text in own))
        begin(self, own, n)

    monkeypatch.setattr(d.Windows, "__init__", init)
    monkeypatch.setattr(kind, "destroy", lambda self, *a: (gone.append(1), destroy(self, *a))[1])
    got = d.find(llm.createDataFrame(docs, "doc_id long, text string"), llm.createDataFrame(items, "item_id long, text string"), ["doc_id", "text"], block_chars=400).collect()
    assert len(blocks) > 2 and max(blocks) <= 400 and len(gone) == len(blocks)
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == _brute(r["c1"], items), r["c0"]


def test_removal(llm):
    docs = llm.createDataFrame(TEXTS, "doc_id long, text string")
    items = llm.createDataFrame(ITEMS, "item_id long, text string")
    kept = d.decontaminate(docs, items, "documents")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6]
    cut = {r["doc_id"]: r["text"] for r in d.decontaminate(docs, items, "spans").collect()}
    assert cut[1] == "X ; then" and cut[4] == "kappa lambda only" and cut[5] is None and cut[None] == ""
    assert cut[2] == "a , and a"


def test_odd_rows(odd, none, llm):
    items = llm.createDataFrame(ITEMS, "item_id long, text string")
    assert d.find(odd, items, odd.columns).count() == odd.count()
    assert d.decontaminate(odd, items).columns == odd.columns
    assert d.decontaminate(none, items).count() == 0
    assert d.decontaminate(odd, items.limit(0)).count() == odd.count()


def test_all_tables(llm, sf):
    docs, items = table(llm, sf, "documents"), table(llm, sf, "benchmark")
    own = [(r["item_id"], r["text"]) for r in items.collect()]
    for r in d.find(docs, items, ["text"]).collect():
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == _brute(r["c0"], own)


@pytest.mark.parametrize("block_chars", [d.BLOCK_CHARS, 40])
def test_clashing_and_dotted_columns(llm, block_chars, monkeypatch):
    """Columns named like the operator's own are kept as they are, with one block and with many."""
    names = ["doc_id", "n_hit", "n_words", "row", "row_of", "spans", "item_ids", "a.b", "c0", "item", "text", "size"]
    rows = [(k, 7, -1, 1, 2, "s", "i", "dotted", "c", "t", t, 5) for k, t in TEXTS]
    kinds = ["long", "long", "long", "long", "long", "string", "string", "string", "string", "string", "string", "long"]
    docs = llm.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))
    items = llm.createDataFrame(ITEMS, "item_id long, text string")
    got = d.find(docs, items, names, block_chars=block_chars).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == _brute(r["c10"], ITEMS)
        assert [r[f"c{i}"] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11)] == [7, -1, 1, 2, "s", "i", "dotted", "c", "t", 5]
    find = d.find
    monkeypatch.setattr(d, "find", lambda *a, **k: find(*a, **k, block_chars=block_chars))
    kept = d.decontaminate(docs, items, "documents")
    assert kept.columns == names and sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6]
    assert d.decontaminate(docs, items, "spans").where("n_hit = 7 AND `a.b` = 'dotted'").count() == len(TEXTS)
