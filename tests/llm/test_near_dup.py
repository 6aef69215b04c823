from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from medallion.llm import near_dup as n
from medallion.llm.common import table
from medallion.llm.decontaminate import words_of

from .conftest import ODD


def _bag(text):
    words = words_of((text or "").encode())
    size = min(5, len(words))
    return Counter(tuple(words[i:i + size]) for i in range(len(words) - size + 1)) if size else Counter()


def _jaccard(a, b):
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 1.0


def _classes(rows):
    """Least key of each row's class, by comparing all pairs."""
    bags = [_bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if _jaccard(bags[i], bags[j]) >= 0.8:
                root[find(i)] = find(j)
    keys = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        keys[find(i)] += [key] * (key is not None)
    return sorted(((key, min(keys[find(i)], default=None)) for i, (key, _) in enumerate(rows)), key=str)


def test_similarity_is_exact():
    rng = random.Random(2)
    for _ in range(30):
        a, b = (" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert n.similarity(n.shingles(a.encode()), n.shingles(b.encode())) == pytest.approx(_jaccard(_bag(a), _bag(b)))


def test_signatures_are_unbiased_for_weights():
    rng = np.random.default_rng(1)
    gaps = []
    for _ in range(40):
        keys = np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64))
        one = rng.integers(0, 20, len(keys))
        two = np.maximum(0, one + rng.integers(-4, 5, len(keys)))
        a, b = (keys[one > 0], one[one > 0]), (keys[two > 0], two[two > 0])
        s = n.signatures([a, b], 1024)
        gaps.append((s[0] == s[1]).mean() - n.similarity(a, b))
    assert abs(np.mean(gaps)) < 0.008 and np.sqrt(np.mean(np.square(gaps))) < 0.025


def test_signature_of_a_text_does_not_depend_on_its_neighbours():
    bags = [n.shingles(t) for t in (b"", b"a b c d e f g", b"one two", b"x " * 5000, b"a b c d e f h")]
    together = n.signatures(bags)
    for i, bag in enumerate(bags):
        assert (n.signatures([bag]) == together[i]).all()


@pytest.mark.parametrize("finish_edges", [n.FINISH_EDGES, 0, 30])
def test_components(llm, finish_edges):
    path = [(bytes([i // 256, i % 256]), bytes([(i + 1) // 256, (i + 1) % 256])) for i in range(200)]
    other = [(b"x", b"y"), (b"y", b"z"), (b"z", b"x"), (b"q", b"q")]
    found = n.components(llm.createDataFrame(path + other, "a binary, b binary"), "test", finish_edges).collect()
    by = defaultdict(set)
    for r in found:
        by[bytes(r["class"])].add(bytes(r["node"]))
    assert sorted(map(len, by.values())) == [3, 201]


def _words(rng, k):
    return [f"w{rng.randrange(4000)}" for _ in range(k)]


@pytest.mark.parametrize("finish_edges", [n.FINISH_EDGES, 0])
def test_chains_hubs_and_passages_like_brute_force(llm, monkeypatch, finish_edges):
    """Links that don't go by the pivot, a common passage, copies, short texts."""
    monkeypatch.setattr(n.components, "__defaults__", ("links", finish_edges))
    rng = random.Random(4)
    rows, key = [], 0

    def add(words):
        nonlocal key
        key += 1
        rows.append((key, " ".join(words)))

    for _ in range(4):  # chains: each text near the next, the ends far apart
        words = _words(rng, 120)
        for step in range(8):
            add(words)
            words = words[4:] + _words(rng, 4)
    passage = _words(rng, 60)
    for _ in range(40):  # a passage that is most of the text
        add(passage + _words(rng, 15))
    hub = _words(rng, 100)
    for i in range(40):  # near copies of one text
        add([*hub[:i], f"new{i}", *hub[i + 1:]])
    for _ in range(5):
        add(hub)
    for short in ("one two", "One, two!", "one two three", "", None, "!!", "a a a a a a a a a a a a", "a a a a a a a a a a a"):
        key += 1
        rows.append((key, short))
    rng.shuffle(rows)
    got = n.classes(llm.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(((r["key"], r["class_id"]) for r in got.collect()), key=str) == _classes(rows)


def test_all_documents_like_brute_force(llm, sf):
    docs = table(llm, sf, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(((r["key"], r["class_id"]) for r in n.classes(docs).collect()), key=str) == _classes(rows)
    kept = n.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for _, c in _classes(rows)})


def test_odd_rows(odd, none):
    rows = [(k, t) for k, t, _ in ODD]
    assert sorted(((r["key"], r["class_id"]) for r in n.classes(odd).collect()), key=str) == _classes(rows)
    kept = n.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == len(rows) - 3  # the copy, and two of three without words
    assert n.classes(none).count() == 0 and n.deduplicate(none).count() == 0


@pytest.mark.parametrize("spread", [0, 4])
def test_a_crowd_of_one_template_does_not_pair(llm, spread):
    """Texts of similarity 0.77 at most by their template: no pairings that grow with the square of the texts, and no link."""
    rng = random.Random(7)
    template = _words(rng, 200)

    def met(count):
        rows = [(i, " ".join(template + [f"own{i}x{j}" for j in range(33 + rng.randint(-spread, spread))])) for i in range(count)]
        texts = llm.createDataFrame([(str(i).encode(), t.encode()) for i, t in rows], "node binary, text binary")
        sizes = [(str(i).encode(), sum(_bag(t).values()), str(i).encode(), 1) for i, t in rows]
        members = llm.createDataFrame(sizes, "node binary, n long, class binary, band long")
        seen = {}

        def sides(prefix, threshold, real=n._sides):
            seen["sides"] = real(prefix, threshold)
            return seen["sides"]

        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(n, "_sides", sides)
            pairs = n._prefix_pairs(members, texts, 5, 0.8).count()
        x, y = seen["sides"]
        return x.select("element", "size").join(y.select("element", "size"), ["element", "size"]).count(), pairs

    (few, no), (more, none) = met(100), met(200)
    assert no == none == 0 and more <= 2 * few + 200


def test_prefix_pairs_lose_no_link(llm):
    """All links between texts of lengths that vary, each text a class of its own."""
    rng = random.Random(9)
    rows = []
    for _ in range(12):
        words = _words(rng, rng.randint(20, 150))
        for _ in range(8):
            cut = rng.randint(0, len(words) // 8)
            rows.append(" ".join([*words[cut:], *_words(rng, rng.randint(0, len(words) // 8))]))
    rows = sorted(set(rows))
    texts = llm.createDataFrame([(str(i).encode(), t.encode()) for i, t in enumerate(rows)], "node binary, text binary")
    members = llm.createDataFrame([(str(i).encode(), sum(_bag(t).values()), str(i).encode(), 1) for i, t in enumerate(rows)],
                                  "node binary, n long, class binary, band long")
    got = [frozenset((int(bytes(r["a"])), int(bytes(r["b"])))) for r in n._prefix_pairs(members, texts, 5, 0.8).collect()]
    bags = [_bag(t) for t in rows]
    links = {frozenset((i, j)) for i in range(len(rows)) for j in range(i) if _jaccard(bags[i], bags[j]) >= 0.8}
    assert len(links) > 50 and links <= set(got) and len(got) == len(set(got))
