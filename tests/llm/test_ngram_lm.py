from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from medallion.llm import ngram_lm as lm
from medallion.llm.decontaminate import words_of

from .conftest import ODD


def _brute(texts, order=3):
    docs = [[w.decode() for w in words_of((t or "").encode())] for t in texts]
    grams = [Counter(tuple(d[i:i + k]) for k in range(1, order + 1) for i in range(len(d) - k + 1)) for d in docs]
    total = sum(grams, Counter())
    n = sum(map(len, docs))
    out = []
    for d, own in zip(docs, grams, strict=True):
        micro = full = 0
        for i in range(len(d)):
            longest = min(i + 1, order)
            for k in range(longest, 0, -1):
                gram = tuple(d[i - k + 1:i + 1])
                held = total[gram] - own[gram]
                if held > 0 or k == 1:
                    below = (total[gram[:-1]] - own[gram[:-1]]) if k > 1 else n - len(d)
                    ratio = held / below if held > 0 else 1 / (n - len(d) + 1)
                    micro += int(np.rint((math.log(ratio) + (longest - k) * math.log(0.4)) * 1_000_000))
                    full += k == longest
                    break
        out.append((len(d), micro, full))
    return out


TEXTS = ["the cat sat on the mat", "the cat sat on a hat", "the cat", "mat", "", None, "!", "the cat sat on the mat", "zebra zebra zebra", "on the mat the cat sat on"]


def _rows(df, texts):
    return [tuple(r[c] for c in ("n_words", "score_micro", "n_full")) for r in sorted(df.collect(), key=lambda r: r["k"])]


@pytest.mark.parametrize(("chars", "size", "order"), [(lm.BLOCK_CHARS, lm.PARTITION_BYTES, 3), (30, 10, 3), (30, 10, 2)])
def test_like_brute_force(llm, monkeypatch, chars, size, order):
    monkeypatch.setattr(lm, "PARTITION_BYTES", size)
    monkeypatch.setattr(lm, "BLOCK_CHARS", chars)
    df = llm.createDataFrame(list(enumerate(TEXTS)), "k long, text string").repartition(3)
    assert _rows(lm.score(df, "k", order=order), TEXTS) == _brute(TEXTS, order)


def test_packing_round_trips():
    rng = np.random.default_rng(2)
    counts = rng.choice([0, 0, 1, 7, 254, 255, 256, 10**12], 1001)
    assert (lm._unpack_counts(lm._pack_counts(counts), 1001) == counts).all()
    texts = [b"a bb a ccc", b"", b"bb bb", b"x" * 300]
    words: dict[bytes, int] = {}
    places = np.array([words.setdefault(w, len(words)) for x in texts for w in x.split()], np.int64)
    names = list(words)
    key = {w: lm._unpack_words(lm._pack_words({w: 0}, np.zeros(1, np.int64)))[0] for w in names}
    assert lm._unpack_words(lm._pack_words(words, places)).tolist() == [key[names[i]] for i in places] and len(set(key.values())) == len(key)
    assert not len(lm._unpack_words(lm._pack_words({}, places[:0])))
    keys = np.unique(rng.integers(0, 2**64 - 1, 5000, np.uint64))
    for buckets in (1, 3, 100, 1 << 20):
        seen = 0
        for b in range(buckets):
            low, high = lm._cells(b, buckets)
            own = keys[(keys >> np.uint64(44) >= low) & (keys >> np.uint64(44) < high)] if buckets < 1000 or b < 200 else keys[:0]
            assert (lm._unpack_keys(lm._pack_keys(own, (low, high)), (low, high)) == own).all()
            seen += len(own)
        assert buckets > 1000 or seen == len(keys)


def test_odd_rows(odd, none):
    got = sorted(tuple(r[c] for c in ("n_words", "score_micro", "n_full")) for r in lm.score(odd).collect())
    assert got == sorted(_brute([t for _, t, _ in ODD]))
    assert lm.score(none).count() == 0
