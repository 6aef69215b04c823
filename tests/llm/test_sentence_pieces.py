from __future__ import annotations

import hashlib
import random

import pytest
from sentencepiece import SentencePieceProcessor

from medallion.llm import sentence_pieces as sp
from medallion.llm.catalogue import QUERIES
from medallion.llm.common import table

from .conftest import ODD

LIBRARY = SentencePieceProcessor(model_file=sp.default_path())
TEXTS = [t or "" for _, t, _ in ODD] + [
    "  a  b\n\tc ", "a▁b", "▁", "▁▁", " ", "  ", "a ", "a  ", "\n", "\n \n", " \n x", "\x00a", "naïve 漢字\U0001f600 ﬁ", "</s><s><unk>x",
    "\r\n x", " " * 1000, "a" * 3000, "漢字" * 500, ". .. ... (a) \"b\" 'c 12 345", "end.\nNew line,\n\nand more;", "<0x0A>"]


def _mixed(seed, n):
    rng = random.Random(seed)
    letters = [*"ab  ▁\né漢<>0x.Theing", "\U0001f600", " (", "...", "'s", "—", "“", "́"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_and_texts_are_the_librarys():
    pieces = sp.PieceModel(sp.default_path())
    for text in TEXTS + _mixed(1, 3000):
        ids = LIBRARY.encode(text)
        assert pieces.encode(text) == ids, text[:60]
        assert pieces.decode(ids) == LIBRARY.decode(ids), text[:60]
    assert pieces.check() == set()


def test_any_ids_decode_as_in_the_library():
    pieces, rng = sp.PieceModel(sp.default_path()), random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(32_000), rng.randrange(3, 259)]) for _ in range(rng.randint(0, 12))]
        assert pieces.decode(ids) == LIBRARY.decode(ids), ids


def test_agenda_on_whole_texts_gives_the_same():
    pieces = sp.PieceModel(sp.default_path())
    for text in _mixed(3, 500):
        if text:
            whole = pieces.merge(sp.MARK + text.replace(" ", sp.MARK))
            cut = [p for c in pieces.split(text) for small in pieces.pattern.findall(c) for p in pieces.merge(small)]
            assert whole == cut


def test_a_full_table_of_cuts_changes_nothing(monkeypatch):
    monkeypatch.setattr(sp, "CACHE_CUTS", 3)
    pieces = sp.PieceModel(sp.default_path())
    for text in TEXTS:
        assert pieces.encode(text) == LIBRARY.encode(text)
    assert len(pieces.known) <= 4


def test_the_check_finds_wrong_ids():
    pieces = sp.PieceModel(sp.default_path())
    pieces.encode("the quick word")
    pieces.unchecked["▁word"] = b"1234"
    assert pieces.check() == {"▁word"}
    pieces.unchecked[","] = b"1234"
    assert pieces.check() == {","}


def test_query_on_the_whole_table(llm, sf):
    got = {r["doc_id"]: r for r in QUERIES["op11_sentence_pieces"](llm, sf).collect()}
    docs = table(llm, sf, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = LIBRARY.encode(d["text"] or "")
        r = got[d["doc_id"]]
        assert r["agrees"] and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("whole", [False, True])
def test_odd_rows(odd, none, whole):
    dotted = odd.withColumn("a.b", odd["c0"]).withColumn("ids", odd["n"]).withColumn("decoded", odd["n"])
    got = sp.encode_documents(dotted, ["doc_id", "a.b", "ids"], whole=whole).collect()
    assert len(got) == len(ODD) and all(r["agrees"] for r in got)
    for r in got:
        assert r["ids"] == LIBRARY.encode(ODD[int(r["c1"])][1] or "") and r["decoded"] == LIBRARY.decode(r["ids"])
    assert sp.encode_documents(none, ["doc_id"], whole=whole).count() == 0
