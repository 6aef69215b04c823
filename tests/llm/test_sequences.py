from __future__ import annotations

import zlib

import numpy as np
from tokenizers import Tokenizer

from medallion.llm import sequences, tokens
from medallion.llm.common import table

from .conftest import ODD


def _plain(text):
    tokenizer = Tokenizer.from_file(tokens.default_path())
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, tokens.END_ID], "<u4")


def test_words_give_the_ids_of_whole_texts():
    encoder = tokens.WordEncoder(tokens.default_path())
    texts = [t for _, t, _ in ODD] + [
        "It's  3.14%, don't!! ΣΊΣΥΦΟΣ İstanbul ﬁne été KK a\x1cb x<|endoftext|>y <|startoftext|> ...wow,,, ÉCOLE.",
        "a b c　d ́lead İİ ß ŉ ǆ _under_ 'quoted' we'll 've", "tab\tand\r\nline", "…", "12 34,56"]
    for text in texts:
        assert encoder.encode(text) + (1).to_bytes(4, "little") == _plain(text).tobytes(), text[:40] if text else text


def test_a_full_table_of_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    encoder = tokens.WordEncoder(tokens.default_path())
    text = "one two, three four. Five six two one"
    assert encoder.encode(text) + (1).to_bytes(4, "little") == _plain(text).tobytes()
    assert len(encoder) <= 4 and len(encoder.stems) <= 4


def _expected(rows):
    at, out = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = _plain(text)
        out.append((key, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    return out


def test_round_trip(llm, sf):
    docs = table(llm, sf, "documents")
    got = sequences.read_documents(sequences.write_sequences(docs, length=64, batch_rows=8), batch_rows=8)
    assert [tuple(r) for r in got.orderBy("start").collect()] == _expected([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(odd, none):
    got = sequences.read_documents(sequences.write_sequences(odd)).orderBy("start").collect()
    assert [tuple(r) for r in got] == _expected([(k, t) for k, t, _ in ODD])
    assert sequences.read_documents(sequences.write_sequences(none)).count() == 0


def test_random_access_without_copy(llm, sf):
    docs = table(llm, sf, "documents")
    entry = sequences.write_sequences(docs, length=32, batch_rows=4).orderBy("part").first()
    file = sequences.SequenceFile(entry["path"], entry["header"], entry["batch_bytes"], entry["n_sequences"], 4)
    ids = np.concatenate([_plain(r["text"]) for r in docs.orderBy("doc_id").collect()])[:entry["n_tokens"]]
    for i in (0, 3, 4, 17, entry["n_sequences"] - 1):
        own, mask = file.sequence(i)
        real = ids[32 * i:32 * i + 32]
        assert own[:len(real)].tolist() == real.tolist() and sum(mask.to_pylist()) == len(real) and len(own) == 32
    whole = file.source
    whole.seek(0)
    begin = whole.read_buffer(whole.size()).address
    assert begin <= file.batch(2).column("ids").values.buffers()[1].address < begin + whole.size()
