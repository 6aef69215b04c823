from __future__ import annotations

import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from medallion.llm import pii
from medallion.llm.common import table

from .conftest import ODD

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def _luhn(digits):
    d = [int(c) for c in digits[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def _brute(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (k == 0 or k == 1 and all(int(p) <= 255 for p in m[0].split(".")) or k == 2 and 14 <= len(digits) <= 19 and _luhn(digits)
                    or k == 3 and 10 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return [(s, e, pii.KINDS[k]) for s, k, e in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@- +()4漢%_9é", max_size=60))
def test_base_spans_like_the_patterns(text):
    assert pii.base_spans(text) == _brute(text)


def test_base_spans_of_known_cases():
    for text in ("a@b.c@d.e", "x@y.z.", "@a.b", "a@@b.c", "1.2.3.4.5", "999.1.1.1 1.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112",
                 "+1 (988) 555-2485", "+1 2", "4111111111111111@x.yz", "++1234567890", "a" * 50_000 + "@b.co", "1 " * 30_000, "9." * 20_000):
        assert pii.base_spans(text) == _brute(text), text[:40]


def test_zeros_before_an_ip_part():
    for n in (0, 98, 99, 5000):
        text = f"at {'0' * n}10.0.{'0' * n}255.1 now"
        assert pii.base_spans(text)[0] == (3, len(text) - 4, "ip")
        assert "ip" not in {k for _, _, k in pii.base_spans(f"at {'0' * n}256.0.0.1 now")}
    assert pii.base_spans("at 9" + "0" * 5000 + ".1.1.1") == []


def _spans(rows):
    return {r["c0"]: (r["base"], r["spans"]) for r in rows}


def test_contexts_find_what_no_base_kind_takes(llm):
    """Seeds teach a pattern; what it finds teaches the next; values without such contexts stay."""
    rows = [(i, f"please call us at +1 (9{i:02d}) 555-2485 today") for i in range(20)]
    rows += [(i, f"please call us at 555-2{i}-19 now, or ring desk number 555-2{i}-19 tonight") for i in range(100, 102)]
    rows += [(i, f"or ring desk number +1 ({i}) 555-2485 tonight") for i in range(200, 203)]
    rows += [(300, "or ring desk number 777-88-9912 tonight"), (301, "the code of the part is 777-88-1234 here"), (302, "nothing to see")]
    found = _spans(pii.find(llm.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect())
    assert found[100] == ("", "phone:18:29,phone:55:66")  # 20 of 22 values of its pattern are phones
    assert found[300] == ("", "phone:20:31")  # known only since the round before
    assert found[301] == ("", "") and found[302] == ("", "")
    assert all(found[i][0] == found[i][1] == "phone:18:35" for i in range(20))


def test_chain_of_five_contexts(llm):
    """Each context is trusted only with the values that the one before it gave."""
    places = [("call", "home", "soon"), ("ring", "desk", "later"), ("reach", "office", "again"), ("try", "garage", "twice"), ("ask", "kitchen", "first")]
    rows = []
    for i, (a, b, c) in enumerate(places):
        values = [f"+1 (9{k:02d}) 555-2485" for k in range(6 if i else 9)]
        values += [f"555-2{i}0{k}-19" for k in range(3 if i else 0)] + [f"555-2{i + 1}0{k}-19" for k in range(3)]
        rows += [(100 * i + n, f"please {a} {b} {v} {c}") for n, v in enumerate(values)]
    found = _spans(pii.find(llm.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect())
    assert len(found) == len(rows) and all(spans.startswith("phone:") for _, spans in found.values())
    redacted = pii.redact(llm.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all("[PHONE]" in r["text"] and "555" not in r["text"] for r in redacted)


def test_copies_do_not_teach(llm):
    rows = [(i, "please call us at +1 (900) 555-2485 today") for i in range(50)] + [(99, "please call us at 555-2411-19 today")]
    assert _spans(pii.find(llm.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect())[99] == ("", "")


def test_redaction(llm):
    rows = [(1, "mail a.b@c.de and 10.0.0.1!", 27), (2, "ok", 2), (3, None, 0), (4, "+1 4111 1111 1111 11", 20)]
    df = llm.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(df, length="n_chars").collect()}
    assert got[1] == ("mail [EMAIL] and [IP]!", 22) and got[2] == ("ok", 2) and got[3] == (None, 0) and got[4][0] == "[PHONE]"


def test_odd_rows(odd, none):
    found = pii.find(odd, ["doc_id", "c0"])
    assert found.count() == len(ODD) and {r["spans"] for r in found.collect()} == {""}
    out = pii.redact(odd)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    clash = odd.withColumnsRenamed({"c0": "redacted", "n": "row_of"})
    assert pii.redact(clash).columns == clash.columns and pii.redact(clash).count() == len(ODD)
    assert pii.find(none, ["doc_id"]).count() == 0 and pii.redact(none).count() == 0


def test_all_documents(llm, sf):
    docs = table(llm, sf, "documents")
    for r in pii.find(docs, ["text"]).collect():
        assert r["base"] == ",".join(f"{k}:{s}:{e}" for s, e, k in _brute(r["c0"]))


def test_clashing_and_dotted_columns(llm):
    names = ["doc_id", "text", "row", "row_of", "spans", "redacted", "a.b", "c0", "c1", "n_chars"]
    rows = [(1, "write to a.b@example.com now", 1, 2, "s", "r", "dotted", "c", "d", 28), (2, None, 1, 2, "s", "r", "dotted", "c", "d", None)]
    kinds = ["long", "string", "long", "long", "string", "string", "string", "string", "string", "long"]
    df = llm.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))
    got = pii.redact(df, length="n_chars")
    assert got.columns == names
    text = "write to [EMAIL] now"
    assert sorted(tuple(r) for r in got.collect()) == [(1, text, *rows[0][2:9], len(text)), rows[1]]


def test_mails_and_ips_like_plain_patterns():
    mail, ip = re.compile(r"[\w.+-]+ ?(?:@|\(at\)|\[at\]) ?\w[\w.-]*\w"), re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice(["a", "b.", " ", "@", "(at)", "[at]", "-", "1", "2.3", ".", "é", "+", "\n"]) for _ in range(rng.randint(0, 25)))
        assert list(pii._mails(text)) == [m.span() for m in mail.finditer(text)], text
        assert [m.span() for m in pii._IP.finditer(text)] == [m.span() for m in ip.finditer(text)], text


def test_long_runs_take_time_in_proportion_to_their_length():
    for text in ("a" * 1_000_000 + " @", "1" * 1_000_000 + " x", "1." * 500_000, "a@" * 300_000, "+1" + "(" * 500_000):
        began = time.process_time()
        pii.candidates(text, pii.base_spans(text))
        assert time.process_time() - began < 8
