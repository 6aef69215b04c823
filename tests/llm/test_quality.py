from __future__ import annotations

import re
from collections import Counter

from medallion.llm import quality as q

from .conftest import ODD


def _brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    inside = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside)


TEXTS = [t for _, t, _ in ODD] + [
    "a b c a b c", "x y z\nx y z\nx y z", "# one | two <three> & four", "a a a", "a a a a", "one two", "line\n\nline\n  \nline ", "é ü ñ é ü ñ 漢",
    " ".join(str(i) for i in range(3000)),
]


def test_measures():
    for text in TEXTS:
        one = q.Text(None if text is None else text.encode())
        assert (one.n_words, one.word_chars, one.n_symbols, one.n_dup_lines, one.n_repeat_words) == _brute(text), text


def test_verdict_does_not_hang_on_the_order(llm, odd):
    for rules in (q.RULES, q.RULES[::-1]):
        kept = q.judge(odd, ["text"], rules).where("rejected_by IS NULL").collect()
        assert all(not any(r.rejects(q.Text((k["c0"] or "").encode())) for r in q.RULES) for k in kept)


def test_order_is_by_rejections_per_cost(llm):
    spin = lambda t: sum(range(30_000)) < 0 or t.text.startswith(b"bad")
    rules = (q.Rule("dear", spin), q.Rule("cheap", lambda t: t.text.startswith(b"bad")), q.Rule("never", lambda t: False), q.Rule("rest", lambda t: t.text.startswith(b"sad")))
    docs = llm.createDataFrame([("bad text",)] * 60 + [("sad text",)] * 20 + [("good text",)] * 40, "text string")
    order = [r.name for r in q.order_rules(docs, rules)]
    # What the cheap rule rejects, the dear one can't reject any more.
    assert order[:2] == ["cheap", "rest"] and set(order[2:]) == {"dear", "never"}
    assert [r.name for r in q.order_rules(docs.limit(0), rules)] == [r.name for r in rules]


def test_shared_measures_cost_once(llm):
    """Two rules read the same dear measure: with the first of them chosen, the second is cheaper than a rule of its own."""
    def dear(t):
        return t.n_repeat_words < 0 or t.text.startswith(b"bad")

    rules = (q.Rule("first", dear), q.Rule("own", lambda t: sum(range(4_000)) < 0 or t.text.endswith(b"sad")), q.Rule("second", lambda t: t.n_repeat_words < 0 or t.text.endswith(b"mad")))
    filler = " ".join(f"w{i}" for i in range(2_000))
    docs = llm.createDataFrame([(f"bad {filler}",)] * 80 + [(f"{filler} sad",)] * 3 + [(f"{filler} mad",)] * 3 + [(filler,)] * 10, "text string")
    assert [r.name for r in q.order_rules(docs, rules)] == ["first", "second", "own"]


def test_odd_rows(odd, none):
    assert q.keep_good(odd).columns == odd.columns
    assert q.keep_good(none).count() == 0
