"""Quality rules as a short-circuit cascade.

Each rule rejects a text or passes it on.  On a bounded sample every rule and every measure that rules share is
timed, and each rule's rejections are counted together with those of the other rules; then the rule with the most
rejections per second among the texts still standing comes first, and so on.  A measure that an earlier rule has
computed already costs a later one nothing.  The order decides how much is computed, never the verdict.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, text_of

#: Rows the costs and rejections are estimated on, at most about.
SAMPLE_ROWS = 2_000

_SPACE = b" \t\n\x0b\x0c\r"
_NOT_COUNTED = bytes(range(0x80, 0xC0)) + _SPACE  # later bytes of a character, white space
_SYMBOLS = b"#*$%&|<>"


class Text:
    """A text's measures, each computed when a rule first asks for it.

    Words are runs without ASCII white space.  All counts are whole numbers, so no verdict hangs on rounding.
    """

    def __init__(self, text: bytes | None):
        self.text = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, _NOT_COUNTED))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, _SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside three-word windows that stand in the text twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        names: dict[bytes, int] = {}
        codes = np.array([names.setdefault(w, len(names)) for w in self.words], np.int64)
        if len(names) < 1 << 21:
            key = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
            order = np.argsort(key, kind="stable")
            same = key[order[1:]] == key[order[:-1]]
        else:
            order = np.lexsort((codes[2:], codes[1:-1], codes[:-2]))
            same = np.ones(n - 3, bool)
            for shift in range(3):
                own = codes[order + shift]
                same &= own[1:] == own[:-1]
        again = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        inside = np.zeros(n, bool)
        for shift in range(3):
            inside[again + shift] = True
        return int(inside.sum())


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a text that must go."""

    name: str
    rejects: Callable[[Text], bool]


#: Rules every corpus of the contract has: they alone decide ``base_failed``.
BASE_RULES = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
#: A symbol for every ten words, words of 3 to 10 letters on average, four of five lines seen before.
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("word_length", lambda t: not 3 * t.n_words <= t.word_chars <= 10 * t.n_words),
    Rule("repeated_lines", lambda t: 10 * t.n_dup_lines > 8 * len(t.lines)),
)


#: Measures in an order in which each needs only those before it.
SHARED = ("words", "n_words", "word_chars", "n_symbols", "lines", "n_dup_lines", "n_repeat_words")


def estimate(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per set of rejecting rules (bit i: rule i) of a sample: rows, and sums over them.

    ``ns`` are nanoseconds: of each measure of ``SHARED`` where those it needs are there, then of each rule where all
    measures are there.  ``uses`` counts the texts of which a rule read a measure, rule by rule.
    """
    width = len(SHARED)

    def timed(call: Callable[[], object]) -> int:
        began = time.perf_counter_ns()
        call()
        return time.perf_counter_ns() - began

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        spent: dict[int, np.ndarray] = {}
        used: dict[int, np.ndarray] = {}
        for batch in batches:
            for value in batch.column(0).to_pylist():
                mask, uses = 0, []
                for i, rule in enumerate(rules):
                    alone = Text(value)
                    mask |= rule.rejects(alone) << i
                    uses += [m in vars(alone) for m in SHARED]
                whole = Text(value)
                times = [timed(lambda m=m: getattr(whole, m)) for m in SHARED]
                times += [timed(lambda r=r: r.rejects(whole)) for r in rules]
                seen[mask] += 1
                spent[mask] = spent.get(mask, 0) + np.array(times, np.int64)
                used[mask] = used.get(mask, 0) + np.array(uses, np.int64)
        yield pa.RecordBatch.from_pydict(
            {"mask": list(seen), "n": list(seen.values()), "ns": [spent[m].tolist() for m in seen], "uses": [used[m].tolist() for m in seen]},
            schema=pa.schema([("mask", pa.int64()), ("n", pa.int64()), ("ns", pa.list_(pa.int64())), ("uses", pa.list_(pa.int64()))]))

    total = df.count()
    share = min(1.0, sample_rows / total) if total else 1.0
    sample = df.sample(share, seed=1).select(text_of(df, text).cast("binary").alias("text"))
    parts = sample.mapInArrow(measure, "mask long, n long, ns array<long>, uses array<long>")
    return parts.groupBy("mask").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("ns")[i]) for i in range(width + len(rules))]).alias("ns"),
        F.array(*[F.sum(F.col("uses")[i]) for i in range(width * len(rules))]).alias("uses"))


def order_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by rejections per cost, each counted among the texts the rules before it let pass.

    A rule's cost is its own and that of the measures it reads which no rule before it has read.  The estimate has at
    most one row per set of rules.  An empty table leaves the rules as they stand.
    """
    rows = [(r["mask"], r["n"], r["ns"], r["uses"]) for r in estimate(df, rules, text, sample_rows).collect()]
    seen, width = max(1, sum(n for _, n, _, _ in rows)), len(SHARED)
    mean = [sum(ns[i] for _, _, ns, _ in rows) / seen for i in range(width + len(rules))]
    share = [[sum(uses[i * width + j] for *_, uses in rows) / seen for j in range(width)] for i in range(len(rules))]
    there = [0.0] * width  # the share of texts whose measure is computed by now

    def cost(i: int) -> float:
        return max(1.0, mean[width + i] + sum(mean[j] * max(0.0, share[i][j] - there[j]) for j in range(width)))

    left, order = list(range(len(rules))), []
    while left:
        best = max(left, key=lambda i: (sum(n for mask, n, _, _ in rows if mask >> i & 1) / cost(i), -i))
        rows = [r for r in rows if not r[0] >> best & 1]
        there = [max(a, b) for a, b in zip(there, share[best], strict=True)]
        left.remove(best)
        order.append(rules[best])
    return tuple(order)


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(df: DataFrame, keep: list[str], rules: tuple[Rule, ...], text: str = "text", measures: bool = False) -> DataFrame:
    """Columns ``c0``, ``c1``, ... (those of ``keep``) and ``rejected_by``: the first rule in order, null if none.

    With ``measures`` also the base counts of every row, whatever the cascade left out.  Null text: as empty.  A long
    text is judged whole, alone in its group; repeated rows are judged alike; an empty table gives no rows; columns may
    have any name.
    """
    extra = _MEASURES if measures else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in groups(batch, "text"):
                reasons: list[str | None] = []
                counts: list[list[int]] = []
                for value in own.column("text").to_pylist():
                    one = Text(value)
                    reasons.append(next((r.name for r in rules if r.rejects(one)), None))
                    counts.append([getattr(one, m) for m in extra])
                arrays = [pa.array(reasons, pa.string()), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(len(extra)))]
                fields = [own.schema.field(i) for i in range(own.num_columns - 1)]
                fields += [pa.field("rejected_by", pa.string()), *(pa.field(m, pa.int64()) for m in extra)]
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], *arrays], schema=pa.schema(fields))

    narrow = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), text_of(df, text).cast("binary").alias("text"))
    kept = [f"c{i} {narrow.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep))]
    return narrow.mapInArrow(run, ", ".join([*kept, "rejected_by string", *(f"{m} long" for m in extra)]))


def keep_good(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows whose text no rule rejects; the columns stay as they are, and each repeated row is judged alike."""
    judged = judge(df, df.columns, order_rules(df, rules, text, sample_rows), text)
    return judged.where("rejected_by IS NULL").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)))
