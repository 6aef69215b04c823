"""Personal data by patterns and by bootstrapped contexts.

The base kinds (email, ip, card, phone) are seeds.  The words around a seed are lexical patterns; a pattern is
trusted for a kind when enough distinct values of the kind stand in it and few other values do.  Trusted
patterns make the identifier-like values they hold candidates of their kind; a value whose patterns together
are certain enough is accepted, counts as known, and the graph of patterns and values is scored again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import groups, text_of, written

KINDS = ("email", "ip", "card", "phone")
#: Distinct known values of a kind a pattern needs, and their share of all its values.
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.75
#: Certainty a value needs from all its trusted patterns.
MIN_SCORE = 0.9

# Base kinds: fixed patterns of the contract.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # from within a run of digits nothing else would match
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# What an identifier that no base kind takes may look like.
_NUMBER = re.compile(r"\(?[0-9](?:[ ().-]{0,2}[0-9]){5,}")
_AT = re.compile(r"@|\(at\)|\[at\]")
_HOST = re.compile(r" ?\w[\w.-]*\w")
_USER = re.compile(r"[\w.+-]")
_WORD = re.compile(r"[^\W_]+")
_NOT_DIGITS = bytes(b for b in range(256) if not 48 <= b <= 57)
_CONTEXT = 60  # characters on either side that may hold the two words before and the one after


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain: from each @ back to where its local part begins."""
    last, at = 0, text.find("@")
    while at >= 0:
        domain, start = _DOMAIN.match(text, at + 1), at
        if domain:
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, domain.end()
                last = domain.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end, kind) of the base kinds, by start and then as the kinds are listed."""
    spans = [(s, 0, e) for s, e in _emails(text)]
    if text.encode("utf-8", "surrogatepass").translate(None, _NOT_DIGITS):
        # Zeros in front may be any number.
        parts = ((m, [p.lstrip("0") for p in m[0].split(".")]) for m in _IP.finditer(text))
        spans += [(m.start(), 1, m.end()) for m, own in parts if all(len(p) <= 3 and int(p or 0) <= 255 for p in own)]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return [(s, e, KINDS[k]) for s, k, e in sorted(spans)]


def _fits(value: str) -> list[str]:
    """Kinds a candidate could be."""
    if "@" in value or "at" in value:
        return ["email"]
    digits = sum(map(str.isdigit, value))
    return [
        *(["ip"] if _IP.fullmatch(value) else []), *(["card"] if 12 <= digits <= 19 else []), *(["phone"] if 7 <= digits <= 15 else []),
    ]


def _mails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``[\\w.+-]+``, an at sign of some kind with a space at most on its sides, and a host."""
    last = 0
    for at in _AT.finditer(text):
        if at.start() < last or not (host := _HOST.match(text, at.end())):
            continue
        end = start = at.start() - (at.start() > last and text[at.start() - 1] == " ")
        while start > last and _USER.match(text[start - 1]):
            start -= 1
        if start < end:
            yield start, host.end()
            last = host.end()


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, list[str]]]:
    """Identifier-like spans that touch no base span: (start, end, kinds it could be)."""
    found = [m.span() for m in _NUMBER.finditer(text)] if re.search("[0-9]", text) else []
    if "@" in text or "(at)" in text or "[at]" in text:
        found += _mails(text)
    out, taken, i, covered = [], sorted((s, e) for s, e, _ in base), 0, 0  # covered: up to here something is taken
    for s, e in sorted(found):
        while i < len(taken) and taken[i][0] < e:
            covered, i = max(covered, taken[i][1]), i + 1
        if s >= covered and (fits := _fits(text[s:e])):
            out.append((s, e, fits))
            covered = e
    return out


def _patterns(text: str, start: int, end: int) -> list[str]:
    before = _WORD.findall(text[max(0, start - _CONTEXT):start].lower())
    after = _WORD.search(text[end:end + _CONTEXT].lower())
    right = after[0] if after else ""
    return [p for p in (" ".join(before[-2:]) + " *" if len(before) > 1 else "", f"{before[-1]} * {right}" if before and right else "") if p]


_SPAN = "struct<start: int, end: int, kind: string, fits: array<string>, value: string, patterns: array<string>>"
_SPAN_TYPE = pa.struct([
    ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("fits", pa.list_(pa.string())), ("value", pa.string()),
    ("patterns", pa.list_(pa.string()))])


def _scan(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Columns ``c0``, ... and ``found``: base spans (with kind) and candidates (without)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in groups(batch, "text"):
                rows: list[list[dict[str, Any]]] = []
                for t in own.column("text").to_pylist():
                    base = base_spans(t)
                    spans = [(s, e, kind, []) for s, e, kind in base] + [(s, e, None, fits) for s, e, fits in candidates(t, base)]
                    rows.append([
                        {"start": s, "end": e, "kind": kind, "fits": fits, "value": " ".join(t[s:e].split()), "patterns": _patterns(t, s, e)}
                        for s, e, kind, fits in spans])
                fields = [own.schema.field(i) for i in range(own.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[:-1], pa.array(rows, pa.list_(_SPAN_TYPE))], schema=pa.schema([*fields, ("found", pa.list_(_SPAN_TYPE))]))

    narrow = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), text_of(df, text).alias("text"))
    kept = [f"c{i} {narrow.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep))]
    return narrow.mapInArrow(scan, ", ".join([*kept, f"found array<{_SPAN}>"]))


def discover(occurrences: DataFrame, rounds: int | None = None) -> DataFrame:
    """Values accepted beyond the seeds: (value, kind).  ``occurrences``: value, kind, fits, patterns.

    Each round scores patterns by the known values they hold and values by their trusted patterns; values are
    counted once per pattern, however often copies repeat them.  Rounds go on until one accepts nothing (or to
    ``rounds``); each but the last adds values, so they end.
    """
    edges = written(occurrences.select("value", "kind", "fits", F.explode("patterns").alias("pattern")).distinct(), "pii-edges")
    sizes = edges.groupBy("pattern").agg(F.count_distinct("value").alias("n_all")).where(F.col("n_all") > MIN_SUPPORT)
    seeds = written(edges.where("kind IS NOT NULL").select("value", "kind").distinct(), "pii-seeds")
    open_edges = edges.where("kind IS NULL").select("value", F.explode("fits").alias("kind"), "pattern").distinct()
    known, accepted = seeds, seeds.limit(0)
    files: list[str] = []
    for round_no in count() if rounds is None else range(rounds):
        trusted = (
            edges.select("pattern", "value").distinct().join(known, "value").groupBy("pattern", "kind").agg(F.count("*").alias("n_known"))
            .join(sizes, "pattern").withColumn("confidence", F.col("n_known") / F.col("n_all"))
            .where((F.col("n_known") >= MIN_SUPPORT) & (F.col("confidence") >= MIN_CONFIDENCE))
        )
        # Independent patterns: a value is wrong only if all of them are.
        scored = open_edges.join(trusted, ["pattern", "kind"]).groupBy("value", "kind").agg(
            (1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))))).alias("score"))
        best = scored.groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score"))
        new = best.where(F.col("score") >= MIN_SCORE).select("value", "kind").join(known.select("value"), "value", "left_anti")
        new = written(new, f"pii-round-{round_no}")
        if new.isEmpty():
            break
        # One scan of all rounds' tables: the plan doesn't grow with the rounds.
        files += new.inputFiles()
        accepted = new.sparkSession.read.schema(new.schema).parquet(*files)
        known = seeds.unionByName(accepted)
    return accepted


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def find(df: DataFrame, keep: list[str], text: str = "text", rounds: int | None = None) -> DataFrame:
    """Columns ``c0``, ... (those of ``keep``), ``base`` and ``spans``: kind:start:end in code points, comma-joined.

    ``base`` has the base kinds' spans, ``spans`` those and the discovered ones.  Null texts are empty and hold
    none; repeated rows are found alike; an empty table gives no rows.
    """
    rows = written(_scan(df, keep, text).withColumn("row", F.monotonically_increasing_id()), "pii-scan")
    occurrences = rows.select("row", F.inline("found"))
    accepted = discover(occurrences, rounds)
    more = (
        occurrences.where("kind IS NULL").drop("kind").join(accepted, "value")
        .groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("more"))  # the spans of one text
    )
    base = F.filter("found", lambda s: s["kind"].isNotNull())
    plain = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    none = F.expr("cast(array() as array<struct<start: int, end: int, kind: string>>)")
    return rows.join(more, "row", "left").select(
        *(f"c{i}" for i in range(len(keep))), _joined(plain).alias("base"),
        _joined(F.concat(plain, F.coalesce("more", none))).alias("spans"))


def count_kind(spans: Column, kind: str) -> Column:
    return F.regexp_count(spans, F.lit(f"{kind}:")).cast("long")


def redact(df: DataFrame, text: str = "text", length: str | None = None, rounds: int | None = None) -> DataFrame:
    """``df`` with each span replaced by its kind in brackets; overlapping spans become one of the first's kind.

    ``length`` names a column that holds the text's length and follows it.  Rows without spans stay as they are,
    null texts too.  Empty table: no rows.  Other columns stay, whatever their names.
    """
    # The caller's columns are c0, c1, ... on the way, so no name of theirs meets one of these.
    names = df.columns
    at = names.index(text)
    rows = written(df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.monotonically_increasing_id().alias("row")), "to-redact")
    spans = find(rows, ["row"], f"c{at}", rounds).where("spans != ''").select(F.col("c0").alias("row_of"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_replace(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row_of", "redacted"])

    hit = rows.join(spans, F.col("row") == F.col("row_of"))
    new = hit.select("row", f"c{at}", "spans").mapInArrow(run, "row_of long, redacted string")
    out = rows.join(new, F.col("row") == F.col("row_of"), "left")
    columns = []
    for i, c in enumerate(names):
        value = F.col(f"c{i}")
        if c == text:
            value = F.coalesce("redacted", value)
        elif c == length:
            value = F.when(F.col("redacted").isNull(), value).otherwise(F.char_length("redacted").cast(df.schema[c].dataType))
        columns.append(value.alias(c))
    return out.select(*columns)


def _replace(text: str, spans: str) -> str:
    out, at, end = [], 0, 0
    for kind, start, stop in (s.split(":") for s in spans.split(",")):
        if int(start) >= end:
            out += [text[at:int(start)], f"[{kind.upper()}]"]
        at = end = max(end, int(stop))
    return "".join([*out, text[at:]])
