"""Repair of the turn structure of conversations by the cheapest edits.

A whole conversation has role initials ``(s?(ua)+)?``: a system row at most, then user and assistant in turn.  Edits and
costs: Keep 0, Rerole to user or assistant 2, Delete 3, Insert of an empty user or assistant row 2; a truncated row that
stays adds 1, blank rows and repeats must go.

Rows are dealt out by conversation and sorted by turn within the partition (a secondary sort that spills), and
``mapInPandas`` carries the dynamic programme over Arrow batches.  Its state is, for each of the four places in the
pattern, the least cost, the order of the best edits' texts among the places, and a running digest of the repaired
text; differences of costs are few, so each step is looked up after its first time.  Four bytes of backpointers per
row are kept, beyond ``SPILL_BYTES`` in a file of the shared folder, so a conversation of any length needs bounded
memory but for its own audit.  A conversation is one task's stream, as its rows hang on each other.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import filesystem, work_path

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Backpointers held in memory per conversation.
SPILL_BYTES = 8_000_000
SPACE = r"\x20\x09-\x0D"

# Places in the pattern: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What may be done up to and with one row, in the order of the texts.  None begins another, so two different edit
#: texts of equally many rows are told apart before either ends.  An insertion before a deletion is the same as after it.
_MOVES = ("D", "IK", "IR", "K", "R")

Best = tuple[tuple[int, int] | None, ...]  # per place: cost above the least one, and order of the text
Step = tuple[Best, bytes, int, tuple[tuple[int, str] | None, ...]]

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _landing(place: int, move: str, initial: str) -> int | None:
    """Where a move leads, or nothing."""
    if move == "D":
        return place
    if move[0] == "I":
        place = _NEXT[place]
    if move[-1] == "R":
        return _NEXT[place]
    if initial == "s":
        return SYSTEM if place == START else None
    target = {"u": USER, "a": ASSISTANT}.get(initial)
    return target if target == _NEXT[place] else None


def advance(best: Best, initial: str, must_go: bool, truncated: bool) -> Step:
    """The programme one row on: new state, backpointers, cost common to all places, and each place's origin and move."""
    found: list[tuple[int, int, int, int] | None] = [None] * 4  # cost, order of the origin, move, origin
    for place, held in enumerate(best):
        if held is None:
            continue
        for m, move in enumerate(_MOVES):
            target = None if must_go and move != "D" else _landing(place, move, initial)
            if target is None:
                continue
            cost = held[0] + (DELETE if move == "D" else (REROLE if move[-1] == "R" else KEEP) + TRUNCATED * truncated)
            cost += INSERT if move[0] == "I" else 0
            candidate = (cost, held[1], m, place)
            if found[target] is None or candidate < found[target]:
                found[target] = candidate
    least = min(f[0] for f in found if f)
    order = sorted((f[1], f[2], t) for t, f in enumerate(found) if f)
    rank = {t: i for i, (_, _, t) in enumerate(order)}
    state = tuple(None if f is None else (f[0] - least, rank[t]) for t, f in enumerate(found))
    pointers = bytes(0 if f is None else f[3] << 3 | f[2] for f in found)
    return state, pointers, least, tuple(None if f is None else (f[3], _MOVES[f[2]]) for f in found)


class Trail:
    """Backpointers of one conversation, four bytes a row, read from the end; long ones lie in the shared folder."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit, self.held, self.files = folder, limit, bytearray(), []

    def add(self, pointers: bytes) -> None:
        self.held += pointers
        if len(self.held) >= self.limit:
            uri = f"{self.folder}/trail-{uuid.uuid4().hex}"
            files, path = filesystem(uri)
            files.create_dir(path.rpartition("/")[0], recursive=True)
            self.files.append((files, path))
            with files.open_output_stream(path) as out:
                out.write(bytes(self.held))
            self.held = bytearray()

    def backwards(self) -> Iterator[bytes]:
        yield bytes(self.held)
        for files, path in reversed(self.files):
            with files.open_input_stream(path) as source:
                yield source.read()

    def close(self) -> None:
        for files, path in self.files:
            files.delete_file(path)
        self.files = []


class Repair:
    """One conversation while its rows pass by."""

    def __init__(self, key: object, folder: str, limit: int, steps: dict):
        self.key, self.steps, self.trail = key, steps, Trail(folder, limit)
        self.best: Best = ((0, 0), None, None, None)
        self.digests = [hashlib.sha256(), None, None, None]
        self.cost = self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.initial: str | None = None
        self.first: int | None = None
        self.last: int | None = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        initial = role[:1]
        if self.rows and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial, self.rows = initial, self.rows + 1
        must_go = blank or duplicate
        kind = (self.best, initial if initial in ("s", "u", "a") else "", must_go, truncated)
        step = self.steps.get(kind)
        if step is None:
            step = self.steps[kind] = advance(*kind)
        self.best, pointers, least, origins = step
        self.cost += least
        self.trail.add(pointers)
        own = None if must_go else f"{role}:{text}".encode()
        behind = None if must_go else f":{text}".encode()
        digests: list = [None] * 4
        for target, origin in enumerate(origins):
            if origin is None:
                continue
            place, move = origin
            if move == "D":
                digests[target] = self.digests[place]  # nothing is added; digests are copied before they change
                continue
            digest = digests[target] = self.digests[place].copy()
            if place != START:
                digest.update(b"\n")
            if move[0] == "I":
                place = _NEXT[place]
                digest.update(f"{_ROLE[place]}:\n".encode())
            digest.update(own if move[-1] == "K" else _ROLE[_NEXT[place]].encode() + behind)
        self.digests = digests

    def report(self) -> tuple:
        ends = []
        for place, added in ((START, 0), (SYSTEM, 2), (USER, 1), (ASSISTANT, 0)):
            if self.best[place] is not None:
                ends.append((self.best[place][0] + INSERT * added, self.best[place][1], place, added))
        more, _, place, added = min(ends)
        digest, at = self.digests[place].copy(), place
        for _ in range(added):
            at = _NEXT[at]
            digest.update(f"\n{_ROLE[at]}:".encode())
        moves = ["I" * added]
        for piece in self.trail.backwards():
            for i in range(len(piece) - 4, -1, -4):
                pointer = piece[i + place]
                moves.append(_MOVES[pointer & 7])
                place = pointer >> 3
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + more,
                "".join(reversed(moves)), digest.hexdigest())


def _streamed(df: DataFrame, conversation: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    """Rows with their faults, each conversation in one partition and in order."""
    column = {n: F.col(f"`{c}`") for n, c in (("conv", conversation), ("turn", turn))}
    plain = {n: F.coalesce(F.col(f"`{c}`"), F.lit(" ")) for n, c in (("role", role), ("text", text))}
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = df.select(
        column["conv"].alias("conv"), F.when(here, column["turn"].cast("long")).alias("turn"), here.alias("present"),
        *(F.when(here, c).otherwise("").alias(n) for n, c in plain.items()))
    rows = rows.withColumn("print", F.sha2(F.concat_ws("\0", "role", "text"), 256)).repartition("conv")
    blank = F.col("present") & ~F.col("text").rlike(f"[^{SPACE}]")
    seen = F.row_number().over(W.partitionBy("conv", "present", "role", "print").orderBy("turn")) > 1
    duplicate = F.col("present") & ~blank & seen
    ended = F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    rows = rows.select(
        "conv", "turn", "role", "text", "present", blank.alias("blank"), duplicate.alias("duplicate"),
        (F.col("present") & ~blank & ~duplicate & ~ended).alias("truncated"))
    return rows.sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "duplicate")


def repair(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    present: Column | None = None, spill_bytes: int = SPILL_BYTES,
) -> DataFrame:
    """One row per conversation: ``c0`` (its id) and ``REPORT``: faults, the cheapest edits and the repaired text's digest.

    ``audit`` has the edits' initials in order, the ASCII-least of all cheapest; ``repaired_sha256`` is that of the
    remaining ``role:text`` rows joined by newlines.  Rows that are not ``present`` name a conversation without being
    part of it; a conversation of such rows only has zeros and empty edits.

    Null id: one conversation of its own.  Null role or text: one space, so such a text is blank.  Null turn: first.
    Equal turns: by role, then text.  Repeated rows: duplicates from the second on.  A role is known by its first
    letter; other roles can't be kept.  Empty table: no rows.  Long texts pass through in their batch.  Other
    columns are not read, and may have any name.
    """
    folder = work_path(df.sparkSession, "conversation-trails")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps: dict = {}
        now: Repair | None = None
        try:
            for frame in frames:
                done = []
                columns = [frame[c].tolist() for c in ("present", "turn", "role", "text", "blank", "duplicate", "truncated")]
                null = frame["conv"].isna().tolist()
                turnless = frame["turn"].isna().tolist()
                for key, no_key, no_turn, (here, number, *rest) in zip(frame["conv"].tolist(), null, turnless, zip(*columns, strict=True), strict=True):
                    key = None if no_key else key
                    if now is None or now.key != key:
                        if now is not None:
                            done.append(now.report())
                            now.trail.close()
                        now = Repair(key, folder, spill_bytes, steps)
                    if here:
                        now.add(None if no_turn else int(number), *rest)
                yield _reports(done)
            if now is not None:
                yield _reports([now.report()])
        finally:
            if now is not None:
                now.trail.close()

    rows = _streamed(df, conversation, turn, role, text, present)
    key_type = rows.schema["conv"].dataType.simpleString()
    # Ids and turns travel as text: pandas has no whole numbers beside nulls.
    streamed = rows.select(F.col("conv").cast("string").alias("conv"), F.col("turn").cast("string").alias("turn"), *rows.columns[2:])
    found = streamed.mapInPandas(run, f"conv string, {REPORT}")
    return found.select(F.col("conv").cast(key_type).alias("c0"), *found.columns[1:])


_COLUMNS = ("conv", *(f.split()[0] for f in REPORT.split(", ")))


def _reports(done: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(done, columns=_COLUMNS)


def repaired_rows(
    df: DataFrame, reports: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    present: Column | None = None,
) -> DataFrame:
    """The rows after the edits of ``reports`` (of ``repair`` with the same rows): ``c0``, ``place`` from 0, ``role``, ``text``, ``edit``.

    The audit is streamed ahead of its conversation's rows, so again nothing but the audit is held.
    """
    rows = _streamed(df, conversation, turn, role, text, present).where("present")
    key_type = rows.schema["conv"].dataType.simpleString()
    number = F.row_number().over(W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "duplicate"))
    body = rows.select(F.col("conv").cast("string").alias("conv"), number.cast("long").alias("place"), "role", "text")
    heads = reports.select(F.col("c0").cast("string").alias("conv"), F.lit(0).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = body.unionByName(heads).repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "place")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        audit, at, state, place = "", 0, START, 0
        for frame in frames:
            out = []
            for key, number, own_role, own_text in zip(*(frame[c].tolist() for c in ("conv", "place", "role", "text")), strict=True):
                if number == 0:
                    audit, at, state, place = own_text, 0, START, 0
                if number:
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        state = SYSTEM if edit == "K" and own_role[:1] == "s" else _NEXT[state]
                        out.append((key, place, own_role if edit == "K" else _ROLE[state], own_text, edit))
                        place += 1
                while at < len(audit) and audit[at] == "I":  # what stands before the next row, or at the end
                    state, at = _NEXT[state], at + 1
                    out.append((key, place, _ROLE[state], "", "I"))
                    place += 1
            yield pd.DataFrame(out, columns=("conv", "place", "role", "text", "edit"))

    found = both.mapInPandas(run, "conv string, place long, role string, text string, edit string")
    return found.select(F.col("conv").cast(key_type).alias("c0"), "place", "role", "text", "edit")
