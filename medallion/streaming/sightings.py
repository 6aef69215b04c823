"""Stateful insert/update inference: one remembered timestamp per key, with a lifetime (CDC-6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import FIRST_SIGHT_TTL_DAYS


#: Groups of keys.  A group's state is read and written as one, so a call of Python and a state serve many keys.
KEY_GROUPS = 4_096


def _first_sight(name: str, order: str, row_id: str, ttl_days: float, expire: bool):
    ttl = int(ttl_days * 86_400_000_000)

    def end_of(anchor: int) -> int:
        """The memory's end, in event time: a later row is an insert with or without it."""
        return (anchor + ttl) // 1000 + 1

    def keep(state: GroupState, memory: dict, changed: bool) -> None:
        if expire:
            alive = {k: a for k, a in memory.items() if end_of(a) > state.getCurrentWatermarkMs()}
            changed, memory = changed or len(alive) < len(memory), alive
            if not memory:
                if state.exists:
                    state.remove()
                return
        if changed:
            state.update((list(memory), list(memory.values())))
        if expire:
            state.setTimeoutTimestamp(max(min(map(end_of, memory.values())), state.getCurrentWatermarkMs() + 1))

    def infer(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = dict(zip(*state.get, strict=True)) if state.exists else {}
        if state.hasTimedOut:
            keep(state, memory, False)
            return
        pieces = [(p[name].to_numpy(object), p[order].to_numpy("datetime64[us]").astype("int64"), p[row_id].to_numpy()) for p in parts]
        names, times, ids = (np.concatenate(column) for column in zip(*pieces, strict=True))
        codes, keys = pd.factorize(names, use_na_sentinel=False)
        places = np.lexsort((ids, times, codes))
        ordered = times[places]
        begins = np.searchsorted(codes[places], np.arange(len(keys) + 1))
        operations = np.full(len(times), "update", dtype=object)
        changed = False
        for i, key in enumerate(keys):
            key = None if pd.isna(key) else key
            at, stop = int(begins[i]), int(begins[i + 1])
            before = anchor = memory.get(key)
            # From each sighting that begins a memory to the first one after its end.
            if anchor is not None:
                at += int(np.searchsorted(ordered[at:stop], anchor + ttl, "right"))
            while at < stop:
                anchor = int(ordered[at])
                operations[places[at]] = "insert"
                at += int(np.searchsorted(ordered[at:stop], anchor + ttl, "right"))
            if anchor != before:
                memory[key], changed = anchor, True
        keep(state, memory, changed)
        yield pd.DataFrame({name: names, row_id: ids, "change_operation": operations})

    return infer


def infer_operations_stream(
    rows: DataFrame,
    key: str,
    order: str,
    row_id: str,
    ttl_days: float = FIRST_SIGHT_TTL_DAYS,
    watermark: str | None = None,
    groups: int = KEY_GROUPS,
) -> DataFrame:
    """Streaming ``(key, row_id, change_operation)``.

    With a ``watermark`` (how late rows may come) the state of a key goes when event time has passed its
    lifetime, so the state holds the keys of one lifetime only; a stream that lags loses nothing.

    Keys are dealt to ``groups`` by their hash, and a group's state is a number per key, so what a micro-batch costs beyond
    its rows grows with the groups it meets and not with its keys.  ``groups`` holds for the life of a checkpoint.  Only key,
    time and id of the rows go to Python, and a micro-batch holds at most what the source admits per trigger, so the
    rows of a hot key are bounded by that limit.
    """
    types = dict(rows.dtypes)
    if watermark:
        rows = rows.withWatermark(order, watermark)
    plain = types[key] == "string"
    name = F.col(key) if plain else F.to_json(F.struct(F.col(key).alias("k")))
    found = (
        rows.select(F.pmod(F.xxhash64(key), F.lit(groups)).alias("_group"), name.alias("_name"), order, row_id)
        .groupBy("_group")
        .applyInPandasWithState(
            _first_sight("_name", order, row_id, ttl_days, watermark is not None),
            outputStructType=f"_name string, `{row_id}` {types[row_id]}, change_operation string",
            stateStructType="names array<string>, micros array<long>",
            outputMode="append",
            timeoutConf=GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout,
        )
    )
    own = F.col("_name") if plain else F.from_json("_name", f"k {types[key]}")["k"]
    return found.select(own.alias(key), row_id, "change_operation")
