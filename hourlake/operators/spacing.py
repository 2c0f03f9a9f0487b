"""Minimum spacing between fired events (alert cooldown), exact and without one task per key.

Whether an event fires depends on the last *fired* one, so a plain window cannot
express it. A key's events are cut into time chunks. For each chunk the effect on
the state "time of the last fired event" is summarised as a short step function;
the summaries (one row per chunk) are chained per key; then every chunk is
replayed on its own with its incoming state.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESET, CANDIDATE, FORCED = 0, 1, 2
NONE = np.iinfo(np.int64).min  # state: nothing fired yet


def _replay(t: np.ndarray, kind: np.ndarray, state: int, gap: int) -> tuple[list[int], int]:
    """Positions that fire from an incoming state, and the outgoing state."""
    fired, i, n = [], 0, len(t)
    special = np.flatnonzero(kind != CANDIDATE)
    s = 0
    while i < n:
        stop = special[s] if s < len(special) else n
        while i < stop:  # only candidates in [i, stop): jump from fire to fire
            if state != NONE:
                i += int(np.searchsorted(t[i:stop], state + gap, "left"))
            if i >= stop:
                break
            fired.append(i)
            state = int(t[i])
            i += 1
        if stop < n:
            if kind[stop] == FORCED:
                fired.append(int(stop))
                state = int(t[stop])
            else:
                state = NONE
            s += 1
            i = int(stop) + 1
    return fired, state


def _summary(t: np.ndarray, kind: np.ndarray, start: int, gap: int):
    """(points, exits, after): incoming state s leaves as exits[first i with points[i] >= s + gap],
    else as `after` when a reset or forced event fixes it, else as s."""
    special = np.flatnonzero(kind != CANDIDATE)
    p = t[: special[0]] if len(special) else t
    fixed = _replay(t[special[0]:], kind[special[0]:], NONE, gap)[1] if len(special) else None
    # an incoming state lies before the chunk, so later entry points than this cannot matter
    last = int(np.searchsorted(p, start + gap, "left"))
    entries = p[: last + 1]
    if fixed is not None:
        exits = np.full(len(entries), fixed, dtype=np.int64)
    else:
        nxt = np.searchsorted(p, p + gap, "left")
        end = p.copy()
        for i in range(len(p) - 1, -1, -1):
            if nxt[i] < len(p):
                end[i] = end[nxt[i]]
        exits = end[: last + 1]
    if len(exits):  # keep the last entry of every run of equal exits
        keep = np.append(exits[1:] != exits[:-1], True)
        entries, exits = entries[keep], exits[keep]
    return entries, exits, fixed


def spaced(df: DataFrame, keys: list[str], ts: str, tie: str, kind: Column, seconds: float,
           strict: bool = False, chunk_seconds: float | None = None) -> DataFrame:
    """Rows that fire. `kind`: 0 clears the state, 1 fires when spaced, 2 always fires, NULL is ignored.

    Spaced means at least `seconds` after the last fired row (more than, when strict). NULL is
    a key value like any other. A row without a time cannot be too close to another: it fires
    (unless it is one that clears) and changes no state. Chunks last a day, or twice the
    spacing where that is longer.
    """
    chunk_seconds = max(86_400, 2 * seconds) if chunk_seconds is None else max(chunk_seconds, seconds)
    gap = int(round(seconds * 1e6)) + (1 if strict else 0)
    span = int(chunk_seconds * 1e6)
    work = df.withColumns({"_kind": kind.cast("int"), "_us": F.unix_micros(F.col(ts).cast("timestamp"))})
    work = work.withColumn("_key", F.to_json(F.struct(*keys))).where(F.col("_kind").isNotNull())
    untimed = work.where(F.col("_us").isNull() & (F.col("_kind") != RESET)).select(df.columns)
    work = work.where(F.col("_us").isNotNull())
    work = work.withColumn("_chunk", F.floor(F.col("_us") / F.lit(float(span))))
    out_cols = df.columns
    keys, key_ddl = ["_key"], "_key string"
    group = [*keys, "_chunk"]

    def together(d: DataFrame, by: list[str], order: list[str]) -> DataFrame:
        return d.repartition(*by).sortWithinPartitions(*by, *order)

    def summarise(batches):
        for pdf, cuts in _groups(batches, group):
            t, kind, chunk = pdf["_us"].to_numpy(), pdf["_kind"].to_numpy(), pdf["_chunk"].to_numpy()
            rows = [_summary(t[a:b], kind[a:b], int(chunk[a]) * span, gap) for a, b in cuts]
            out = pdf.iloc[[a for a, _ in cuts]][group]
            yield out.assign(
                p=[r[0].tolist() for r in rows],
                e=[r[1].tolist() for r in rows],
                after=pd.array([r[2] for r in rows], dtype="Int64"),
            )

    def chain(batches):
        for pdf, cuts in _groups(batches, keys):
            states = np.empty(len(pdf), dtype=np.int64)
            points, exits, after = pdf["p"].to_numpy(), pdf["e"].to_numpy(), pdf["after"].to_numpy()
            for a, b in cuts:
                state = NONE
                for i in range(a, b):
                    states[i] = state
                    j = 0 if state == NONE else int(np.searchsorted(points[i], state + gap, "left"))
                    if j < len(points[i]):
                        state = int(exits[i][j])
                    elif not pd.isna(after[i]):
                        state = int(after[i])
            yield pdf[group].assign(_state=states)

    def replay(batches):
        for pdf, cuts in _groups(batches, group):
            t, kind, state = pdf["_us"].to_numpy(), pdf["_kind"].to_numpy(), pdf["_state"].to_numpy()
            fired = [a + i for a, b in cuts for i in _replay(t[a:b], kind[a:b], int(state[a]), gap)[0]]
            if fired:
                yield pdf.iloc[fired][out_cols]

    small = work.select(*group, "_us", tie, "_kind")
    parts = together(small, group, ["_us", tie]).mapInPandas(
        summarise, f"{key_ddl}, _chunk bigint, p array<bigint>, e array<bigint>, after bigint"
    )
    states = together(parts, keys, ["_chunk"]).mapInPandas(chain, f"{key_ddl}, _chunk bigint, _state bigint")
    fired = together(work.join(states, group), group, ["_us", tie]).mapInPandas(replay, df.schema)
    return fired.unionByName(untimed)


def _groups(batches, by: list[str]):
    """Sorted batches -> (frame, [(start, end), ...]) holding whole groups only.

    A group cut by a batch border waits for its rest.
    """
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        new = np.zeros(len(pdf), dtype=bool)
        new[0] = True
        for c in by:
            v = pdf[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        last = int(starts[-1])
        rest = pdf.iloc[last:].reset_index(drop=True)
        if last:
            yield pdf.iloc[:last], list(zip(starts[:-1].tolist(), starts[1:].tolist()))
    if rest is not None and len(rest):
        yield rest, [(0, len(rest))]


def apply_cooldown(events: DataFrame, keys: list[str], ts: str, tie: str, status: str = "status",
                   seconds: float = 60.0, **kw) -> DataFrame:
    """Alerts that fire: spaced by the cooldown; a row without status (in range) clears it."""
    kind = F.when(F.col(status).isNotNull(), CANDIDATE).otherwise(RESET)
    return spaced(events, keys, ts, tie, kind, seconds, **kw)


def alert_on_change(events: DataFrame, keys: list[str], ts: str, tie: str, status: str = "status",
                    minutes: float = 5.0, **kw) -> DataFrame:
    """Alerts whose status differs from the last alert's, or more than `minutes` after it.

    In-range rows neither fire nor clear, so the last *alerting* row's status is
    the last alert's status: a change always fires.
    """
    from hourlake.operators.prefix import previous_value

    alerts = events.where(F.col(status).isNotNull())
    cols = events.columns
    with_prev = previous_value(alerts, keys, [ts, tie], ts, status, "_prev")
    kind = F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col(status)), FORCED).otherwise(CANDIDATE)
    return spaced(with_prev, keys, ts, tie, kind, minutes * 60.0, strict=True, **kw).select(cols)
