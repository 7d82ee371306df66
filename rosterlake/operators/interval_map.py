"""Continuous periods and gaps of each entity from overlapping, nested or disjoint intervals.

An :class:`IntervalMap` is an ordered map of disjoint intervals with the gaps between them. Each insertion finds the
intervals it touches by binary search, merges them and changes the gaps beside them. The map of a key is its state:
Structured Streaming keeps it in the state store (:mod:`rosterlake.streaming.intervals`), and the batch form keeps it in
the task while the rows of the key, in any order, stream past. Before the shuffle every partition merges what it holds, so
a key reaches the shuffle reduced; keys with very many rows are merged once more under a salt, so that no task gets them all,
and no group is ever held.

Defined results: intervals with a null bound or an end not after the start are left out; an interval that starts where
the period so far ends continues it; repeated rows change nothing; a null key gives no row.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.session import cut


class IntervalMap:
    """Ordered disjoint intervals with ``starts[i] < ends[i] < starts[i + 1]``; gap i lies between intervals i and i + 1."""

    __slots__ = ("between", "ends", "starts")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None) -> None:
        self.starts, self.ends = starts or [], ends or []
        self.between = list(zip(self.ends, self.starts[1:]))

    def insert(self, start: int, end: int) -> None:
        """Add one interval, merging every stored interval that overlaps or touches it, and change the gaps beside it."""
        starts, ends = self.starts, self.ends
        lo = bisect_left(ends, start)
        hi = bisect_right(starts, end)
        if hi - lo == 1 and starts[lo] <= start and end <= ends[lo]:
            return
        if lo < hi:
            start, end = min(start, starts[lo]), max(end, ends[hi - 1])
        left = [(ends[lo - 1], start)] if lo else []
        right = [(end, starts[hi])] if hi < len(starts) else []
        self.between[max(lo - 1, 0) : hi] = left + right
        starts[lo:hi], ends[lo:hi] = [start], [end]

    def periods(self) -> Iterator[tuple[int, int]]:
        return zip(self.starts, self.ends)

    def gaps(self) -> Iterator[tuple[int, int]]:
        return iter(self.between)


HOT, SALTS, HELD = 1_000, 64, 100_000


def _merge_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge what a partition holds, at most ``HELD`` rows at a time; keys of more than ``HOT`` rows get a salt."""
    maps: dict[str, list] = {}
    held = turn = 0

    def flush() -> pd.DataFrame:
        rows = [(k, s, e, 1 + hash((turn, s)) % SALTS if n > HOT else 0) for k, (m, n) in maps.items() for s, e in m.periods()]
        return pd.DataFrame(rows, columns=["_key", "_s", "_e", "_salt"])

    for pdf in batches:
        for key, s, e in zip(pdf["_key"].tolist(), pdf["_s"].tolist(), pdf["_e"].tolist()):
            state = maps.get(key)
            if state is None:
                state = maps[key] = [IntervalMap(), 0]
            state[0].insert(s, e)
            state[1] += 1
        held += len(pdf)
        if held >= HELD:
            yield flush()
            maps, held, turn = {}, 0, turn + 1
    if maps:
        yield flush()


def _merge_salted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge the salted parts of hot keys, of which a task holds few."""
    maps: dict[tuple, IntervalMap] = {}
    for pdf in batches:
        for key, salt, s, e in zip(pdf["_key"], pdf["_salt"], pdf["_s"], pdf["_e"]):
            maps.setdefault((key, salt), IntervalMap()).insert(s, e)
    yield pd.DataFrame([(k, s, e) for (k, _), m in maps.items() for s, e in m.periods()], columns=["_key", "_s", "_e"])


def _stream_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Periods and gaps of rows that stand together by key, in any order; only the state of the current key is held."""
    key, state = None, IntervalMap()

    def emit() -> list[tuple]:
        rows = [(key, "period", s, e) for s, e in state.periods()]
        return rows + [(key, "gap", s, e) for s, e in state.gaps()]

    for pdf in batches:
        out: list[tuple] = []
        for k, s, e in zip(pdf["_key"].tolist(), pdf["_s"].tolist(), pdf["_e"].tolist()):
            if k != key:
                out += emit()
                key, state = k, IntervalMap()
            state.insert(s, e)
        yield pd.DataFrame(out, columns=["_key", "span_kind", "_s", "_e"])
    yield pd.DataFrame(emit(), columns=["_key", "span_kind", "_s", "_e"])


def periods_and_gaps(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, span_kind, start, end): every continuous period and every gap between two periods of one key."""
    rows = df.select(F.col(key).cast("string").alias("_key"), F.col(start).cast("int").alias("_s"), F.col(end).cast("int").alias("_e"))
    rows = rows.filter("_key is not null and _s is not null and _e is not null and _e > _s")
    merged = cut(rows.mapInPandas(_merge_partition, "_key string, _s int, _e int, _salt int"))
    hot = merged.filter("_salt > 0").repartition("_key", "_salt").mapInPandas(_merge_salted, "_key string, _s int, _e int")
    spans = (
        merged.filter("_salt = 0").drop("_salt").unionByName(hot)
        .repartition("_key")
        .sortWithinPartitions("_key")
        .mapInPandas(_stream_keys, "_key string, span_kind string, _s int, _e int")
    )
    return spans.select(F.col("_key").alias(key), "span_kind", F.col("_s").alias(start), F.col("_e").alias(end))
