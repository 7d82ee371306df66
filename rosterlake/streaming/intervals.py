"""Periods and gaps of each entity kept in keyed state while intervals arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rosterlake.operators.interval_map import IntervalMap

OUT = "key string, span_kind string, span_start int, span_end int, version long"
STATE = "starts array<int>, ends array<int>, version long"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    starts, ends, version = state.get if state.exists else ([], [], 0)
    spans = IntervalMap(list(starts), list(ends))
    for pdf in batches:
        for s, e in zip(pdf["s"], pdf["e"]):
            if pd.notna(s) and pd.notna(e) and e > s:
                spans.insert(int(s), int(e))
    version += 1
    state.update((spans.starts, spans.ends, version))
    rows = [(key[0], "period", s, e, version) for s, e in spans.periods()]
    rows += [(key[0], "gap", s, e, version) for s, e in spans.gaps()]
    yield pd.DataFrame(rows, columns=["key", "span_kind", "span_start", "span_end", "version"])


def stream_periods(intervals: DataFrame) -> DataFrame:
    """(key, span_kind, span_start, span_end, version) of every key that got intervals (key, s, e) in a micro-batch.

    The state of a key is its map of disjoint intervals, bounded by the months there are, never its rows. The spans
    with the highest version of a key are its present ones. Late and repeated intervals change nothing but what they
    add, so no watermark is needed for a right result.
    """
    return intervals.groupBy("key").applyInPandasWithState(_update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
