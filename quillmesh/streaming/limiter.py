"""A request limiter whose window begins at the first request and ends a fixed time after it.

In batch it runs as one grouped pass in time order; in a stream the same step keeps (window start, count)
as state for each identity, with applyInPandasWithState.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admit(seconds: np.ndarray, start: float | None, used: int, most: int, length: float) -> tuple[list[bool], float | None, int]:
    """Whether each request, in time order, is let through; and the window left behind."""
    out = []
    for t in seconds:
        if start is None or t > start + length:
            start, used = float(t), 0
        used += 1
        out.append(used <= most)
    return out, start, used


def limited(df: DataFrame, who: str, at: str, order: str, most: int = 180, seconds: float = 60) -> DataFrame:
    """(who, order, allowed) of a table: sorted partitions stream past, so a busy identity is never held as a whole."""
    schema = f"{who} {df.schema[who].dataType.simpleString()}, {order} {df.schema[order].dataType.simpleString()}, allowed boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: tuple = (None, None, 0)
        for b in batches:
            keys, times, allowed = b["who"].to_numpy(), b["t"].to_numpy(), np.empty(len(b), bool)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(b) else []
            for s, e in zip(starts, [*starts[1:], len(b)]):
                start, used = (state[1], state[2]) if state[0] == keys[s] else (None, 0)
                allowed[s:e], start, used = admit(times[s:e], start, used, most, seconds)
                state = (keys[s], start, used)
            yield pd.DataFrame({who: keys, order: b["o"], "allowed": allowed})

    rows = df.where(F.col(who).isNotNull() & F.col(at).isNotNull()).select(F.col(who).alias("who"), F.unix_micros(F.col(at).cast("timestamp")).cast("double").alias("t"), F.col(order).alias("o"))
    rows = rows.withColumn("t", F.col("t") / 1e6).repartition("who").sortWithinPartitions("who", "t", "o")
    return rows.mapInPandas(run, schema)


def limited_stream(df: DataFrame, who: str, at: str, most: int = 180, seconds: float = 60) -> DataFrame:
    """(who, at, allowed) of a stream; the state of an identity is dropped one window and a minute after its last request."""
    kind = df.schema[who].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        for pdf in frames:
            pdf = pdf.sort_values(at)
            times = pdf[at].astype("int64").to_numpy() / (1e9 if str(pdf[at].dtype).endswith("[ns]") or "ns" in str(pdf[at].dtype) else 1e6)
            allowed, start, used = admit(times, start, used, most, seconds)
            yield pd.DataFrame({who: key[0], at: pdf[at], "allowed": allowed})
        state.update((start, used))
        state.setTimeoutDuration(int(1000 * seconds) + 60_000)

    return df.select(who, at).groupBy(who).applyInPandasWithState(step, f"{who} {kind}, {at} timestamp, allowed boolean", "start double, used long", "append", GroupStateTimeout.ProcessingTimeTimeout)
