"""A fixed-window rate limiter per key, its window anchored at the key's first arrival.

``window()`` and ``session_window()`` both anchor elsewhere, so the state of a key is kept by
hand: how many arrivals the window has, and when it ends. As a stream it runs on keyed state with
a timeout; as a batch the sorted arrivals of a partition stream by, one key's state at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinweft.session import plain, tasks

SCHEMA = "key string, at timestamp, allowed boolean, retry_after int"


def step(state: tuple[int, int] | None, at: int, limit: int, window_us: int) -> tuple[tuple[int, int], bool, int]:
    """(state, allowed, seconds to wait) after an arrival at a time in microseconds; state is (count, end)."""
    if state is None or at >= state[1]:
        state = (0, at + window_us)
    count, end = state
    if count >= limit:
        return state, False, math.ceil((end - at) / 1e6)
    return (count + 1, end), True, 0


def rate_limit(arrivals: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """(key, at, order, allowed, retry_after) for arrivals (key, at, order), which ties are broken by.

    Arrivals without a key or time are left out. A key with a third of all rows is sorted on disk
    and streams through one task; its state is two numbers.
    """
    window = window_seconds * 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for b in batches:
            ok, wait = [], []
            for k, t in zip(b["key"], b["us"]):
                if k != key:
                    key, state = k, None
                state, allowed, seconds = step(state, t, limit, window)
                ok.append(allowed)
                wait.append(seconds)
            yield plain(b.drop(columns="us").assign(allowed=ok, retry_after=wait))

    rows = arrivals.select(F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at"), F.col("order").cast("bigint").alias("order"), F.unix_micros(F.col("at").cast("timestamp")).alias("us")).where("key is not null and at is not null")
    return rows.repartition(tasks(arrivals.sparkSession), "key").sortWithinPartitions("key", "at", "order").mapInPandas(run, "key string, at timestamp, order bigint, allowed boolean, retry_after int")


def rate_limit_stream(arrivals: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """The same of a stream of (key, at); state goes when its window has ended.

    The reference shares one overflow state between keys beyond a number of keys. State is
    partitioned by key here, so every key has its own; expired ones are dropped by timeout.
    """
    window = window_seconds * 1_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else None
        rows = pd.concat(batches).sort_values("at")
        ok, wait = [], []
        for t in rows["at"]:
            now, allowed, seconds = step(now, t.value // 1000, limit, window)
            ok.append(allowed)
            wait.append(seconds)
        state.update(now)
        state.setTimeoutDuration(window_seconds * 1000)
        yield plain(pd.DataFrame({"key": key[0], "at": rows["at"].values, "allowed": ok, "retry_after": pd.array(wait, dtype="Int32")}))

    rows = arrivals.select(F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at")).where("key is not null and at is not null")
    return rows.groupBy("key").applyInPandasWithState(run, SCHEMA, "count bigint, end bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)
