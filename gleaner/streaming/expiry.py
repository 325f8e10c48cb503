"""Keys seen within a time to live, as keyed state of a stream: a key's row passes if the key was not seen, and again once what was kept of it has expired."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STORE = "spark.sql.streaming.stateStore.providerClass"


def _seen_once(time: str, ttl: int) -> Callable:
    """Keeps for each key the time of the row that passed last, until the time to live (microseconds) is over. State comes and goes with a batch's rows, so a key costs no calls of its own."""
    def rows_of(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        was = last = state.get[0] if state.exists else None
        parts = list(frames)
        batch = parts[0] if len(parts) == 1 else pd.concat(parts)
        times = batch[time].to_numpy().astype("datetime64[us]")
        order = np.argsort(times, kind="stable")
        times = times[order].astype("int64")
        passed, k = [], 0
        while k < len(times):
            if last is None or times[k] - last > ttl:
                passed.append(k)
                last = int(times[k])
            k = max(k + 1, int(times.searchsorted(last + ttl, side="right")))  # the rows up to there are repeats
        if last != was:
            state.update((last,))
        if last is not None:  # a row at the very end of the time to live is still a repeat
            state.setTimeoutTimestamp(max((last + ttl) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if passed:
            yield batch.iloc[order[passed]]

    return rows_of


def first_within(events: DataFrame, key: str, time: str, ttl_days: float, late: str = "1 hour") -> DataFrame:
    """Rows of a stream whose key did not pass in the `ttl_days` before; rows later than `late` behind the newest are left out."""
    rows_of = _seen_once(time, int(ttl_days * 86_400_000) * 1000)
    return events.withWatermark(time, late).groupBy(key).applyInPandasWithState(rows_of, events.schema, "micros long", "append", GroupStateTimeout.EventTimeTimeout)


def run(spark: SparkSession, make: Callable[[], DataFrame], at: str) -> DataFrame:
    """Process all that is there with keyed state in files under `at`, from where an earlier run left off; returns all that was written so far."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = make().writeStream.outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).format("parquet").option("path", f"{at}/out").start()
        q.awaitTermination()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
    return spark.read.parquet(f"{at}/out")


def fresh_target(base: str) -> str:
    return f"{base}/expiry-{uuid.uuid4().hex}"
