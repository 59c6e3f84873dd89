"""What a stream has reported before, remembered for a while."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Reported(StatefulProcessor):
    """Of each key the time of the last report, until a timer says that it is past."""

    def __init__(self, keep: int) -> None:
        self.keep = keep  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "micros long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        times = np.unique(np.concatenate([np.unique(r["micros"].to_numpy()) for r in rows]))
        at = int(np.searchsorted(times, self.last.get()[0] + self.keep)) if self.last.exists() else 0
        new = []
        while at < len(times):
            new.append(int(times[at]))
            at = int(np.searchsorted(times, new[-1] + self.keep))
        if new:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer((new[-1] + self.keep) // 1000 + 1)
            self.last.update((new[-1],))
            yield pd.DataFrame({"key": [key[0]] * len(new), "micros": new})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def unseen(hits: DataFrame, key: str, time: str, keep_seconds: int, delay: str) -> DataFrame:
    """A stream (key, time) of hits that are new: none of their key was reported in the ``keep_seconds`` before them.

    A key's state is one number, and it is dropped when the watermark, ``delay``
    behind the latest time, has passed its last report by ``keep_seconds``: state grows
    with the keys of that span, not with all that ever came. Which hits of a batch are
    new doesn't depend on their order. Hits that come later than the watermark, and
    those without a time, are left out, as by any watermark; a null key is a key. The
    distinct times of a key in one batch are held by a task, 8 bytes each, so bound the
    batches of a stream whose keys are few (``maxFilesPerTrigger``). The state store must
    be the RocksDB one, see ``watch``.
    """
    rows = hits.where(F.col(time).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(time).alias("time"), F.unix_micros(time).alias("micros"))
    new = rows.withWatermark("time", delay).groupBy("key").transformWithStateInPandas(_Reported(keep_seconds * 1_000_000), "key string, micros long", "Append", "EventTime")
    return new.select("key", F.timestamp_micros("micros").alias("time"))


def watch(hits: DataFrame, key: str, time: str, output: str, checkpoint: str, keep_seconds: int, delay: str) -> StreamingQuery:
    """Writes what is new in a stream of hits to ``output/batch=..`` and ends; a batch that runs again overwrites what it wrote."""
    spark = hits.sparkSession
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # a query keeps the settings that it was started with
    try:
        write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{output}/batch={batch}")
        return unseen(hits, key, time, keep_seconds, delay).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, old)
