"""Structured Streaming forms of the keyed rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limit_stream(log: DataFrame, key: str, ts: str, order: str, most: int = 30, window_s: int = 60, late: str = "1 minute") -> DataFrame:
    """(key, ordinal, allowed) as rows arrive; the state of an idle key times out with the watermark."""

    def keep(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        f = pd.concat(list(frames)).sort_values(["t", "o"])
        out = []
        for t in f["t"].tolist():
            if start is None or t - start > window_s * 1_000_000:
                start, n = t, 0
            n += 1
            out.append(n <= most)
        state.update((start, n))
        state.setTimeoutTimestamp(max(start // 1000 + window_s * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [k[0]] * len(out), "ordinal": f["o"].tolist(), "allowed": out})

    rows = log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).select(F.col(key).cast("string").alias("k"), F.unix_micros(ts).alias("t"), F.col(order).cast("long").alias("o"), F.col(ts))
    return rows.groupBy("k").applyInPandasWithState(keep, "key string, ordinal long, allowed boolean", "start long, n int", "append", GroupStateTimeout.EventTimeTimeout)


def session_stream(log: DataFrame, key: str, ts: str, ttl_s: int = 900, late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of sessions, each when the watermark has passed it."""
    window = F.session_window(ts, f"{ttl_s} seconds")
    found = log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(window.alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def activity_stream(log: DataFrame, word: str, ts: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, word, n) in tumbling windows."""
    found = log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("w.start").alias("start"), "word", "n")
