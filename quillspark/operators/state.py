"""Keyed, ordered rules over a request log: sessions, rate limits, caches, debounce, habits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def debounce(log: DataFrame, key: str, ts: str, order: str, quiet_ms: int) -> DataFrame:
    """Rows after which their key is quiet for over ``quiet_ms``; the last row of a key is one."""
    after = F.lead(_micros(ts)).over(Window.partitionBy(key).orderBy(ts, order))
    return log.filter(F.lit(True)).withColumn("__next", after).filter(F.col("__next").isNull() | (F.col("__next") - _micros(ts) > quiet_ms * 1000)).drop("__next")


def sessions(log: DataFrame, key: str, ts: str, order: str, ttl_s: int) -> DataFrame:
    """Adds session_no: it grows where the key was idle for over ``ttl_s``."""
    w = Window.partitionBy(key).orderBy(ts, order)
    gap = _micros(ts) - F.lag(_micros(ts)).over(w)
    fresh = F.when(gap.isNull() | (gap > ttl_s * 1_000_000), 1).otherwise(0)
    return log.withColumn("__fresh", fresh).withColumn("session_no", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def swept_sessions(log: DataFrame, key: str, ts: str, order: str, ttl_s: int) -> DataFrame:
    """As ``sessions``, but an idle session ends only if some other request swept it before its owner came back.

    The sweep looks at the latest request of anyone before this one: over the whole log that is an ordered scan of
    (ts, order), here done as a range-partitioned lag: the last row of each day is carried to the next.
    """
    day = F.to_date(ts)
    d = log.withColumn("__day", day)
    last = d.groupBy("__day").agg(F.max(_micros(ts)).alias("__last"))
    # one row a day: the latest request of any day before
    carried = last.select("__day", F.max("__last").over(Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    d = d.join(F.broadcast(carried), "__day", "left")
    anyone = F.coalesce(F.lag(_micros(ts)).over(Window.partitionBy("__day").orderBy(ts, order)), F.col("__before"))
    d = d.withColumn("__anyone", anyone)
    w = Window.partitionBy(key).orderBy(ts, order)
    own = F.lag(_micros(ts)).over(w)
    fresh = F.when(own.isNull() | (F.col("__anyone") - own > ttl_s * 1_000_000), 1).otherwise(0)
    return d.withColumn("__fresh", fresh).withColumn("session_no", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh", "__anyone", "__before", "__day")


def _fold(keep, columns: str):
    """A streaming fold over rows sorted by key; only the current key's state is held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), None
        for f in frames:
            out = []
            for k, t, *rest in zip(*(f[c] for c in columns.split())):
                if k != key:
                    key, state = k, None
                state, value = keep(state, t, *rest)
                out.append(value)
            yield f.assign(verdict=out)

    return run


def rate_limit(log: DataFrame, key: str, ts: str, order: str, most: int = 30, window_s: int = 60) -> DataFrame:
    """(key, order, allowed): a window opens at a request and lasts while now - start <= window; ``most`` pass in it."""

    def keep(state, t):
        start, n = state if state and t - state[0] <= window_s * 1_000_000 else (t, 0)
        return (start, n + 1), n + 1 <= most

    rows = log.select(F.col(key).cast("string").alias("k"), _micros(ts).alias("t"), F.col(order).cast("long").alias("o"))
    rows = rows.filter("t IS NOT NULL AND k IS NOT NULL").repartition("k").sortWithinPartitions("k", "t", "o")
    out = rows.mapInPandas(_fold(keep, "k t"), "k string, t long, o long, verdict boolean")
    return out.select(F.col("k").alias("key"), F.col("o").alias("ordinal"), F.col("verdict").alias("allowed"))


def cache_hits(log: DataFrame, key: str, ts: str, order: str, ttl_s: int = 300) -> DataFrame:
    """(key, order, hit) for a cache whose entries expire ``ttl_s`` after they were written; a miss writes."""

    def keep(state, t):
        hit = state is not None and t - state <= ttl_s * 1_000_000
        return (state if hit else t), hit

    rows = log.select(F.col(key).cast("string").alias("k"), _micros(ts).alias("t"), F.col(order).cast("long").alias("o"))
    rows = rows.filter("t IS NOT NULL AND k IS NOT NULL").repartition("k").sortWithinPartitions("k", "t", "o")
    out = rows.mapInPandas(_fold(keep, "k t"), "k string, t long, o long, verdict boolean")
    return out.select(F.col("k").alias("key"), F.col("o").alias("ordinal"), F.col("verdict").alias("hit"))


def keyed_cache(log: DataFrame, cache: str, key: str, ts: str, order: str, capacity: int = 100, ttl_s: int = 300, recent: bool = True) -> DataFrame:
    """(cache, ordinal, hit) of a cache of ``capacity`` keys whose entries expire ``ttl_s`` after they were written.

    A miss writes its key; over capacity, the key goes that was used (``recent``) or written longest ago.  Accesses of a
    cache are in the order of (ts, order); null keys and times are passed over.  A cache's state, ``capacity`` keys, is
    all that its task holds; the rule is a fold over the accesses of one cache.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner: object = object()
        entries: dict[str, int] = {}
        for f in frames:
            hits = []
            for c, k, t in zip(f["cache"], f["k"], f["t"]):
                if c != owner:
                    owner, entries = c, {}
                written = entries.get(k)
                if written is not None and t - written > ttl_s * 1_000_000:
                    del entries[k]
                    written = None
                hits.append(written is not None)
                if written is None:
                    entries[k] = t
                    if len(entries) > capacity:
                        del entries[next(iter(entries))]
                elif recent:
                    entries[k] = entries.pop(k)
            yield pd.DataFrame({"cache": f["cache"], "ordinal": f["o"], "hit": hits})

    rows = log.select(F.col(cache).cast("string").alias("cache"), F.col(key).cast("string").alias("k"), _micros(ts).alias("t"), F.col(order).cast("long").alias("o"))
    rows = rows.filter("k IS NOT NULL AND t IS NOT NULL AND cache IS NOT NULL").repartition("cache").sortWithinPartitions("cache", "t", "o")
    return rows.mapInPandas(run, "cache string, ordinal long, hit boolean")


def unexpired(entries: DataFrame, written: str, now: Column, ttl_s: int = 300) -> DataFrame:
    """Entries that a sweep at ``now`` leaves."""
    return entries.filter(F.unix_micros(now) - _micros(written) <= ttl_s * 1_000_000)


def hit_rate(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("hit_rate"))


def habits(log: DataFrame, user: str, word: str) -> DataFrame:
    """(user, word, n, boost, weight): 0.05 a use, 2.0 at most by user; weight grows by a tenth of up to ten uses."""
    n = log.groupBy(F.col(user).alias("user"), F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    total = F.least(F.lit(2.0), F.sum(F.col("n") * 0.05).over(Window.partitionBy("user")))
    return n.withColumn("boost", total).withColumn("weight", 1.0 + 0.1 * F.least("n", F.lit(10)))


def recent(log: DataFrame, user: str, word: str, ts: str, most: int = 10) -> DataFrame:
    """(user, word, place): distinct words of a user by last use, the newest first."""
    last = log.groupBy(F.col(user).alias("user"), F.col(word).alias("word")).agg(F.max(ts).alias("last"))
    place = F.row_number().over(Window.partitionBy("user").orderBy(F.col("last").desc(), "word"))
    return last.withColumn("place", place).filter(F.col("place") <= most)


def toggled(log: DataFrame, user: str, item: str) -> DataFrame:
    """(user, item) that were toggled an odd number of times."""
    return log.groupBy(F.col(user).alias("user"), F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").select("user", "item")


def modal(log: DataFrame, user: str, word: str) -> DataFrame:
    """(user, word, n): the most frequent word, the least of equals."""
    n = log.filter(F.col(word).isNotNull()).groupBy(F.col(user).alias("user"), F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("user").agg(F.min(F.struct((-F.col("n")).alias("m"), "word")).alias("b"))
    return best.select("user", "b.word", (-F.col("b.m")).alias("n"))
