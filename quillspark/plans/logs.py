"""Queries over the request log, places and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import dicts, text
from quillspark.operators import state

from .catalog import query, table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) WHERE nx IS NULL OR epoch_us(nx) - epoch_us(ts) > 3600000000")
def debounce(spark, sf_dir):
    return state.debounce(_events(spark, sf_dir), "user_id", "ts", "event_id", 3_600_000).select("event_id", "user_id")


@query("SELECT event_id, user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) ::BIGINT AS session_no FROM (SELECT *, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 7200000000, false) THEN 0 ELSE 1 END AS f FROM events)")
def session_ttl(spark, sf_dir):
    return state.sessions(_events(spark, sf_dir), "user_id", "ts", "event_id", 7200).select("event_id", "user_id", "session_no")


@query("""WITH e AS (SELECT *, lag(ts) OVER (ORDER BY ts, event_id) AS anyone, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS own FROM events)
SELECT event_id, user_id, sum(CASE WHEN own IS NULL OR epoch_us(anyone) - epoch_us(own) > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session_no FROM e""")
def session_swept(spark, sf_dir):
    return state.swept_sessions(_events(spark, sf_dir), "user_id", "ts", "event_id", 7200).select("event_id", "user_id", "session_no")


_FOLD = """
WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, t, k, {first} FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.event_id, o.t, o.k, {step} FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
"""


@query(_FOLD.format(first="t AS start, 1 AS n", step="CASE WHEN o.t - f.start > 36000000000 THEN o.t ELSE f.start END, CASE WHEN o.t - f.start > 36000000000 THEN 1 ELSE f.n + 1 END") + "SELECT user_id::STRING AS key, event_id AS ordinal, n <= 2 AS allowed FROM f")
def rate_limit_fold(spark, sf_dir):
    return state.rate_limit(_events(spark, sf_dir), "user_id", "ts", "event_id", most=2, window_s=36_000)


@query(_FOLD.format(first="t AS start, false AS hit", step="CASE WHEN o.t - f.start <= 36000000000 THEN f.start ELSE o.t END, o.t - f.start <= 36000000000") + "SELECT user_id::STRING AS key, event_id AS ordinal, hit FROM f")
def cache_ttl(spark, sf_dir):
    return state.cache_hits(_events(spark, sf_dir), "user_id", "ts", "event_id", ttl_s=36_000)


@query(_FOLD.format(first="t AS start, false AS hit", step="CASE WHEN o.t - f.start <= 36000000000 THEN f.start ELSE o.t END, o.t - f.start <= 36000000000") + "SELECT count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, avg(hit::INT) AS hit_rate FROM f")
def cache_hit_rate(spark, sf_dir):
    return state.hit_rate(cache_ttl(spark, sf_dir))


_STACK = """WITH o AS (SELECT {cache} AS cache, user_id AS k, event_id, row_number() OVER (PARTITION BY {cache} ORDER BY ts, event_id) AS i FROM events),
p AS (SELECT *, lag(i) OVER (PARTITION BY cache, k ORDER BY i) AS last FROM o),
d AS (SELECT p.cache, p.k, p.event_id, p.last, count(DISTINCT o.k) AS others FROM p LEFT JOIN o ON o.cache = p.cache AND o.i > p.last AND o.i < p.i GROUP BY ALL)
"""


@query(_STACK.format(cache="event_type") + "SELECT cache, event_id AS ordinal, last IS NOT NULL AND others < 60 AS hit FROM d")
def cache_lru(spark, sf_dir):
    """A cache of 60 users for each type of event; a key is there while fewer than 60 others were used since."""
    return state.keyed_cache(_events(spark, sf_dir), "event_type", "user_id", "ts", "event_id", capacity=60, ttl_s=10**9)


@query(_STACK.format(cache="0") + "SELECT least(count(DISTINCT k), 100)::INT AS size, 100 AS max_size, count(*) FILTER (WHERE last IS NOT NULL AND others < 100) AS hits, count(*) FILTER (WHERE last IS NULL OR others >= 100) AS misses, round(avg((last IS NOT NULL AND others < 100)::INT) * 100, 2) AS hit_rate, 1000000000 AS ttl_seconds FROM d")
def cache_stats(spark, sf_dir):
    from .responses import cache_report

    log = _events(spark, sf_dir).withColumn("cache", F.lit(0))
    hits = state.keyed_cache(log, "cache", "user_id", "ts", "event_id", ttl_s=10**9).join(log.select(F.col("event_id").alias("ordinal"), "user_id"), "ordinal")
    return cache_report(hits, F.col("user_id"), 100, 10**9)


@query("SELECT user_id, max(ts) AS written FROM events GROUP BY user_id HAVING TIMESTAMP '2024-01-30 12:00:00' - max(ts) <= INTERVAL 6 HOUR")
def cache_unexpired(spark, sf_dir):
    entries = _events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("written"))
    return state.unexpired(entries, "written", F.lit("2024-01-30 12:00:00").cast("timestamp"), 6 * 3600)


@query("WITH n AS (SELECT user_id AS user, event_type AS word, count(*) AS n FROM events GROUP BY ALL) SELECT *, round(least(2.0, sum(n * 0.05) OVER (PARTITION BY user))::DOUBLE, 6) AS boost, round((1 + 0.1 * least(n, 10))::DOUBLE, 6) AS weight FROM n")
def habit_boost(spark, sf_dir):
    h = state.habits(_events(spark, sf_dir), "user_id", "event_type")
    return h.select("user", "word", "n", F.round("boost", 6).alias("boost"), F.round("weight", 6).alias("weight"))


@query("WITH l AS (SELECT user_id AS user, props AS word, max(ts) AS t FROM events GROUP BY ALL) SELECT user, word, row_number() OVER (PARTITION BY user ORDER BY t DESC, word) AS place FROM l QUALIFY place <= 10")
def search_history(spark, sf_dir):
    return state.recent(_events(spark, sf_dir), "user_id", "props", "ts").select("user", "word", "place")


@query("SELECT user_id AS user, props AS item FROM events GROUP BY ALL HAVING count(*) % 2 = 1")
def favourites(spark, sf_dir):
    return state.toggled(_events(spark, sf_dir), "user_id", "props")


@query("WITH n AS (SELECT user_id AS user, event_type AS word, count(*) AS n FROM events GROUP BY ALL) SELECT user, word, n FROM n QUALIFY row_number() OVER (PARTITION BY user ORDER BY n DESC, word) = 1")
def modal_key(spark, sf_dir):
    return state.modal(_events(spark, sf_dir), "user_id", "event_type")


_SPOTS = ", ".join("('{}', {}, {}, {})".format(c, *p.split(";"), i) for i, (c, p) in enumerate(dicts.CITY_COORDS))
_WHERE = "21.0 + (c_custkey % 55) / 10.0 AS lat, 119.0 + (c_custkey % 35) / 10.0 AS lng"
_KM = "6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h))"
_H = "pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - c.lng) / 2), 2)"
_GEO = f"WITH spots(city, lat, lng, ord) AS (VALUES {_SPOTS}), c AS (SELECT c_custkey, {_WHERE} FROM customer), d AS (SELECT c_custkey, city, ord, {_KM} AS km FROM (SELECT c_custkey, s.city, s.ord, {_H} AS h FROM c, spots s))"


def _placed(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", (21.0 + (k % 55) / 10.0).alias("lat"), (119.0 + (k % 35) / 10.0).alias("lng"))


@query(f"{_GEO} SELECT c_custkey, arg_min(city, {{'k': km, 'o': ord}}) AS city FROM d GROUP BY c_custkey")
def geo_nearest(spark, sf_dir):
    return _placed(spark, sf_dir).select("c_custkey", text.nearest_city(F.col("lat"), F.col("lng")).alias("city"))


@query(f"{_GEO} SELECT c_custkey, round(km, 4) AS km, CASE WHEN km < 20 THEN 1.3 WHEN km < 50 THEN 1.15 WHEN km < 100 THEN 1.0 WHEN km < 200 THEN 0.85 ELSE 0.7 END::DOUBLE AS factor FROM d WHERE city = '台北'")
def geo_distance_band(spark, sf_dir):
    km = text.haversine_km(F.col("lat"), F.col("lng"), F.lit(25.0330), F.lit(121.5654))
    return _placed(spark, sf_dir).select("c_custkey", F.round(km, 4).alias("km"), text.distance_factor(km).alias("factor"))
