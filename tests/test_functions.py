"""Single expressions on literal inputs."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.functions import dates, extract, requests, text
from quillspark.operators import dedup, ranking, state

DAY = datetime.date


def today():
    return F.lit("2026-01-15").cast("date")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("said,day", [
    ("今天", DAY(2026, 1, 15)), ("這週末", DAY(2026, 1, 17)), ("下週末", DAY(2026, 1, 24)), ("週四", DAY(2026, 1, 22)), ("下週一", DAY(2026, 1, 26)), ("2026/03/05", DAY(2026, 3, 5)),
    ("3月5日", DAY(2026, 3, 5)), ("114年10月2日", DAY(2025, 10, 2)), ("110年度市集", DAY(2021, 12, 31)), ("常設展", DAY(2026, 2, 14)), ("2024 聖誕市集", DAY(2024, 12, 31)), ("", None), (None, None),
    ("2026/02/30", DAY(2026, 2, 3)), ("今天 2026/03/05", DAY(2026, 1, 15)), ("發佈：2019/03/05 展出 2026/03/02", DAY(2019, 3, 5)), ("更新日期:2025/03/05 展出 2026/03/02", DAY(2026, 3, 2)),
    ("2031 回顧 2020-01-05", DAY(2031, 1, 1)), ("2026台北花伴野餐3月5日", DAY(2026, 3, 5)),
])
def test_date_cascade(spark, said, day):
    assert value(spark, dates.parse_date(F.lit(said).cast("string"), today())) == day


@pytest.mark.parametrize("said,start,end", [
    ("2026/03/05~03/07", DAY(2026, 3, 5), DAY(2026, 3, 5)), ("115年3月5日至115年3月9日", DAY(2026, 3, 5), DAY(2026, 3, 9)), ("2026-03-05", DAY(2026, 3, 5), None), ("2024-01-01", None, None), ("", None, None), ("1月2日", DAY(2026, 1, 2), None),
])
def test_smart_dates(spark, said, start, end):
    span = value(spark, dates.smart_dates(F.lit(said), today()))
    assert (span.start, span.end) == (start, end)
    assert value(spark, dates.smart_dates(F.lit("1月2日"), F.lit("2026-12-01").cast("date"))).start == DAY(2027, 1, 2)


def test_facts_of_prose(spark):
    info = value(spark, extract.event_info(F.lit("票價：NT$300 時間 14:30~16:00 台北市信義路五段"), today()))
    assert (info.price_min, info.price_max, info.start_time, info.end_time, info.address, info.city, info.completeness) == (300, 300, "14:30", "16:00", "台北市信義路", "台北", 40.0)
    assert value(spark, extract.organizer(F.lit("主辦單位：文化局"))) is None
    assert value(spark, extract.organizer(F.lit("主辦方：文化局"))) == "文化局"
    assert value(spark, extract.price(F.lit("免費入場")))["low"] == 0 and value(spark, extract.price(F.lit(None).cast("string")))["low"] is None


def test_request(spark):
    p = value(spark, requests.parse(F.lit("台北週末免費展覽"), today()))
    assert (p.city, p.event_type, p.range_start, p.range_end, p.wants_free, p.intents, p.primary_intent) == ("台北", "展覽", DAY(2026, 1, 17), DAY(2026, 1, 18), True, ["DATE", "PLACE", "TYPE", "FREE"], "DATE")
    assert p.expanded_query == "台北週末免費展覽 特展 假日 2026"
    assert value(spark, requests.refine(F.lit(p.expanded_query), today())) == "台北週末免費展覽 特展 假日 (2026 OR 2027)"
    assert value(spark, requests.suggest(F.lit("親子"), F.lit(None).cast("string")))[:2] == ["親子展覽", "兒童活動"]


@pytest.mark.parametrize("url,key", [("http://ththin.example.com/en/671?utm_source=feed", "ththin.example.com/en/671"), ("http://h.example.com/fr/825?page=2&ref=x", "h.example.com/fr/825?page=2"), ("https://www.A.com/x/#top", "a.com/x/"), (None, "")])
def test_url_key(spark, url, key):
    assert value(spark, text.url_key(F.lit(url).cast("string"))) == key


def test_similarity_and_hashes(spark):
    assert value(spark, text.title_similarity(F.lit("台北音樂節"), F.lit("台北音樂節 2025"))) == 0.85
    assert value(spark, text.title_similarity(F.lit("abcd"), F.lit("abce"))) == 0.5
    assert value(spark, text.fnv1a_units([F.lit(0x61), F.lit(0x4E00)])) == 599508748142588900
    df = spark.createDataFrame([(1, "台北 Music 活動"), (2, ""), (3, None), (4, "x")], "id long, t string")
    a = dict(dedup.simhash(df, "id", F.col("t")).collect())
    assert a == dict(df.select("id", dedup.simhash_of(F.col("t"))).collect()) and a[2] == a[3] == a[4] == 0


def test_tokens(spark):
    got = value(spark, text.tokens(F.lit("台北演唱會 Live in Taipei")))
    assert sorted(got) == sorted(["live", "taipei", "演唱會", "演唱會", "台北", "北演", "台北演", "北演唱"])
    assert value(spark, text.query_tokens(F.lit("聖誕市集 -x 展覽"))) == ["聖誕市集", "聖誕", "市集", "展覽"]


@pytest.mark.parametrize("base,href,want", [("http://a.b/c/d?x", "e", "http://a.b/c/e"), ("http://a.b/c/d", "../e", "http://a.b/e"), ("http://a.b", "e", "http://a.b/e"), ("https://a.b/c", "//x.y/z", "https://x.y/z"), ("http://a.b/c/d", "/e", "http://a.b/e"), ("http://a.b/c", "mailto:x", None), ("http://a.b/c?d", "?q=1", "http://a.b/c?q=1")])
def test_url_resolve(spark, base, href, want):
    assert value(spark, text.url_resolve(F.lit(base), F.lit(href))) == want


def test_small_expressions(spark):
    assert value(spark, text.query_params(F.lit("a=1&b=%E5%8F%B0&a=2&c"))) == {"a": "2", "b": "台"}
    assert value(spark, text.unsanitize(text.sanitize(F.lit(" <a href='x'>&\x01 ")))) == "<a href='x'>&"
    assert [value(spark, extract.valid_query(F.lit(q).cast("string"))) for q in (None, "a", "x" * 101, "<script>", "a;b", "台北展覽")] == ["missing", "short", "long", "markup", "sql", ""]
    assert [value(spark, extract.valid_page(F.lit(p))) for p in ("3", "0", "101", "x", "")] == [3, 1, 1, 1, 1]
    assert value(spark, text.nearest_city(F.lit(22.6), F.lit(120.3))) == "高雄"
    assert [value(spark, ranking.freshness(F.lit(r))) for r in (1, 5, 21, 30, 0)] == [10, 8, 0, 0, 20]


def test_normalise_ties_and_drops(spark):
    df = spark.createDataFrame([(1, 50.0), (1, 20.0), (1, 80.0), (1, 0.005), (2, 7.0), (2, 7.0)], "query_id long, score double")
    assert sorted(map(tuple, ranking.normalise(df).collect())) == [(1, 10.0), (1, 55.0), (1, 100.0), (2, 10.0), (2, 10.0)]
    pages = ranking.paginate(spark.range(23).select(F.lit(1).alias("query_id"), "id"), F.lit(3), order=(F.col("id"),)).collect()
    assert [(r["rank"], r.total_pages) for r in pages] == [(21, 3), (22, 3), (23, 3)]


def test_rate_limit(spark):
    rows = [("a", t, i) for i, t in enumerate((0, 10, 20, 60, 61))]
    df = spark.createDataFrame(rows, "k string, s long, i long").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.allowed for r in sorted(state.rate_limit(df, "k", "ts", "i", 2, 60).collect(), key=lambda r: r.ordinal)] == [True, True, False, False, True]
    assert state.rate_limit(df.limit(0), "k", "ts", "i").collect() == []


def test_greedy_leaders_and_best(spark):
    rows = [(1, 1, "abcd", 1.0), (1, 2, "abcd x", 5.0), (1, 3, "zzzz", 2.0), (1, 4, "zz", 9.0), (2, 1, "abcd", 1.0), (1, 5, "", 1.0), (1, 6, "", 2.0)]
    df = spark.createDataFrame(rows, "query_id long, pos long, title string, score double").withColumns({"content": F.lit(None).cast("string"), "city": F.lit(None).cast("string"), "event_date": F.lit(None).cast("date")})
    led = dedup.leaders(df, text.title_key(F.col("title")), "title")
    assert sorted((r.query_id, r.pos, r.leader) for r in led.collect()) == [(1, 1, 1), (1, 2, 1), (1, 3, 3), (1, 4, 3), (1, 5, 5), (1, 6, 6), (2, 1, 1)]
    assert sorted((r.query_id, r.pos, r.title) for r in dedup.best_of(led).collect()) == [(1, 1, "abcd x"), (1, 3, "zz"), (1, 5, ""), (1, 6, ""), (2, 1, "abcd")]
