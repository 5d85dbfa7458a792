"""A registry of queries: the Spark form and its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TODAY = "2024-01-15"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row: a generator, which the optimizer doesn't inline into their uses."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def words(items) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in items) + "]"


def first_hit(expr: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN contains({expr}, '{k}') THEN '{v}'" for k, v in pairs) + " END"


def anyof(expr: str, items) -> str:
    return f"len(list_filter({words(items)}, lambda w: contains({expr}, w))) > 0"


_CITIES = "台北 高雄 台中 台南市 新北 taipei 宜蘭 東京和大阪".split()
_KINDS = "演唱會 展覽 市集 音樂節 講座 親子活動 路跑 補助申請辦法 碩士論文 特展與音樂會 2019年展覽".split()


def _pick(index: str, items: list[str]) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(items)) + " ELSE '' END"


#: Event listings made of orders and customers; reads the same in both engines.
LISTING = f"""
SELECT listing_id, city_txt, type_txt, date_txt, city_txt || type_txt || ' ' || date_txt AS title, body_txt, score, day FROM (
  SELECT o_orderkey AS listing_id, {_pick("c_nationkey % 10", _CITIES)} AS city_txt, {_pick("CAST(o_orderkey % 13 AS INT)", _KINDS)} AS type_txt, day, o_totalprice / 1000 AS score,
    CASE CAST(o_orderkey % 17 AS INT)
      WHEN 0 THEN y || '/' || lpad(m, 2, '0') || '/' || lpad(d, 2, '0')
      WHEN 1 THEN y || '年' || m || '月' || d || '日'
      WHEN 2 THEN CAST(year(day) - 1911 AS STRING) || '年' || m || '月' || d || '日'
      WHEN 3 THEN m || '月' || d || '日'
      WHEN 4 THEN y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') || ' ~ ' || y || '-12-' || lpad(d, 2, '0')
      WHEN 5 THEN CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN '今天' WHEN 1 THEN '下週三' WHEN 2 THEN '這週末' WHEN 3 THEN '星期日' ELSE '常設展' END
      WHEN 7 THEN '發佈：2019/03/05 展出 ' || y || '/' || lpad(m, 2, '0') || '/' || lpad(d, 2, '0')
      WHEN 8 THEN y || '台北花伴野餐' || m || '月' || d || '日'
      WHEN 9 THEN CASE CAST(o_orderkey % 2 AS INT) WHEN 0 THEN '110年度市集' ELSE '113年活動' END
      WHEN 10 THEN y || '/' || lpad(m, 2, '0') || '/' || lpad(d, 2, '0') || '~' || m || '/' || d
      WHEN 11 THEN '2031 回顧 2020-01-05'
      WHEN 12 THEN '2021 聖誕市集'
      WHEN 13 THEN CAST(year(day) - 1911 AS STRING) || '年' || m || '月' || d || '日~12月' || d || '日'
      WHEN 14 THEN '更新日期:2023-05-06 ' || y || '.' || m || '.' || d
      WHEN 15 THEN y || '.' || m || '.' || d || ' 至 ' || y || '.12.31'
      ELSE '' END AS date_txt,
    CASE WHEN o_orderpriority LIKE '1%' THEN '免費入場 台北市信義路五段' WHEN o_orderpriority LIKE '2%' THEN '票價：NT$' || substr(p, 1, 4) || ' 華山1914 14:30~16:00'
      WHEN o_orderpriority LIKE '3%' THEN substr(p, 1, 4) || '元 主辦方：文化基金會' WHEN o_orderpriority LIKE '4%' THEN 'NT$100~NT$' || substr(p, 1, 3) || ' 駁二 9:05' ELSE '25:00 主辦：市政府。' END AS body_txt
  FROM (
    SELECT o_orderkey, o_orderpriority, o_totalprice, c_nationkey, day, CAST(year(day) AS STRING) AS y, CAST(month(day) AS STRING) AS m, CAST(day(day) AS STRING) AS d, CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS p
    FROM (SELECT o.*, c_nationkey, CAST(o_orderdate + INTERVAL '25' YEAR AS DATE) AS day FROM {{orders}} o JOIN {{customer}} c ON o_custkey = c_custkey) AS dated
  ) AS parts
) AS listing
"""
LISTED = "WITH listing AS (" + LISTING.replace("{orders}", "orders").replace("{customer}", "customer") + ")\n"


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LISTING, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))
