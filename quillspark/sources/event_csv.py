"""CSV files of events with a header: as found, and as ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOUND = "title string, city string, date string, url string, domain string, tokens string"
RANKED = "score string, title string, city string, date string, domain string, url string"


def found_events(spark: SparkSession, path: str) -> DataFrame:
    """title, city, date (null where it is none), url, domain, tokens as an array."""
    rows = spark.read.option("header", True).schema(FOUND).csv(path)
    return rows.withColumn("date", F.try_to_date("date", "yyyy-MM-dd")).withColumn("tokens", F.split(F.coalesce("tokens", F.lit("")), " "))


def ranked_events(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).schema(RANKED).csv(path)
    return rows.withColumn("score", F.expr("try_cast(score AS double)")).withColumn("date", F.try_to_date("date", "yyyy-MM-dd"))
