"""Answers of a search source, saved as JSON page by page, as rows."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from quillspark.functions.text import json_unescape, text_of

PAGE, MOST, BODY_MOST = 10, 100, 150_000
_FIELDS = "title link snippet".split()
_ITEMS = "struct<items:array<struct<title:string,link:string,snippet:string>>>"


def hits_of_json(body: Column) -> Column:
    """array<struct<title, link, snippet>> of an answer; items without a title or a link are left out.

    A body that isn't JSON, or has no items as such, is read by its n-th title, link and snippet; those end at the first quote.
    """
    t = text_of(body)
    hit = lambda i: F.struct(i["title"].alias("title"), i["link"].alias("link"), F.coalesce(i["snippet"], F.lit("")).alias("snippet"))
    parsed = F.coalesce(F.from_json(t, _ITEMS)["items"], F.from_json(F.lit('{"items": []}'), _ITEMS)["items"])
    whole = F.transform(F.filter(parsed, lambda i: (i["title"] != "") & (i["link"] != "")), hit)
    each = [F.transform(F.regexp_extract_all(t, F.lit(rf'"{f}"\s*:\s*"([^"]*)"'), F.lit(1)), json_unescape) for f in _FIELDS]
    zipped = F.arrays_zip(*(a.alias(f) for a, f in zip(each, _FIELDS)))
    pairs = F.transform(F.filter(zipped, lambda z: z["title"].isNotNull() & z["link"].isNotNull() & (F.trim(z["title"]) != "") & (F.trim(z["link"]) != "")), hit)
    return F.when(F.size(whole) > 0, whole).otherwise(pairs)


def page_body(html: Column) -> Column:
    """What is kept of a fetched page."""
    return text_of(html).substr(1, BODY_MOST)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.most = options["path"], min(int(options.get("num", MOST)), MOST)

    def read(self, partition) -> Iterator[tuple]:
        """Pages in order; an empty one ends, a bad one ends too, but an error if it is the first."""
        n = 0
        for start in range(1, self.most + 1, PAGE):
            try:
                with open(os.path.join(self.folder, f"{start}.json"), encoding="utf-8") as f:
                    items = json.load(f).get("items") or []
            except (OSError, ValueError):
                if start == 1:
                    raise
                return
            if not items:
                return
            for i in items[:PAGE]:
                if i.get("title") and i.get("link") and n < self.most:
                    n += 1
                    yield n, i["title"], i["link"], i.get("snippet") or ""


class SavedHits(DataSource):
    """Format ``saved_hits``: a folder of ``1.json``, ``11.json``, ...; ``num`` rows at most, 100 in all.

    A source's answer is 100 rows at most, read in one partition, as each page's place depends on those before.
    """

    @classmethod
    def name(cls) -> str:
        return "saved_hits"

    def schema(self) -> str:
        return "pos int, title string, link string, snippet string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def saved_hits(spark: SparkSession, folder: str, num: int = MOST) -> DataFrame:
    spark.dataSource.register(SavedHits)
    return spark.read.format("saved_hits").option("num", num).load(folder)


def source_limit(pages: DataFrame, asked: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` pages for each request (query_id, query): by the request's words in the title, then by ``pos``.

    ``asked`` is a stated set of requests; a page without any of the words is no hit.  A partial top-k runs before the
    shuffle, so what is shuffled doesn't grow with the pages.
    """
    from pyspark.sql import Window

    words = F.filter(F.split(F.lower(F.trim("query")), r"\s+"), lambda w: w != "")
    found = F.size(F.filter(words, lambda w: F.contains(F.lower(F.col("title")), w)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("found").desc(), "pos"))
    hits = pages.join(F.broadcast(asked)).withColumn("found", found).filter("found > 0")
    return hits.withColumn("place", place).filter(F.col("place") <= most)


def env_name(key: str) -> str:
    """``search.apiKey`` to ``SEARCH_API_KEY``."""
    return re.sub(r"(?<=[^_])(?=[A-Z])", "_", key.replace(".", "_")).upper()
