"""Keywords that results share, and what they suggest to ask next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import dicts
from quillspark.functions.requests import related_words
from quillspark.functions.text import found_in, lookup, occurrences, text_of


def weight(word: Column) -> Column:
    """The weight of a known keyword, whatever its case; 1 for others."""
    return F.coalesce(lookup(F.lower(text_of(word)), dicts.PREDEFINED_WEIGHTS).cast("double"), F.lit(1.0))


def base_score(title: Column, content: Column, tokens: Column) -> Column:
    """Occurrences of each token by its weight, and 5 for each of those that the title holds."""
    t = F.lower(text_of(title))
    whole = F.concat(t, F.lit(" "), F.lower(text_of(content)))

    def points(w: Column) -> Column:
        n = occurrences(whole, F.lower(w))
        return F.when(n > 0, n * weight(w) + F.when(F.contains(t, F.lower(w)), 5.0).otherwise(0.0)).otherwise(0.0)

    return F.aggregate(F.transform(tokens, points), F.lit(0.0), lambda a, b: a + b)


def page_total(score: Column, sub_scores: Column) -> Column:
    """A page's score and three tenths of its sub-pages' scores."""
    return score + 0.3 * F.aggregate(F.coalesce(sub_scores, F.array().cast("array<double>")), F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))


def _top(counts: DataFrame, most: int, by: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col("n").desc(), "word"))
    return counts.withColumn("place", place).filter(F.col("place") <= most)


def derived(pages: DataFrame, text: Column, tokens: Column, by: str = "query_id", most: int = 3) -> DataFrame:
    """(by, word, n, place): words of events and places in two pages or more of a request that doesn't say them; ties by word."""
    words = F.filter(found_in(text, [*dicts.DERIVED_EVENT_WORDS, *dicts.DERIVED_PLACE_WORDS]), lambda w: ~F.array_contains(tokens, w))
    n = pages.select(by, F.explode(words).alias("word")).groupBy(by, "word").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return _top(n, most, by)


def related(pages: DataFrame, title: Column, tokens: Column, by: str = "query_id", most: int = 5) -> DataFrame:
    """(by, word, n, place): known and related words in titles, and the pages' tokens, by how often they occur; ties by word.

    A related word counts once for each group that lists it.
    """
    t = F.lower(text_of(title))
    listed = [(k, k) for k in dicts.RELATED_KEYWORDS] + [(w, w.lower()) for v in dicts.RELATED_KEYWORDS.values() for w in v]
    said = F.filter(F.array(*(F.when(F.contains(t, F.lit(key)), F.lit(w)) for w, key in listed)), lambda w: w.isNotNull())
    words = F.concat(said, F.coalesce(tokens, F.array().cast("array<string>")))
    n = pages.select(by, F.explode(words).alias("word")).groupBy(by, "word").agg(F.count(F.lit(1)).alias("n"))
    return _top(n, most, by)


def suggested(words: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, word): members of every group that holds one of the words, without those words."""
    more = words.select(by, F.explode(related_words(F.lower("word"))).alias("word")).distinct()
    return more.join(words.select(by, F.lower("word").alias("word")).distinct(), [by, "word"], "left_anti")


def expanded(queries: DataFrame, words: DataFrame, by: str = "query_id", query: str = "query", most: int = 3) -> DataFrame:
    """(by, expanded): the request and up to three suggestions that it doesn't hold, the least first."""
    new = words.join(queries.select(by, query), by).filter(~F.contains(F.lower(F.col(query)), F.lower("word")))
    few = new.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("word"))).filter(F.col("place") <= most)
    added = few.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("added"))
    return queries.join(added, by, "left").select(by, F.concat_ws(" ", query, "added").alias("expanded"))
