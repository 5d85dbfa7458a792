"""Scores and multipliers of candidate pages, and their normalised ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import dicts
from quillspark.functions.extract import application, likely_foreign, noise, proper_noun
from quillspark.functions.requests import in_range
from quillspark.functions.text import contains_any, first_hit, text_of, trimmed

_OLD_YEAR = "(201[0-9]|202[0-3])年?(?:全台|精選|最新|整理|市集|展覽|演唱會|音樂節)"


def _count(array: Column, test) -> Column:
    return F.size(F.filter(array, test))


def text_score(title: Column, content: Column, query: Column, tokens: Column) -> Column:
    """Whole request, share of tokens in the title, tokens only in the content, known names, foreign places."""
    t, c = F.lower(text_of(title)), F.lower(text_of(content))
    q = F.lower(trimmed(text_of(query)))
    in_title = lambda w: F.contains(t, F.lower(w))
    in_content = lambda w: ~in_title(w) & F.contains(c, F.lower(w))
    n, head, body = F.size(tokens), _count(tokens, in_title), _count(tokens, in_content)
    whole = F.when(q == "", 0.0).when(F.contains(t, q), 40.0).when(F.contains(c, q), 15.0).otherwise(0.0)
    part = F.when(n == 0, 0.0).when(head / n >= 0.5, 25.0).when(head > 0, 12.0).otherwise(0.0)
    rest = F.when(n == 0, 0.0).when((head == 0) & (body == 0), -20.0).otherwise(5.0 * F.least(body, F.lit(3)))
    names = F.filter(tokens, proper_noun)
    known = 12.0 * _count(names, in_title) + 4.0 * _count(names, in_content)
    away = F.when(likely_foreign(F.concat_ws(" ", text_of(title), text_of(content))), -40.0).otherwise(0.0)
    return whole + part + rest + known + away


def date_score(day: Column, today: Column, when: Column) -> Column:
    ahead = F.date_diff(day, today)
    soon = F.when(ahead < 0, 0.0).when(ahead <= 30, 25.0).when(ahead <= 90, 15.0).otherwise(8.0)
    return F.when(day.isNull(), -5.0).otherwise(soon + F.when(in_range(when, day), 30.0).otherwise(0.0))


def freshness(rank: Column) -> Column:
    return F.when(rank <= 0, 20.0).otherwise(F.greatest(F.lit(0.0), 10.0 - 0.5 * (rank - 1)))


def multiplier(title: Column, url: Column, city: Column, day: Column, user_city: Column, today: Column) -> Column:
    """0 for past, outdated or noisy pages; else the product of date, application, type and city factors."""
    t = text_of(title)
    old = F.nullif(F.regexp_extract(t, _OLD_YEAR, 1), F.lit("")).cast("int")
    has_city = trimmed(text_of(city)) != ""
    dated = F.when(day.isNull(), 1.0).when(has_city, 1.15).otherwise(1.08)
    applies = F.when(application(t) | contains_any(F.lower(text_of(url)), dicts.APPLICATION_KEYWORDS), 0.15).otherwise(1.0)
    kind = F.coalesce(first_hit(t, dicts.EVENT_TYPE_BOOST).cast("double"), F.lit(1.0))
    where = F.when(~has_city | (city == "全台") | user_city.isNull(), 1.0).when(city == user_city, 1.25).otherwise(0.6)
    gone = (day < today) | (old < F.year(today) - 1) | noise(t)
    return F.when(F.coalesce(gone, F.lit(False)), 0.0).otherwise(dated * applies * kind * where)


def completeness_bonus(info: Column) -> Column:
    priced = info["price_min"].isNotNull() | info["is_free"]
    return 0.2 * info["completeness"] + F.when(priced, 5.0).otherwise(0.0) + F.when(info["venue"].isNotNull(), 3.0).otherwise(0.0)


def final_score(base: Column, text: Column, date: Column, fresh: Column, factor: Column) -> Column:
    return F.greatest(F.lit(0.0), (base + text + date + fresh) * factor)


def half_up(c: Column, digits: int = 1) -> Column:
    scale = 10.0**digits
    return F.floor(c * scale + 0.5) / scale


def normalise(scored: DataFrame, by: str = "query_id", score: str = "score") -> DataFrame:
    """Scores over 0.01, moved to 10..100 within ``by``; equal scores all become 10."""
    kept = scored.filter(F.col(score) > 0.01)
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    spread = F.when(high - low < 0.001, 1.0).otherwise(high - low)
    return kept.withColumn(score, half_up((F.col(score) - low) / spread * 90 + 10))


def paginate(ranked: DataFrame, page: Column, by: str = "query_id", order: tuple[Column, ...] = (), size: int = 10) -> DataFrame:
    """One page of each ``by``: global rank, total_count and total_pages; beyond the end, no rows."""
    w = Window.partitionBy(by)
    total = F.count(F.lit(1)).over(w)
    ranked = ranked.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("total_count", total).withColumn("total_pages", F.ceil(F.col("total_count") / size).cast("int"))
    return ranked.filter(F.col("rank").between((page - 1) * size + 1, page * size))


def subpage_relevance(title: Column, content: Column, url: Column, tokens: Column) -> Column:
    t, c, u = (F.lower(text_of(x)) for x in (title, content, url))
    points = F.transform(tokens, lambda w: F.when(F.contains(t, F.lower(w)), 3.0).when(F.contains(c, F.lower(w)), 1.0).otherwise(0.0) + F.when(F.contains(u, F.lower(w)), 1.0).otherwise(0.0))
    all_in = F.forall(tokens, lambda w: F.contains(t, F.lower(w)) | F.contains(c, F.lower(w))) & (F.size(tokens) > 1)
    return F.aggregate(points, F.lit(0.0), lambda a, b: a + b) + F.when(all_in, 2.0).otherwise(0.0)


def parent_relevant(title: Column, tokens: Column) -> Column:
    t = F.lower(text_of(title))
    return _count(tokens, lambda w: F.contains(t, F.lower(w))) >= F.greatest(F.lit(1), F.floor(F.size(tokens) / 2))


def proximity_bonus(text: Column, tokens: Column) -> Column:
    """1, and 0.2 for each pair of neighbouring tokens that stands in the text with or without a space; 2 at most."""
    t = F.lower(text_of(text))
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, 1 << 20), lambda a, b: F.contains(t, F.lower(F.concat(a, b))) | F.contains(t, F.lower(F.concat(a, F.lit(" "), b))))
    return F.least(F.lit(2.0), 1.0 + 0.2 * _count(pairs, lambda x: x))
