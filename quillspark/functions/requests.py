"""Requests: what they ask for, how they are expanded, and what to suggest next."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dicts
from .dates import query_range
from .text import any_of, contains_any, first_hit, text_of, trimmed

_KINDS = "市集 展覽 演唱會 音樂節 活動 演出 表演".split()
_FREE = "免費 free"


def _present(array: Column) -> Column:
    return F.filter(array, lambda x: x.isNotNull())


def city_of(query: Column) -> Column:
    names = [(c, c) for c in dicts.TAIWAN_CITIES]
    return F.coalesce(first_hit(query, names), first_hit(F.lower(text_of(query)), dicts.CITY_ALIASES))


def intents(query: Column, today: Column) -> Column:
    """DATE, PLACE, TYPE, FREE as far as they are said, else FIND_EVENT; GENERAL for a blank request."""
    q, when = text_of(query), query_range(query, today)
    place = F.coalesce(city_of(q), first_hit(q, dicts.VENUE_CITY))
    said = _present(F.array(
        F.when(when["target"].isNotNull() | when["start"].isNotNull(), "DATE"), F.when(place.isNotNull(), "PLACE"),
        F.when(type_of(q).isNotNull(), "TYPE"), F.when(wants_free(q), "FREE"),
    ))
    return F.when(trimmed(q) == "", F.array(F.lit("GENERAL"))).when(F.size(said) == 0, F.array(F.lit("FIND_EVENT"))).otherwise(said)


def type_of(query: Column) -> Column:
    return first_hit(query, [(t, t) for t in dicts.EVENT_TYPES])


def wants_free(query: Column) -> Column:
    return F.lower(text_of(query)).rlike(_FREE.replace(" ", "|"))


def expansions(query: Column) -> Column:
    """The first synonym of each key named, unless it is there already."""
    q = text_of(query)
    return _present(F.array(*(F.when(F.contains(q, F.lit(k)) & ~F.contains(q, F.lit(v[0])), v[0]) for k, v in dicts.SYNONYMS.items())))


def expand(query: Column, today: Column) -> Column:
    q = text_of(query)
    year = F.year(query_range(q, today)["start"]).cast("string")
    generic = F.lower(q).rlike("活動|event|展覽|演唱會|市集")
    return trimmed(F.concat_ws(" ", q, F.nullif(F.array_join(expansions(q), " "), F.lit("")), F.when(~F.contains(q, year), year), F.when(~generic, "活動")))


def refine(query: Column, today: Column) -> Column:
    """A place alone gets the kinds of event; the current year, or none, becomes this year or the next."""
    q = trimmed(text_of(query))
    low = F.lower(q)
    kinds = F.when(contains_any(low, dicts.REFINE_PLACE_WORDS) & ~contains_any(low, [t.lower() for t in dicts.EVENT_TERMS]), F.concat(q, F.lit(f" ({' OR '.join(_KINDS)})"))).otherwise(q)
    year = F.year(today).cast("string")
    clause = F.concat(F.lit("("), year, F.lit(" OR "), (F.year(today) + 1).cast("string"), F.lit(")"))
    out = F.when(F.contains(kinds, year), F.replace(kinds, year, clause)).when(kinds.rlike("202[0-4]"), kinds).otherwise(F.concat(kinds, F.lit(" "), clause))
    return F.when(q == "", q).otherwise(out)


def keywords(query: Column) -> Column:
    cut = F.regexp_replace(text_of(query), any_of("的 在 有 要 找 想 去 看 參加".split()), " ")
    return F.filter(F.split(cut, r"\s+"), lambda w: F.length(w) >= 2)


def parse(query: Column, today: Column) -> Column:
    """All of a request as one struct."""
    q = text_of(query)
    when, found = query_range(q, today), intents(q, today)
    spot = first_hit(q, [(v, v) for v, _ in dicts.VENUE_CITY])
    return F.struct(
        q.alias("original_query"), expand(q, today).alias("expanded_query"), F.get(found, F.lit(0)).alias("primary_intent"), found.alias("intents"),
        F.coalesce(city_of(q), first_hit(q, dicts.VENUE_CITY)).alias("city"), spot.alias("venue"), type_of(q).alias("event_type"), when["target"].alias("target_date"),
        when["start"].alias("range_start"), when["end"].alias("range_end"), wants_free(q).alias("wants_free"), keywords(q).alias("keywords"), expansions(q).alias("synonym_expansions"),
    )


def in_range(when: Column, day: Column) -> Column:
    """Whether a day is in a closed range; one without an end lasts a month."""
    return day.between(when["start"], F.coalesce(when["end"], F.add_months(when["start"], 1)))


def suggest(query: Column, city: Column, most: int = 8) -> Column:
    """Suggestions by type, by city, by time, and hot ones where those are few; distinct, in that order."""
    q = F.lower(text_of(query))
    absent = lambda s, part: F.when(~F.contains(q, F.lit(part)), s)
    by_type = [F.when(F.contains(q, F.lit(k)), absent(F.lit(s), s.lower())) for k, v in dicts.TYPE_SUGGESTIONS.items() for s in v]
    by_city = [F.when(city == k, absent(F.lit(s), s.lower().replace(k, ""))) for k, v in dicts.CITY_SUGGESTIONS.items() for s in v]
    by_time = [absent(F.lit(s), s.replace("活動", "")) for s in dicts.TIME_SUGGESTIONS]
    hot = [absent(F.lit(s), s.lower()) for s in dicts.HOT_SUGGESTIONS]
    first = F.array_distinct(_present(F.array(*by_type, *by_city, *by_time)))
    return F.slice(F.when(F.size(first) < 6, F.array_distinct(F.concat(first, _present(F.array(*hot))))).otherwise(first), 1, most)


def related(query: Column, most: int = 5) -> Column:
    """The request with its type replaced by synonyms, then with its city replaced by other metropolises."""
    q = text_of(query)
    kind, place = type_of(q), F.coalesce(city_of(q), first_hit(q, dicts.VENUE_CITY))
    swaps = [F.when((kind == k) & ~F.contains(q, F.lit(s)), F.replace(q, F.lit(k), F.lit(s))) for k, v in dicts.SYNONYMS.items() for s in v]
    metros = [F.when(place != c, F.replace(q, place, F.lit(c))) for c in "台北 台中 高雄 台南".split()]
    return F.slice(_present(F.array(*swaps, *metros)), 1, most)


def category_words(category: Column) -> Column:
    out = None
    for k, v in dicts.CATEGORY_EXPANSIONS.items():
        words = F.array(*map(F.lit, v))
        out = F.when(category == k, words) if out is None else out.when(category == k, words)
    return F.coalesce(out, F.array().cast("array<string>"))


def related_words(word: Column) -> Column:
    """Members of every group that holds the word, without the word itself."""
    groups = [[k, *v] for k, v in dicts.RELATED_KEYWORDS.items()]
    hits = [F.when(F.array_contains(F.array(*map(F.lit, g)), word), F.array(*map(F.lit, g))).otherwise(F.array().cast("array<string>")) for g in groups]
    return F.filter(F.array_distinct(F.concat(*hits)), lambda w: w != word)
