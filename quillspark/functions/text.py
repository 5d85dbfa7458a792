"""Strings, tokens, hashes and similarity as Column expressions; null texts count as empty."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dicts

HAN = "[一-鿿㐀-䶿]"


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def once(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_literal(words: Iterable[str]) -> Column:
    return F.array(*map(F.lit, words))


def any_of(words: Iterable[str]) -> str:
    """A regular expression for one of the words."""
    return "|".join(map(re.escape, words))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    return text_of(c).rlike(any_of(words))


def found_in(c: Column, words: Iterable[str]) -> Column:
    """The words that the text contains, in the list's order."""
    t = text_of(c)
    return F.filter(words_literal(words), lambda w: F.contains(t, w))


def first_hit(c: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """The value of the first key that the text contains, else null."""
    out, t = None, text_of(c)
    for key, value in pairs:
        hit = F.contains(t, F.lit(key))
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out


def lookup(c: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """The value of an equal key, else null."""
    out = None
    for key, value in pairs:
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return out


def swap_all(c: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def trimmed(c: Column) -> Column:
    """Without characters up to U+0020 at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\x00-\x20]+", ""), r"[\x00-\x20]+$", "")


def squeeze(c: Column) -> Column:
    return trimmed(F.regexp_replace(text_of(c), r"[ \t\n\x0B\f\r]+", " "))


def truncate(c: Column, most: int) -> Column:
    t = text_of(c)
    return F.when(F.length(t) > most, F.concat(t.substr(1, most), F.lit("..."))).otherwise(t)


def join_parts(*parts: Column) -> Column:
    """Trimmed parts that aren't blank, joined by a space."""
    return F.concat_ws(" ", *(F.nullif(trimmed(text_of(p)), F.lit("")) for p in parts))


def occurrences(c: Column, word: Column) -> Column:
    """How often ``word`` occurs, not overlapping; 0 for an empty word."""
    t = text_of(c)
    return F.when(F.length(word) > 0, ((F.length(t) - F.length(F.replace(t, word, F.lit("")))) / F.length(word)).cast("int")).otherwise(0)


def mask(c: Column) -> Column:
    t = text_of(c)
    return F.when(F.length(t) <= 4, F.lit("****")).otherwise(F.concat(F.left(t, F.lit(2)), F.lit("****"), F.right(t, F.lit(2))))


_ENTITIES = [("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]


def sanitize(c: Column) -> Column:
    """Control characters out, HTML's special characters as entities, white space squeezed."""
    t = F.regexp_replace(text_of(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return squeeze(swap_all(t, [("&", "&amp;"), *_ENTITIES]))


def unsanitize(c: Column) -> Column:
    return swap_all(text_of(c), [(b, a) for a, b in _ENTITIES] + [("&amp;", "&")])


def decode_entities(c: Column) -> Column:
    return swap_all(text_of(c), [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")])


def json_unescape(c: Column) -> Column:
    return swap_all(text_of(c), [("\\n", " "), ("\\r", " "), ("\\t", " "), ("\\/", "/"), ('\\"', '"'), ("\\\\", "\\")])


# URLs


def url_domain(url: Column) -> Column:
    """What stands before the first slash; a port or a query without a slash stays."""
    rest = F.regexp_replace(F.lower(text_of(url)), "^.*?://", "")
    return F.regexp_replace(rest, "(?s)(?<=.)/.*$", "")


def url_host(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))


def url_title(url: Column) -> Column:
    return F.translate(F.regexp_extract(text_of(url), "([^/]*)$", 1), "-_", "  ")


def url_key(url: Column) -> Column:
    """The key under which URLs count as one page; one trailing slash goes before the fragment does."""
    steps = [(r"^https?://", ""), (r"^www\.", ""), (r"/$", ""), (r"#.*$", ""), (r"\?utm_[^&]*", ""), (r"\?fbclid=[^&]*", ""), (r"\?ref=[^&]*", ""), (r"[?&](utm_|fbclid|gclid|ref=)[^&]*", "")]
    out = F.lower(text_of(url))
    for pattern, new in steps:
        out = F.regexp_replace(out, pattern, new)
    return out


def url_resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link: absolute, //host, /path, ?query or relative; null for other schemes."""
    h = trimmed(text_of(href))
    scheme = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    root = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    plain = F.regexp_replace(base, "[?#].*$", "")
    folder = F.when(plain == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(plain, "[^/]*$", ""))
    joined = F.concat(folder, F.regexp_replace(h, r"^(\./)+", ""))
    for _ in range(4):
        joined = F.regexp_replace(joined, r"(?<=[^/:])/(?!\.\./)[^/?#]+/\.\./", "/")
    return (
        F.when(h.rlike("^https?://"), h).when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None)).when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(root, h)).when(h == "", base).when(h.startswith("?"), F.concat(plain, h)).when(h.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), h)).otherwise(joined)
    )


def title_key(title: Column) -> Column:
    t = F.regexp_replace(F.lower(text_of(title)), r"[ \t\n\x0B\f\r\-_|｜–—]+", " ")
    return squeeze(F.regexp_replace(t, r"[【】\[\]()（）]", ""))


def query_params(query: Column) -> Column:
    """Key to decoded value of ``a=1&b=2``; the last of a key wins, a pair without = is left out, bad escapes give null."""
    pairs = F.filter(F.split(text_of(query), "&"), lambda p: F.contains(p, F.lit("=")))
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.try_url_decode(F.regexp_replace(p, "^[^=]*=", "")).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


# Places


_PAGE_CITY = [(k, v) for k, v in dicts.CITY_ALIASES]


def page_city(city: Column) -> Column:
    """A canonical city for an equal alias (case and outer spaces apart), else the input."""
    return F.coalesce(lookup(F.lower(trimmed(text_of(city))), _PAGE_CITY), city)


def alias_city(city: Column) -> Column:
    """An equal alias, else the first alias contained, else the trimmed input."""
    low = F.lower(trimmed(text_of(city)))
    return F.coalesce(lookup(low, _PAGE_CITY), first_hit(low, _PAGE_CITY), trimmed(text_of(city)))


def city_in(text: Column) -> Column:
    """The city of the first venue named, else the first city named."""
    return F.coalesce(first_hit(text, dicts.VENUE_CITY), first_hit(text, [(c, c) for c in dicts.TAIWAN_CITIES]))


def district_in(text: Column) -> Column:
    return first_hit(text, [(d, d) for d, _ in dicts.DISTRICT_COORDS])


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    return 6371.0 * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def nearest_city(lat: Column, lng: Column) -> Column:
    """The nearest of the city centres, the earlier of equals; 台北 without coordinates."""
    spots = [(c, *map(float, p.split(";"))) for c, p in dicts.CITY_COORDS]
    near = F.array_min(F.array(*(F.struct(haversine_km(lat, lng, F.lit(y), F.lit(x)).alias("km"), F.lit(i).alias("ord"), F.lit(c).alias("city")) for i, (c, y, x) in enumerate(spots))))
    return F.when(lat.isNull() | lng.isNull(), F.lit("台北")).otherwise(near["city"])


def distance_factor(km: Column) -> Column:
    return F.when(km.isNull(), 1.0).when(km < 20, 1.3).when(km < 50, 1.15).when(km < 100, 1.0).when(km < 200, 0.85).otherwise(0.7)


# Tokens


def grams(c: Column, n: int) -> Column:
    """All runs of n characters; none for shorter texts."""
    size = F.length(c)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: c.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _not_stop(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*dicts.STOP_WORDS))  # a hash set


def han_tokens(run: Column) -> Column:
    """Important terms in a run, bigrams that aren't part of one, and all trigrams; stop words out."""
    terms = found_in(run, dicts.IMPORTANT_TERMS)
    pairs = F.filter(_not_stop(grams(run, 2)), lambda g: ~F.exists(terms, lambda t: F.contains(t, g)))
    return F.when(F.length(run) < 2, F.array().cast("array<string>")).otherwise(F.concat(terms, pairs, _not_stop(grams(run, 3))))


def tokens(c: Column) -> Column:
    """English words of two letters or more, then the tokens of each Han run."""
    low = F.lower(text_of(c))
    english = F.filter(_not_stop(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0))), lambda w: F.length(w) >= 2)
    han = F.regexp_extract_all(low, F.lit(f"{HAN}+"), F.lit(0))
    return F.concat(english, F.flatten(F.transform(han, han_tokens)))


def query_tokens(query: Column) -> Column:
    """Words without a leading minus; a word that ends in a known suffix also gives its stem and the suffix, once."""
    words = F.filter(F.split(trimmed(text_of(query)), r"\s+"), lambda w: (w != "") & ~w.startswith("-"))

    def suffix(w: Column) -> Column:
        out = F.lit(None).cast("string")
        for s in reversed(dicts.QUERY_SUFFIXES):
            out = F.when(w.endswith(s) & (F.length(w) > len(s)), F.lit(s)).otherwise(out)
        return out

    def grow(acc: Column, w: Column) -> Column:
        base = F.concat(acc, F.array(w))
        s = suffix(w)
        stem = w.substr(F.lit(1), F.length(w) - F.length(s))
        with_stem = F.when((F.length(stem) >= 2) & ~F.array_contains(base, stem), F.concat(base, F.array(stem))).otherwise(base)
        with_suffix = F.when(~F.array_contains(with_stem, s), F.concat(with_stem, F.array(s))).otherwise(with_stem)
        return F.when(s.isNull(), base).otherwise(with_suffix)

    return F.aggregate(words, F.array().cast("array<string>"), grow)


# Similarity


def title_similarity(a: Column, b: Column) -> Column:
    """0 for an empty side, 1 for equal, 0.85 for one inside the other, else the Jaccard index of bigrams; of title keys."""
    return once(F.struct(title_key(a).alias("x"), title_key(b).alias("y")), lambda k: _key_similarity(k["x"], k["y"]))


def _key_similarity(x: Column, y: Column) -> Column:
    def jaccard(g: Column) -> Column:
        return once(F.size(F.array_union(g["x"], g["y"])), lambda union: F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(g["x"], g["y"])) / union))

    sets = F.struct(F.array_distinct(grams(x, 2)).alias("x"), F.array_distinct(grams(y, 2)).alias("y"))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.85).otherwise(once(sets, jaccard))


_MASK = 0xFFFFFFFF
_PRIME_HIGH, _PRIME_LOW = 0x100, 0x1B3
_BASIS_HIGH, _BASIS_LOW = 0xCBF29CE4, 0x84222325


def fnv1a_units(units: list[Column]) -> Column:
    """64-bit FNV-1a over 16-bit units, multiplied in halves so that nothing overflows."""
    high, low = F.lit(_BASIS_HIGH).cast("long"), F.lit(_BASIS_LOW).cast("long")
    for u in units:
        low = low.bitwiseXOR(u.cast("long"))
        product = low * _PRIME_LOW
        high = (high * _PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(low, 8)).bitwiseAND(F.lit(_MASK))
        low = product.bitwiseAND(F.lit(_MASK))
    signed = F.when(high >= 1 << 31, high - (1 << 32)).otherwise(high)
    return F.shiftleft(signed, 32).bitwiseOR(low)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_content(title: Column, content: Column) -> Column:
    return F.concat(text_of(title), F.lit(" "), text_of(content).substr(1, 2000))


def page_similarity(title_sim: Column, distance: Column) -> Column:
    return once(title_sim, lambda s: F.when(s >= 0.8, s).otherwise(0.6 * s + 0.4 * (1 - distance / 64)))
