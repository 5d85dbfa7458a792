"""Facts from HTML and from prose about events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dicts
from .dates import smart_dates, time_range
from .text import any_of, city_in, contains_any, first_hit, once, sanitize, squeeze, text_of

_TO = r"\s*[~至到-]\s*"
FREE = "免[費票]|[Ff]ree|FREE|自由入場"
PRICES = [rf"NT\$?\s*([0-9]{{1,5}}){_TO}NT?\$?\s*([0-9]{{1,5}})", r"票價[：:]?\s*([0-9]{1,5})\s*[~至到/-]\s*([0-9]{1,5})", r"票價[：:]?\s*NT?\$?\s*([0-9]{1,5})", r"([0-9]{3,5})\s*元", r"\$([0-9]{3,5})"]
HOSTS = [r"主辦[單位方]?[：:]\s*(.{2,30})", r"指導單位[：:]\s*(.{2,30})", r"協辦[：:]\s*(.{2,30})"]
_COUNTIES = [*(c for c in dicts.TAIWAN_CITIES if c != "馬祖"), "連江"]
ADDRESS = f"({'|'.join(_COUNTIES)})[市縣]?.{{2,30}}[路街道巷弄號樓]"


def _some(s: Column) -> Column:
    return F.nullif(s, F.lit(""))


# HTML


def bare_html(html: Column) -> Column:
    """Without scripts, styles and comments."""
    h = F.regexp_replace(text_of(html), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    return F.regexp_replace(h, r"(?s)<!--.*?-->", " ")


def main_text(html: Column) -> Column:
    """Text of the first article or main element, else of the first content-like div, else of the page; then image texts."""
    strip = lambda t: F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]+>", " "), r"&[a-zA-Z#0-9]+;", " ")

    def of(h: Column) -> Column:
        article = F.regexp_extract(h, r"(?is)<(article|main)\b[^>]*>(.*?)</\1\s*>", 2)
        block = F.regexp_extract(h, r"""(?is)<div[^>]*class=["'][^"']*(?:content|post|article|detail)[^"']*["'][^>]*>(.*?)</div>""", 1)
        body = once(article, lambda a: F.when(a != "", a).otherwise(once(block, lambda b: F.when(b != "", b).otherwise(h))))
        images = F.regexp_extract_all(h, F.lit(r"""(?is)<img[^>]*?\b(?:alt|title)=["']([^"']+)["']"""), F.lit(1))
        images = F.filter(images, lambda t: (F.length(t) > 2) & ~F.contains(F.lower(t), F.lit("logo")))
        return squeeze(F.concat_ws(" ", strip(body), F.array_join(images, " ")))

    return once(bare_html(html), of)


def page_title(html: Column) -> Column:
    h = text_of(html)
    title = squeeze(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return once(title, lambda t: F.when(t != "", t).otherwise(squeeze(meta(h, "og:title"))))


def meta(html: Column, name: str) -> Column:
    """The content of a meta tag by property (either order of attributes), then by name; or empty."""
    q, value = "[\"']", "[\"']([^\"']*)[\"']"
    forms = [rf"(?is)<meta[^>]*property={q}{name}{q}[^>]*content={value}", rf"(?is)<meta[^>]*content={value}[^>]*property={q}{name}{q}", rf"(?is)<meta[^>]*name={q}{name}{q}[^>]*content={value}"]
    return F.coalesce(*(_some(F.regexp_extract(text_of(html), f, 1)) for f in forms), F.lit(""))


def json_ld_text(html: Column) -> Column:
    blocks = F.regexp_extract_all(text_of(html), F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    values = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r'"(?:caption|description|name|headline)"\s*:\s*"([^"]+)"'), F.lit(1))))
    return F.array_join(values, " ")


def hrefs(html: Column) -> Column:
    """Targets of links, fragments apart, in order and with repeats."""
    return F.regexp_extract_all(text_of(html), F.lit(r"""(?i)<a[^>]+href=["']([^"'#]+)["']"""), F.lit(1))


def admissible(url: Column) -> Column:
    u = F.lower(text_of(url))
    ends = any_of(dicts.SKIP_EXTENSIONS)
    return u.startswith("http") & (F.length(u) <= 300) & ~u.rlike(f"(?:{ends})(?:$|\\?)") & ~u.rlike(any_of(dicts.SKIP_PATHS))


def looks_like_list(url: Column, html: Column) -> Column:
    """A list page by its URL, or by three event-like links."""
    u = F.lower(text_of(url))
    links = F.regexp_count(text_of(html), F.lit("(?i)href=[\"'][^\"']*(?:event|activity|show|utk)[^\"']*[\"']"))
    return u.rlike(r"category|list|search|type=|演唱會|展覽|活動|concert|events") | (u.rlike("ticket") & u.rlike(r"\.aspx")) | (links >= 3)


# Prose


def price(text: Column) -> Column:
    """struct<low, high, free>: 0 for a free entry, else the first form in order."""
    t = text_of(text)
    free = t.rlike(FREE)
    low = F.coalesce(*(_some(F.regexp_extract(t, p, 1)) for p in PRICES)).cast("int")
    high = None
    for p in PRICES:
        hit = t.rlike(p)
        value = _some(F.regexp_extract(t, p, 2)).cast("int") if p in PRICES[:2] else F.regexp_extract(t, p, 1).cast("int")
        high = F.when(hit, value) if high is None else high.when(hit, value)
    return F.struct(F.when(free, 0).otherwise(low).alias("low"), F.when(free, 0).otherwise(high).alias("high"), free.alias("free"))


def venue(text: Column) -> Column:
    return first_hit(text, [(v, v) for v, _ in dicts.VENUE_CITY])


def address(text: Column) -> Column:
    return _some(F.regexp_extract(text_of(text), ADDRESS, 0))


def organizer(text: Column) -> Column:
    found = F.coalesce(*(_some(F.regexp_extract(text_of(text), p, 1)) for p in HOSTS))
    out = squeeze(F.regexp_replace(found, "[，。,、；;\\s]+$", ""))
    return F.when(F.length(out).between(2, 30), out)


def event_type(text: Column) -> Column:
    return first_hit(F.lower(text_of(text)), dicts.EVENT_TYPE_KEYWORDS)


def event_info(text: Column, today: Column) -> Column:
    """All facts of a text as one struct, completeness 0 to 100 included."""
    dates, clock, cost = smart_dates(text, today), time_range(text), price(text)
    place, where = venue(text), address(text)
    county = _some(F.regexp_extract(text_of(text), ADDRESS, 1))
    city = F.coalesce(first_hit(text, dicts.VENUE_CITY), county)
    host, kind = organizer(text), event_type(text)
    points = [(dates["start"], 20), (dates["end"], 10), (clock["start"], 10), (place, 15), (city, 10), (cost["low"], 20), (host, 10), (kind, 5)]
    full = sum((F.when(c.isNotNull(), float(n)).otherwise(0.0) for c, n in points[1:]), F.when(points[0][0].isNotNull(), 20.0).otherwise(0.0))
    return F.struct(
        dates["start"].alias("start_date"), dates["end"].alias("end_date"), clock["start"].alias("start_time"), clock["end"].alias("end_time"), place.alias("venue"), where.alias("address"),
        city.alias("city"), cost["low"].alias("price_min"), cost["high"].alias("price_max"), cost["free"].alias("is_free"), host.alias("organizer"), kind.alias("event_type"), full.alias("completeness"),
    )


# Predicates


def excluded(url: Column) -> Column:
    """Any listed domain as a part of the URL, so ``x.com`` also hits ``netflix.com``."""
    return contains_any(F.lower(text_of(url)), dicts.EXCLUDED_DOMAINS)


def social(url: Column) -> Column:
    return contains_any(F.lower(text_of(url)), dicts.SOCIAL_DOMAINS)


def authority(url: Column) -> Column:
    return contains_any(F.lower(text_of(url)), dicts.AUTHORITY_DOMAINS)


def noise(text: Column) -> Column:
    return contains_any(text, dicts.NOISE_KEYWORDS)


def application(text: Column) -> Column:
    return contains_any(text, dicts.APPLICATION_KEYWORDS)


def proper_noun(token: Column) -> Column:
    """A known name in the token, or the token in a known name."""
    names = F.array(*map(F.lit, dicts.PROPER_NOUNS))
    return F.exists(names, lambda n: F.contains(token, n) | F.contains(n, token))


def foreign(text: Column) -> Column:
    hits = F.array(*(F.contains(text_of(text), F.lit(w)).cast("int") for w in dicts.FOREIGN_KEYWORDS))
    return F.aggregate(hits, F.lit(0), lambda a, b: a + b) >= 2


def in_taiwan(text: Column) -> Column:
    return contains_any(text, ["台灣", "臺灣", *dicts.TAIWAN_LANDMARKS]) | city_in(text).isNotNull()


def likely_foreign(text: Column) -> Column:
    return foreign(text) & ~in_taiwan(text)


def travel_spam(text: Column) -> Column:
    """Flight words; an airline without an event word; a bargain and a booking together."""
    t = F.lower(text_of(text))
    return t.rlike("機票|航班|飛往|cheap flights|airfare") | (t.rlike("航空|airline") & ~t.rlike("[展節祭]|活動")) | (t.rlike("特價優惠") & t.rlike("預訂"))


_XSS = r"(?i)</?script|javascript:|on\w+\s*=|<(?:iframe|object|embed)"
_SQL = r"(?i)[';]|--|/\*|\*/|xp_|exec|insert|select|delete|update|drop|union|into|load_file|outfile"


def valid_query(query: Column) -> Column:
    """Empty for a valid request, else what is wrong with it."""
    t = F.regexp_replace(F.regexp_replace(query, r"^[\x00-\x20]+", ""), r"[\x00-\x20]+$", "")
    return F.when(query.isNull(), "missing").when(F.length(t) < 2, "short").when(F.length(t) > 100, "long").when(t.rlike(_XSS), "markup").when(t.rlike(_SQL), "sql").otherwise("")


def checked_query(query: Column) -> Column:
    """struct<valid, problem, value>: the trimmed request without markup, null if there is a problem."""
    problem = valid_query(query)
    return F.struct((problem == "").alias("valid"), problem.alias("problem"), F.when(problem == "", sanitize(query)).alias("value"))


def allowed_characters(query: Column) -> Column:
    """Only Han, ASCII letters and digits, white space and common marks, at least one."""
    return text_of(query).rlike(r"^[\u4e00-\u9fff\u3400-\u4dbfa-zA-Z0-9\s\-_.，。、！？]+$")


def valid_page(page: Column) -> Column:
    n = F.when(page.rlike(r"^\s*[+-]?[0-9]{1,9}\s*$"), F.trim(page).cast("int"))
    return F.when(n.between(1, 100), n).otherwise(1)


def valid_city(city: Column) -> Column:
    t = F.trim(text_of(city))
    return F.when(t == "", "台北").when((F.length(t) > 20) | t.rlike(_XSS), F.lit(None)).otherwise(t)


def in_box(lat: Column, lng: Column) -> Column:
    return lat.between(21.0, 26.5) & lng.between(119.0, 122.5)
