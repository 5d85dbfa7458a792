"""Event cards of list pages: title, target and date of each, by the form that the page's host uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extract import _some
from .text import squeeze, text_of, url_host, url_resolve

MOST = 20
_Q = "[\"']"
_TAG = "<[^>]+>"
_DATE = "[0-9]{4}[/.-][0-9]{1,2}[/.-][0-9]{1,2}|[0-9]{1,2}[/.-][0-9]{1,2}|[0-9]{1,2}月[0-9]{1,2}日?"
_BOX = rf"(?is)<div[^>]*class={_Q}[^\"']*(?:event|item|card|product)[^\"']*{_Q}[^>]*>(.*?)</div>"
_LINK = rf"(?i)<a[^>]+href={_Q}([^\"']+){_Q}[^>]*>"
_IMAGE = rf"(?i)<a[^>]+href={_Q}([^\"']+){_Q}[^>]*>\s*<img[^>]+alt={_Q}([^\"']+){_Q}"
_SPAN = rf"(?is)<a[^>]+href={_Q}([^\"']*?/event/[^\"']+){_Q}[^>]*>.*?(?:<[^>]*>)*([^<]{{5,100}})"
#: To the last end of a link on the page, as tags inside a link aren't told from its end.
_ANY = rf"(?is)<a[^>]+href={_Q}([^\"']*?(?:event|activity|show|concert|ticket|演唱|展覽|活動)[^\"']*){_Q}[^>]*>(.*)</a>"


def _after(path: str) -> str:
    return rf"(?is)<a[^>]+href={_Q}([^\"']*?{path}[^\"']+){_Q}[^>]*>(?=(.{{0,200}}))"


def _all(t: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(t, F.lit(pattern), F.lit(group))


def first_text(html: Column) -> Column:
    """Text without tags; of more than 100 characters, those up to the last space among them, if it is past the 50th."""
    t = squeeze(F.regexp_replace(text_of(html), _TAG, " "))
    head = t.substr(1, 100)
    space = 100 - F.instr(F.reverse(head), " ")  # from 0; 100 without one
    return F.when(F.length(t) <= 100, t).when((F.instr(head, " ") > 0) & (space > 50), F.substring(head, F.lit(1), space)).otherwise(head)


def card_title(card: Column) -> Column:
    """The first heading, else the first image's text, else the first title attribute, else the first text."""
    t = text_of(card)
    forms = [r"(?i)<h[1-6][^>]*>([^<]+)</h[1-6]>", rf"(?i)<img[^>]+alt={_Q}([^\"']+){_Q}", rf"(?i)title={_Q}([^\"']+){_Q}"]
    return F.coalesce(*(F.when(t.rlike(f), squeeze(F.regexp_extract(t, f, 1))) for f in forms), first_text(t))


def card_date(card: Column) -> Column:
    """The first date as it is written, or empty."""
    return F.regexp_extract(text_of(card), _DATE, 0)


def _cards(title: Column, url: Column, date: Column) -> Column:
    return F.struct(title.alias("title"), url.alias("url"), date.alias("date"))


def _first_of_url(cards: Column) -> Column:
    urls = F.transform(cards, lambda c: c["url"])
    return F.filter(cards, lambda c, i: F.array_position(urls, c["url"]) == i + 1)


def _pairs(t: Column, pattern: str, url: Column, make) -> Column:
    zipped = F.arrays_zip(_all(t, pattern, 1).alias("href"), _all(t, pattern, 2).alias("rest"))
    made = F.transform(zipped, lambda z: _cards(make(z["rest"]), url_resolve(url, z["href"]), F.lit("")))
    return F.filter(made, lambda c: c["url"].isNotNull())


def event_cards(html: Column, url: Column) -> Column:
    """array<struct<title, url, date>>: twenty at most, in the page's order.

    Only boxes of the ticket form have dates, and they alone may repeat a target.
    """
    t = text_of(html)
    host = F.lower(url_host(url))
    boxes = F.transform(_all(t, _BOX, 1), lambda b: _cards(card_title(b), F.when(b.rlike(_LINK), url_resolve(url, F.regexp_extract(b, _LINK, 1))), card_date(b)))
    boxes = F.filter(boxes, lambda c: c["url"].isNotNull() & (F.length(c["title"]) > 3))
    images = F.filter(_pairs(t, _IMAGE, url, squeeze), lambda c: (F.length(c["title"]) > 3) & ~F.lower(c["title"]).rlike("logo|banner"))
    spans = _first_of_url(F.filter(_pairs(t, _SPAN, url, squeeze), lambda c: F.length(c["title"]) > 3))
    near = lambda path: F.filter(_first_of_url(_pairs(t, _after(path), url, first_text)), lambda c: c["title"] != "")
    links = _pairs(t, _ANY, url, lambda r: squeeze(F.regexp_replace(r, _TAG, " ")))
    links = _first_of_url(F.filter(links, lambda c: (F.length(c["title"]) > 5) & (F.length(c["title"]) < 100)))
    chosen = (
        F.when(host.rlike(r"ticket\.com\.tw|era\.com"), F.when(F.size(boxes) > 0, boxes).otherwise(images)).when(F.contains(host, F.lit("accupass")), spans)
        .when(F.contains(host, F.lit("kktix")) | F.contains(host, F.lit("opentix")), near("/events?/")).when(F.contains(host, F.lit("tixcraft")), near("/activity/detail/")).otherwise(links)
    )
    return F.slice(chosen, 1, MOST)


def same_site_links(html: Column, url: Column, hrefs: Column, most: int = 60) -> Column:
    """Absolute targets on the page's host or below it, each once, in order."""
    host = _some(url_host(url))
    whole = F.array_distinct(F.filter(F.transform(hrefs, lambda h: url_resolve(url, h)), lambda u: u.isNotNull()))
    return F.slice(F.filter(whole, lambda u: (url_host(u) == host) | F.endswith(url_host(u), F.concat(F.lit("."), host))), 1, most)
