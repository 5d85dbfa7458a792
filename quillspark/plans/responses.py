"""Answers in JSON and reports as text, and the queries of sources, sub-pages and keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import cards, dicts, extract, requests, text
from quillspark.operators import dedup, keywords, ranking
from quillspark.operators.tfidf import partitions
from quillspark.sources.hits import hits_of_json, page_body

from .catalog import LISTED, TODAY, anyof, listing, query, table, words
from .pages import _HREFS, _LDS, _MAINS, _METAS, _TITLE, _made, _made_sql
from .listings import _INFO
from .search import informed, relevant


def as_json(results: DataFrame) -> DataFrame:
    """(query_id, body): one JSON document of each request's page of results."""
    row = F.struct("rank", "title", "url", "domain", F.round("score", 1).alias("score"), F.coalesce("city", F.lit("")).alias("city"), F.col("event_date").alias("eventDate"))
    rows = results.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("results"), F.max("total_count").alias("totalCount"), F.max("total_pages").alias("totalPages"))
    return rows.select("query_id", F.to_json(F.struct(F.lit(True).alias("success"), "totalCount", "totalPages", F.lit(False).alias("cached"), "results")).alias("body"))


def as_cached(body: Column) -> Column:
    """The same document marked as served from a cache."""
    return F.replace(body, F.lit('"cached":false'), F.lit('"cached":true'))


def as_error(message: Column, code: Column) -> Column:
    return F.to_json(F.struct(F.lit(False).alias("success"), message.alias("error"), code.alias("code")))


def subpage_answer(asked: DataFrame, results: DataFrame, url: str = "url") -> DataFrame:
    """(all columns of ``asked``, code, body): the sub-pages of the result of that very URL; 400 without a URL, 404 without a result.

    ``results``: url, subs (array of url, title, score); of several results of one URL, the least ``pos`` counts.
    """
    one = results.groupBy(F.col("url").alias("__url")).agg(F.min_by("subs", "pos").alias("__subs"))
    both = asked.join(one, asked[url] == one["__url"], "left")
    row = lambda s: F.struct(F.coalesce(s["url"], F.lit("")).alias("url"), F.coalesce(s["title"], F.lit("")).alias("title"), F.round(s["score"], 1).alias("score"))
    blank = F.trim(text.text_of(F.col(url))) == ""
    code = F.when(blank, 400).when(F.col("__url").isNull(), 404).otherwise(200)
    body = F.when(code == 200, F.to_json(F.struct(F.lit(True).alias("success"), F.transform("__subs", row).alias("subPages")))).otherwise(as_error(F.when(blank, "url is missing").otherwise("no such result"), code))
    return both.select(*(F.col(c) for c in asked.columns), code.alias("code"), body.alias("body"))


def suggestion_answer(suggestions: Column) -> Column:
    return F.to_json(F.struct(F.lit(True).alias("success"), suggestions.alias("suggestions")))


def category_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, n, icon, colour) for i, n, icon, colour in dicts.CATEGORIES], "id string, name string, query string, icon string, color string").coalesce(1)


def cache_report(hits: DataFrame, keys: Column, most: int, ttl_s: int) -> DataFrame:
    """One row: size, max_size, hits, misses, hit_rate in percent, ttl_seconds; for a cache that nothing expires from."""
    return hits.agg(
        F.least(F.count_distinct(keys), F.lit(most)).alias("size"), F.lit(most).alias("max_size"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"),
        F.round(F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)) * 100, 2).alias("hit_rate"), F.lit(ttl_s).alias("ttl_seconds"),
    )


def health(version: Column, now: Column, stopping: Column) -> Column:
    """struct<code, body> of a readiness probe: 503 while stopping."""
    code = F.when(stopping, 503).otherwise(200)
    body = F.to_json(F.struct(F.when(stopping, "stopping").otherwise("ok").alias("status"), version.alias("version"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")))
    return F.struct(code.alias("code"), body.alias("body"))


def site_report(pages: DataFrame, top: int = 5, width: int = 40) -> DataFrame:
    """(place, domain, report): sites by total score, their five most frequent title words and their pages."""
    named = pages.select("pos", text.url_domain(F.col("url")).alias("domain"), "title", "score")
    word = named.select("domain", F.explode(text.tokens(F.col("title"))).alias("word")).groupBy("domain", "word").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.col("n").desc(), "word"))
    best = word.withColumn("p", place).filter(F.col("p") <= top).groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("p", "word", "n"))).alias("w"))
    line = F.format_string("    - %s (%.2f)", text.truncate(F.col("title"), width), F.col("score"))
    sites = named.groupBy("domain").agg(F.sum("score").alias("total"), F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    said = F.array_join(F.transform("w", lambda x: F.concat(x["word"], F.lit("("), x["n"].cast("string"), F.lit(")"))), ", ")
    ranked = sites.join(best, "domain", "left").withColumn("place", F.row_number().over(Window.orderBy(F.col("total").desc(), "domain")))
    report = F.concat_ws("\n", F.format_string("#%d %s (total: %.2f)", "place", "domain", "total"), F.when(F.col("w").isNotNull(), F.concat(F.lit("    keywords: "), said)), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return ranked.select("place", "domain", report.alias("report"))


def keyword_report(query: Column, extracted: Column, suggested: Column, expanded: Column) -> Column:
    """The sections of a keyword analysis as one text."""
    listed = lambda head, c: F.concat_ws("\n", F.lit(head), F.array_join(F.transform(c, lambda w: F.concat(F.lit("  * "), w)), "\n"))
    return F.concat_ws("\n", F.concat(F.lit("query: "), query), listed("keywords:", extracted), listed("suggested:", suggested), F.concat(F.lit("expanded: "), expanded))


def page_numbers(page: Column, total: Column, width: int = 5) -> Column:
    """The page numbers around a page, ``width`` at most; none without pages."""
    start = F.greatest(F.lit(1), F.least(page - width // 2, total - width + 1))
    return F.when(total > 0, F.sequence(start, F.least(total, start + width - 1))).otherwise(F.array().cast("array<int>"))


def translated(asked: DataFrame, table: DataFrame, fallback: str) -> DataFrame:
    """Adds ``text``: of (lang, key) in ``table`` (lang, key, text).  A language that isn't there is ``fallback``'s; a missing or empty text is its key."""
    known = F.broadcast(table.select(F.col("lang").alias("__lang")).distinct())
    spoken = asked.join(known, asked["lang"] == known["__lang"], "left").withColumn("__lang", F.coalesce("__lang", F.lit(fallback)))
    t = table.groupBy(F.col("lang").alias("__l"), F.col("key").alias("__k")).agg(F.min("text").alias("__t"))
    both = spoken.join(t, (F.col("__lang") == F.col("__l")) & (F.col("key") == F.col("__k")), "left")
    return both.withColumn("text", F.coalesce(F.nullif("__t", F.lit("")), F.col("key"))).drop("__lang", "__l", "__k", "__t")


def local_city(name: Column) -> Column:
    """The Chinese name of a city said in English or Korean, else the name."""
    return F.coalesce(text.lookup(name, dicts.CITY_NAMES), name)


@query()
def ranked_search_json(spark, sf_dir):
    from .search import ranked_search

    return as_json(ranked_search(spark, sf_dir))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{n}', '{n}', '{icon}', '{c}')" for i, n, icon, c in dicts.CATEGORIES) + ") AS t(id, name, query, icon, color)")
def categories(spark, sf_dir):
    return category_rows(spark)


_ERR = "CASE WHEN city_txt = '' THEN '{\"success\":false,\"error\":\"no \\\"city\\\"\",\"code\":400}' ELSE '{\"success\":false,\"error\":\"' || replace(type_txt, '\"', '\\\"') || '\",\"code\":404}' END"


@query(f"{LISTED} SELECT listing_id, {_ERR} AS body, replace('{{\"a\":1,\"cached\":false}}', 'false', 'true') AS cached FROM listing")
def error_answers(spark, sf_dir):
    empty = F.col("city_txt") == ""
    body = as_error(F.when(empty, 'no "city"').otherwise(F.col("type_txt")), F.when(empty, 400).otherwise(404))
    return listing(spark, sf_dir).select("listing_id", body.alias("body"), as_cached(F.lit('{"a":1,"cached":false}')).alias("cached"))


def _with_subs(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    subs = F.transform(F.array_distinct(extract.hrefs(F.col("html"))), lambda h, i: F.struct(h.alias("url"), text.url_title(h).alias("title"), (i * 1.25).alias("score")))
    return p.select(F.col("page_id").alias("pos"), "url", subs.alias("subs"))


@query(f"""
WITH l AS (SELECT page_id, url, min(i) AS o, h FROM (SELECT page_id, url, unnest({_HREFS}) AS h, generate_subscripts({_HREFS}, 1) AS i FROM pages) GROUP BY page_id, url, h),
n AS (SELECT url, h, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS k FROM l WHERE page_id IN (SELECT min(page_id) FROM pages GROUP BY url))
SELECT p.page_id, CASE WHEN p.page_id % 5 = 0 THEN 400 WHEN p.page_id % 5 = 1 THEN 404 ELSE 200 END AS code,
  CASE WHEN p.page_id % 5 < 2 THEN '' ELSE coalesce((SELECT string_agg(h || '=' || translate(regexp_extract(h, '([^/]*)$', 1), '-_', '  ') || '=' || (floor(k * 12.5 + 0.5) / 10)::DOUBLE::VARCHAR, '|' ORDER BY k) FROM n WHERE n.url = p.url), '') END AS subs
FROM pages p""")
def subpage_answers(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    asked = p.select("page_id", F.when(F.col("page_id") % 5 == 0, " ").when(F.col("page_id") % 5 == 1, F.concat("url", F.lit("?no"))).otherwise(F.col("url")).alias("url"))
    rows = subpage_answer(asked, _with_subs(spark, sf_dir))
    back = F.from_json("body", "subPages array<struct<url:string,title:string,score:double>>")["subPages"]
    said = F.array_join(F.transform(back, lambda s: F.concat_ws("=", s["url"], s["title"], s["score"].cast("string"))), "|")
    return rows.select("page_id", "code", F.coalesce(said, F.lit("")).alias("subs"))


@query()
def suggestion_answers(spark, sf_dir):
    rows = listing(spark, sf_dir).select("city_txt", "type_txt").distinct()
    return rows.select("city_txt", "type_txt", suggestion_answer(requests.suggest(F.concat("city_txt", "type_txt"), F.col("city_txt"))).alias("body"))


@query(f"""
WITH t AS (SELECT page_id, regexp_replace(regexp_replace(lower(url), '^.*?://', ''), '/.*$', '') AS domain, {_TITLE} AS title, length(html)::DOUBLE AS score FROM pages),
w AS (SELECT domain, word, count(*) AS n FROM (SELECT domain, unnest(list_filter(regexp_extract_all(lower(title), '[a-z]+'), lambda x: length(x) >= 2 AND NOT list_contains({words(dicts.STOP_WORDS)}, x))) AS word FROM t) GROUP BY ALL),
b AS (SELECT domain, string_agg(word || '(' || n || ')', ', ' ORDER BY p) AS w FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, word) AS p FROM w) WHERE p <= 5 GROUP BY domain),
s AS (SELECT domain, sum(score) AS total, string_agg('    - ' || CASE WHEN length(title) > 40 THEN substr(title, 1, 40) || '...' ELSE title END || ' (' || printf('%.2f', score) || ')', chr(10) ORDER BY page_id) AS lines FROM t GROUP BY domain),
r AS (SELECT row_number() OVER (ORDER BY total DESC, domain)::INT AS place, * FROM s)
SELECT place, r.domain AS domain, concat_ws(chr(10), '#' || place || ' ' || r.domain || ' (total: ' || printf('%.2f', total) || ')', '    keywords: ' || w, lines) AS report FROM r LEFT JOIN b ON r.domain = b.domain""")
def site_reports(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return site_report(p.select(F.col("page_id").alias("pos"), "url", extract.page_title(F.col("html")).alias("title"), F.length("html").cast("double").alias("score")))


@query(f"""
WITH t AS (SELECT page_id, url, {_TITLE} AS title FROM pages)
SELECT page_id, title, url AS link, CASE WHEN page_id % 4 = 1 THEN '' WHEN page_id % 3 = 0 THEN '' ELSE 'a "q" ' || page_id END AS snippet FROM t WHERE title <> ''""")
def source_answers(spark, sf_dir):
    """Rows of a source's answers: JSON, or on every fourth page text that isn't JSON."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", extract.page_title(F.col("html")).alias("title"))
    item = F.struct("title", F.col("url").alias("link"), F.when(F.col("page_id") % 3 != 0, F.concat(F.lit('a "q" '), F.col("page_id").cast("string"))).alias("snippet"))
    whole = F.to_json(F.struct(F.array(item, F.struct(F.lit("no link").alias("title"), F.lit(None).cast("string").alias("link"), F.lit(None).cast("string").alias("snippet"))).alias("items")))
    torn = F.concat(F.lit('{"items": [{"title": "'), F.col("title"), F.lit('", "link": "'), F.col("url"), F.lit('"}'))
    return p.select("page_id", F.inline(hits_of_json(F.when(F.col("page_id") % 4 == 1, torn).otherwise(whole))))


@query(f"SELECT page_id, length(substr(repeat(html, 40), 1, 150000)) AS kept FROM pages")
def page_bodies(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(page_body(F.repeat("html", 40))).cast("long").alias("kept"))


_OWN = "regexp_extract(url, '^[a-zA-Z]+://([^/:?#]*)', 1)"
_ABS = "CASE WHEN regexp_matches(h, '^https?://') THEN h WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL WHEN starts_with(h, '//') THEN regexp_extract(url, '^[a-z]+:') || h WHEN starts_with(h, '/') THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || h ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || h END"


@query(f"""
WITH l AS (SELECT page_id, url, unnest({_HREFS}) AS h, generate_subscripts({_HREFS}, 1) AS i FROM pages), a AS (SELECT page_id, {_OWN} AS own, {_ABS} AS u, i FROM l),
s AS (SELECT page_id, u, min(i) AS i FROM a WHERE regexp_extract(u, '^[a-zA-Z]+://([^/:?#]*)', 1) = own OR ends_with(regexp_extract(u, '^[a-zA-Z]+://([^/:?#]*)', 1), '.' || own) GROUP BY page_id, u)
SELECT page_id, count(s.u) AS n, coalesce(string_agg(s.u, ' ' ORDER BY s.i), '') AS links FROM pages LEFT JOIN s USING (page_id) GROUP BY page_id""")
def same_site_links(spark, sf_dir):
    links = cards.same_site_links(F.col("html"), F.col("url"), extract.hrefs(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("n"), F.array_join(links, " ").alias("links"))


def subpages_of(html: Column, url: Column, most: int = 30) -> Column:
    """array<struct<url, title>>: links of the same host (case apart), without fragment and slashes at the end, the page itself apart, each once.

    The title is the link's text, or its target.
    """
    link = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    bare = lambda u: F.regexp_replace(F.regexp_replace(F.trim(u), "#.*$", ""), "/+$", "")
    both = F.arrays_zip(F.regexp_extract_all(text.text_of(html), F.lit(link), F.lit(1)).alias("h"), F.regexp_extract_all(text.text_of(html), F.lit(link), F.lit(2)).alias("t"))
    made = F.transform(both, lambda z: F.struct(bare(text.url_resolve(url, z["h"])).alias("url"), text.squeeze(F.regexp_replace(z["t"], "<[^>]+>", " ")).alias("title")))
    kept = F.filter(made, lambda s: s["url"].isNotNull() & (F.lower(text.url_host(s["url"])) == F.lower(text.url_host(url))) & (s["url"] != bare(url)))
    urls = F.transform(kept, lambda s: s["url"])
    once = F.slice(F.filter(kept, lambda s, i: F.array_position(urls, s["url"]) == i + 1), 1, most)
    return F.transform(once, lambda s: F.struct(s["url"].alias("url"), F.when(s["title"] == "", s["url"]).otherwise(s["title"]).alias("title")))


@query()
def subpage_crawl(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.inline(subpages_of(F.col("html"), F.col("url"))))


#: Hosts and boxes of the card forms, added by page.
CARD_HOSTS = ["https://ticket.com.tw/a/", "https://www.accupass.com/", "https://x.kktix.cc/", "https://www.opentix.life/e", "https://tixcraft.com/", "https://b.example.com/c"]
CARD_PAGES = [
    '<div class="event-box"><a href="/UTK{0}"><h3> One  {0}</h3></a> 2024/05/06 x</div><div class="item"><a href="u2"><img alt="Picture {0}"></a>5月6日</div><div class="item">none</div><div class="card"><a href="u3" title="T">tiny</a></div>',
    '<a href="/a{0}"> <img src="i" alt="Fallback {0}"></a><a href="/b"><img alt="Site LOGO"></a>',
    '<a href="/event/{0}"><span><b></b></span>Span title {0}</a><a href="/event/{0}">again it is</a><a class="x" href="/event/9">abc</a><p>later text here</p>',
    '<a href="/events/{0}">   </a><p>Near {0} text</p><a href="/event/b{0}"><i>bold</i> words</a> <a href="/events/{0}">again</a>', '<a href="/activity/detail/{0}"><h2>Show {0}</h2></a>' + "word " * 50,
    '<a href="/concert/{0}">A concert {0}</a>',
]


def card_pages(spark, sf_dir) -> DataFrame:
    n = F.col("page_id")
    pick = lambda forms, by: F.get(F.array(*map(F.lit, forms)), by.cast("int"))
    html = F.replace(pick(CARD_PAGES, n % len(CARD_PAGES)), F.lit("{0}"), n.cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", pick(CARD_HOSTS, F.floor(n / len(CARD_PAGES)) % len(CARD_HOSTS)).alias("url"), html.alias("html"))


@query()
def event_cards(spark, sf_dir):
    return card_pages(spark, sf_dir).select("page_id", F.inline(cards.event_cards(F.col("html"), F.col("url"))))


@query(f"""
WITH h AS (SELECT page_id, {_made_sql(_MAINS)} AS h FROM pages)
SELECT page_id, CASE page_id % {len(_MAINS)} WHEN 0 THEN '' WHEN 1 THEN 'Main ' || page_id || ' bold' WHEN 2 THEN 'Div ' || page_id ELSE 'picture ' || page_id END AS content FROM h""")
def page_content_forms(spark, sf_dir):
    """The text of pages without an article: a main element, a div of content, images."""
    return table(spark, sf_dir, "pages").select("page_id", extract.main_text(_made(_MAINS)).alias("content"))


@query(f"""
WITH h AS (SELECT page_id, {_made_sql(_METAS)} || {_made_sql(_LDS)} AS h FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'One ' || page_id WHEN 2 THEN 'Two ' || page_id WHEN 3 THEN 'Three ' || page_id ELSE 'Instagram' END AS title,
  concat_ws(' ', CASE page_id % 5 WHEN 1 THEN 'One ' || page_id WHEN 2 THEN 'Two ' || page_id WHEN 3 THEN 'Three ' || page_id END, CASE page_id % 3 WHEN 1 THEN 'A ' || page_id || ' B' WHEN 2 THEN 'C D ' || page_id END) AS content
FROM h WHERE page_id % 5 IN (1, 2, 3) OR page_id % 3 > 0""")
def social_pages(spark, sf_dir):
    """Title and text of a social page from its metadata; one without any, or that asks to log in, gives none."""
    p = table(spark, sf_dir, "pages").select("page_id", social_text(F.concat(_made(_METAS), _made(_LDS))).alias("s"))
    return p.filter("s IS NOT NULL").select("page_id", "s.title", "s.content")


def social_text(html: Column) -> Column:
    """struct<title, content> of a social page's metadata, or null."""
    title, about, more = extract.meta(html, "og:title"), extract.meta(html, "og:description"), extract.json_ld_text(html)
    content = text.join_parts(title, about, more)
    wall = F.contains(text.text_of(html), F.lit("loginForm")) | F.contains(text.text_of(html), F.lit("Login • Instagram"))
    return F.when(~wall & (content != ""), F.struct(F.coalesce(F.nullif(title, F.lit("")), F.lit("Instagram")).alias("title"), content.alias("content")))


@query("SELECT page_id, length(html)::DOUBLE AS score, row_number() OVER (ORDER BY length(html) DESC, page_id)::INT AS place FROM pages QUALIFY place <= 20")
def top_pages(spark, sf_dir):
    """The twenty pages with the highest score: a partial top-k in every task, then one over those."""
    best = table(spark, sf_dir, "pages").select("page_id", F.length("html").cast("double").alias("score")).orderBy(F.col("score").desc(), "page_id").limit(20)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), "page_id")))


@query("SELECT regexp_replace(regexp_replace(lower(url), '^.*?://', ''), '/.*$', '') AS domain, sum(length(html))::DOUBLE AS total, row_number() OVER (ORDER BY sum(length(html)) DESC, domain)::INT AS place FROM pages GROUP BY domain QUALIFY place <= 20")
def top_sites(spark, sf_dir):
    sites = table(spark, sf_dir, "pages").groupBy(text.url_domain(F.col("url")).alias("domain")).agg(F.sum(F.length("html")).cast("double").alias("total"))
    return sites.orderBy(F.col("total").desc(), "domain").limit(20).withColumn("place", F.row_number().over(Window.orderBy(F.col("total").desc(), "domain")))


# Keywords

_WEIGHT = "coalesce(CASE lower({0}) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dicts.PREDEFINED_WEIGHTS) + " END, 1.0)::DOUBLE"
_CALLED = ["event", "Concert", "the", "FESTIVAL", "音樂", "x"]
_CALL = "CASE listing_id % 6 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_CALLED)) + " END"


@query(f"{LISTED} SELECT listing_id, {_WEIGHT.format(_CALL)} AS weight, {_WEIGHT.format('type_txt')} AS type_weight FROM listing")
def keyword_weights(spark, sf_dir):
    called = F.get(F.array(*map(F.lit, _CALLED)), (F.col("listing_id") % 6).cast("int"))
    return listing(spark, sf_dir).select("listing_id", keywords.weight(called).alias("weight"), keywords.weight(F.col("type_txt")).alias("type_weight"))


_BASE = " + ".join(f"CASE WHEN contains(lower(title || ' ' || body_txt), '{w.lower()}') THEN {n} * ((length(lower(title || ' ' || body_txt)) - length(replace(lower(title || ' ' || body_txt), '{w.lower()}', ''))) / {len(w)}) + CASE WHEN contains(lower(title), '{w.lower()}') THEN 5 ELSE 0 END ELSE 0 END" for w, n in (("展覽", 5), ("市集", 3), ("NT", 1), ("2023", 1)))


@query(f"{LISTED} SELECT listing_id, ({_BASE})::DOUBLE AS score, (score + 0.3 * (listing_id % 3 + 1.5))::DOUBLE AS total FROM listing".replace("(score + 0.3", "(listing.score + 0.3"))
def subpage_base_score(spark, sf_dir):
    toks = F.array(*map(F.lit, ("展覽", "市集", "NT", "2023")))
    subs = F.array((F.col("listing_id") % 3).cast("double"), F.lit(None).cast("double"), F.lit(1.5))
    return listing(spark, sf_dir).select("listing_id", keywords.base_score(F.col("title"), F.col("body_txt"), toks).alias("score"), keywords.page_total(F.col("score"), subs).alias("total"))


_FOUND = f"list_filter({words([*dicts.DERIVED_EVENT_WORDS, *dicts.DERIVED_PLACE_WORDS])}, lambda w: contains(title || ' ' || body_txt, w) AND NOT list_contains(['展覽', '台北'], w))"


@query(f"""{LISTED}, w AS (SELECT listing_id % 20 AS query_id, unnest({_FOUND}) AS word FROM listing), n AS (SELECT query_id, word, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, word) AS place FROM n QUALIFY place <= 3""")
def derived_keywords(spark, sf_dir):
    rows = listing(spark, sf_dir).withColumn("query_id", F.col("listing_id") % 20)
    return keywords.derived(rows, F.concat_ws(" ", "title", "body_txt"), F.array(F.lit("展覽"), F.lit("台北")))


_LISTED_WORDS = [(k, k) for k in dicts.RELATED_KEYWORDS] + [(w, w.lower()) for v in dicts.RELATED_KEYWORDS.values() for w in v]
_SAID = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(title), '{key}') THEN '{w}' END" for w, key in _LISTED_WORDS) + "], lambda x: x IS NOT NULL)"


@query(f"""{LISTED}, w AS (SELECT listing_id % 20 AS query_id, unnest(list_concat({_SAID}, ['市集', 'taipei'])) AS word FROM listing), n AS (SELECT query_id, word, count(*) AS n FROM w GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, word) AS place FROM n QUALIFY place <= 5""")
def related_keywords(spark, sf_dir):
    return _related(spark, sf_dir)


def _related(spark, sf_dir) -> DataFrame:
    rows = listing(spark, sf_dir).withColumn("query_id", F.col("listing_id") % 20)
    return keywords.related(rows, F.col("title"), F.array(F.lit("市集"), F.lit("taipei")))


_GROUPS = "groups(word, members) AS (VALUES " + ", ".join(f"('{m}', {words([k, *v])})" for k, v in dicts.RELATED_KEYWORDS.items() for m in dict.fromkeys([k, *v])) + ")"


@query(f"""WITH {_GROUPS}, asked AS (SELECT query_id, unnest(CASE query_id % 3 WHEN 0 THEN ['音樂', '市集'] WHEN 1 THEN ['展覽'] ELSE ['nothing'] END) AS word FROM range(6) t(query_id)),
more AS (SELECT DISTINCT query_id, unnest(members) AS word FROM asked JOIN groups USING (word)), new AS (SELECT * FROM more WHERE (query_id, word) NOT IN (SELECT query_id, word FROM asked)),
few AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY word) AS place FROM new WHERE NOT contains('找展覽 ' || query_id, lower(word)) QUALIFY place <= 3)
SELECT query_id, concat_ws(' ', '找展覽 ' || query_id, string_agg(few.word, ' ' ORDER BY place)) AS expanded FROM range(6) t(query_id) LEFT JOIN few USING (query_id) GROUP BY query_id""")
def expanded_queries(spark, sf_dir):
    q = spark.range(6).select(F.col("id").alias("query_id"), F.concat(F.lit("找展覽 "), F.col("id").cast("string")).alias("query"))
    said = q.select("query_id", F.explode(F.when(F.col("query_id") % 3 == 0, F.array(F.lit("音樂"), F.lit("市集"))).when(F.col("query_id") % 3 == 1, F.array(F.lit("展覽"))).otherwise(F.array(F.lit("nothing")))).alias("word"))
    return keywords.expanded(q, keywords.suggested(said))


@query("SELECT category AS category, unnest(words) AS word FROM (VALUES " + ", ".join(f"('{k}', {words(v)})" for k, v in dicts.CATEGORY_EXPANSIONS.items()) + ") AS t(category, words)")
def category_expansions(spark, sf_dir):
    known = spark.range(1).select(F.explode(F.array(*map(F.lit, [*dicts.CATEGORY_EXPANSIONS, "none"]))).alias("category"))
    return known.select("category", F.explode(requests.category_words(F.col("category"))).alias("word"))


# Pieces of text, and the rest of the predicates

@query(f"""{LISTED} SELECT listing_id, concat_ws(' ', nullif(trim(city_txt), ''), nullif(trim(' ' || type_txt || ' '), '')) AS joined,
  replace(replace(replace(replace(replace(replace('&nbsp;&lt;' || type_txt || '&gt;&quot;&#39;&amp;lt;', '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS decoded,
  'a ' || type_txt || ' b/c"d' || chr(92) || 'e' AS unescaped,
  least(2.0, 1.0 + 0.2 * ((contains(lower(title), '台北展覽') OR contains(lower(title), '台北 展覽'))::INT + (contains(lower(title), '展覽2') OR contains(lower(title), '展覽 2'))::INT))::DOUBLE AS proximity,
  {anyof("lower(city_txt || '.gov.tw')", dicts.AUTHORITY_DOMAINS)} AS authority,
  (listing_id % 40 BETWEEN 21 AND 26.5 AND listing_id % 130 BETWEEN 119 AND 122.5) AS in_box,
  CASE WHEN trim(city_txt) = '' THEN '台北' WHEN listing_id % 5 = 0 THEN NULL ELSE trim(city_txt) END AS valid_city FROM listing""")
def text_pieces(spark, sf_dir):
    city, kind, n = F.col("city_txt"), F.col("type_txt"), F.col("listing_id")
    return listing(spark, sf_dir).select(
        "listing_id", text.join_parts(city, F.concat(F.lit(" "), kind, F.lit(" "))).alias("joined"), text.decode_entities(F.concat(F.lit("&nbsp;&lt;"), kind, F.lit("&gt;&quot;&#39;&amp;lt;"))).alias("decoded"),
        text.json_unescape(F.concat(F.lit("a\\n"), kind, F.lit('\\tb\\/c\\"d\\\\e'))).alias("unescaped"), ranking.proximity_bonus(F.col("title"), F.array(F.lit("台北"), F.lit("展覽"), F.lit("2"))).alias("proximity"),
        extract.authority(F.concat(city, F.lit(".gov.tw"))).alias("authority"), extract.in_box((n % 40).cast("double"), (n % 130).cast("double")).alias("in_box"),
        extract.valid_city(F.when((n % 5 == 0) & (F.trim(city) != ""), F.concat(city, F.lit("<script>"))).otherwise(city)).alias("valid_city"),
    )


@query(f"""{LISTED} SELECT listing_id, (contains(lower(title), '展覽') OR contains(lower(title), 'taipei')) AS relevant,
  CASE WHEN (listing_id % 9)::INT = 0 THEN '' ELSE array_to_string(range(greatest(1, least((listing_id % 4 + 1)::INT - 2, (listing_id % 9)::INT - 4)), least((listing_id % 9)::INT, greatest(1, least((listing_id % 4 + 1)::INT - 2, (listing_id % 9)::INT - 4)) + 4) + 1), ' ') END AS numbers,
  coalesce(CASE type_txt WHEN 'x' THEN 'y' END, CASE listing_id % 3 WHEN 0 THEN '台北' WHEN 1 THEN '타이중x' ELSE '新竹' END) AS city FROM listing""")
def page_windows(spark, sf_dir):
    n = F.col("listing_id")
    numbers = page_numbers((n % 4 + 1).cast("int"), (n % 9).cast("int"))
    name = F.when(n % 3 == 0, "Taipei").when(n % 3 == 1, "타이중x").otherwise("Hsinchu")
    return listing(spark, sf_dir).select("listing_id", relevant(F.col("title"), F.array(F.lit("展覽"), F.lit("Taipei"))).alias("relevant"), F.array_join(numbers.cast("array<string>"), " ").alias("numbers"), local_city(name).alias("city"))


_TAILS = [' & "a"', "; x", "", " 展覽！"]
_SAYS = "(city_txt || CASE listing_id % 4 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TAILS)) + " END)"


@query(f"""{LISTED}, q AS (SELECT listing_id, {_SAYS} AS q FROM listing), p AS (SELECT *, CASE WHEN length(trim(q)) < 2 THEN 'short' WHEN contains(q, ';') THEN 'sql' ELSE '' END AS problem FROM q)
SELECT listing_id, problem = '' AS valid, problem, CASE WHEN problem = '' THEN replace(replace(trim(q), '&', '&amp;'), '"', '&quot;') END AS value,
  regexp_matches(q, '^[\u4e00-\u9fff\u3400-\u4dbfa-zA-Z0-9 _.，。、！？-]+$') AS allowed FROM p""")
def checked_queries(spark, sf_dir):
    q = F.concat("city_txt", F.get(F.array(*map(F.lit, _TAILS)), (F.col("listing_id") % 4).cast("int")))
    return listing(spark, sf_dir).select("listing_id", q.alias("q")).select("listing_id", F.inline(F.array(extract.checked_query(F.col("q")))), extract.allowed_characters(F.col("q")).alias("allowed"))


_TEXTS = [("zh", "a", "甲"), ("zh", "b", "乙"), ("en", "a", "A"), ("en", "b", "")]


@query("""WITH t(lang, key, text) AS (VALUES """ + ", ".join(map(str, _TEXTS)) + """), q AS (SELECT l AS lang, k AS key FROM (VALUES ('zh'), ('en'), ('ja')) a(l), (VALUES ('a'), ('b'), ('c')) b(k)),
s AS (SELECT *, CASE WHEN lang IN (SELECT lang FROM t) THEN lang ELSE 'zh' END AS spoken FROM q)
SELECT s.lang AS lang, s.key AS key, coalesce(nullif(t.text, ''), s.key) AS text FROM s LEFT JOIN t ON t.lang = s.spoken AND t.key = s.key""")
def translations(spark, sf_dir):
    asked = spark.sql("SELECT lang, key FROM VALUES ('zh'), ('en'), ('ja') AS a(lang) LATERAL VIEW explode(array('a', 'b', 'c')) AS key")
    return translated(asked, spark.createDataFrame(_TEXTS, "lang string, key string, text string").coalesce(1), "zh")


@query()
def page_pairs(spark, sf_dir):
    """Similarity of neighbouring pages by title and by the SimHash of title and content."""
    p = table(spark, sf_dir, "pages").select("page_id", text.url_domain(F.col("url")).alias("host"), extract.page_title(F.col("html")).alias("title"), extract.main_text(F.col("html")).alias("content"))
    p = p.withColumn("hash", dedup.simhash_of(text.hash_content(F.col("title"), F.col("content"))))
    w = Window.partitionBy("host").orderBy("page_id")
    both = p.select("page_id", "title", "hash", F.lag("title").over(w).alias("other"), F.lag("hash").over(w).alias("other_hash")).filter("other IS NOT NULL")
    both = both.repartition(partitions(table(spark, sf_dir, "pages")), "page_id")  # a hot host is one task up to here
    similar = text.page_similarity(text.title_similarity(F.col("title"), F.col("other")), text.hamming(F.col("hash"), F.col("other_hash")))
    return both.select("page_id", F.round(similar, 6).alias("similarity"))


@query(f"""{_INFO}, n AS (SELECT p.listing_id, CASE WHEN p.listing_id % 2 = 0 THEN l.day END AS day, CASE WHEN city_txt = '台北' THEN '全台' ELSE nullif(city_txt, '') END AS town, p.* EXCLUDE (listing_id) FROM points p JOIN listing l USING (listing_id))
SELECT listing_id, coalesce(day, a) AS date, CASE WHEN town IS NULL OR town = '全台' THEN coalesce(city, town) ELSE town END AS city,
  round(0.2 * completeness + CASE WHEN low IS NOT NULL OR free THEN 5 ELSE 0 END + CASE WHEN v IS NOT NULL THEN 3 ELSE 0 END, 4) AS bonus FROM n""")
def fact_updates(spark, sf_dir):
    """Facts fill a missing date, and a city that is missing or general."""
    town = F.when(F.col("city_txt") == "台北", "全台").otherwise(F.nullif("city_txt", F.lit("")))
    rows = listing(spark, sf_dir).select(
        "listing_id", F.concat("title", "body_txt").alias("title"), F.lit(None).cast("string").alias("content"), F.when(F.col("listing_id") % 2 == 0, F.col("day")).alias("event_date"), town.alias("city"),
    )
    return informed(rows, F.lit(TODAY).cast("date")).select("listing_id", F.col("event_date").alias("date"), "city", F.round("bonus", 4).alias("bonus"))
