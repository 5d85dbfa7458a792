"""The ranked search over crawled pages, end to end, and its single steps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import cards, dates, dicts, extract, requests, text
from quillspark.operators import dedup, ranking, tfidf
from quillspark.sources.hits import page_body, source_limit

from .catalog import TODAY, query, table
from .pages import _DOMAIN, _HREFS, _TITLE

HITS, CRAWLED, CARD_POINTS, LINKS, TITLE_MOST, SNIPPET_MOST = 20, 5, 5.0, 4, 60, 160
NOWHERE = "全台"


def few(df: DataFrame, **columns: Column) -> DataFrame:
    """``df``, of some rows, with columns that are computed once a row and without generated code.

    Compiling these expressions takes longer than evaluating them for the rows of a request.
    """
    return df.select("*", F.inline(F.transform(F.array(F.lit(0)), lambda _: F.struct(*(c.alias(n) for n, c in columns.items())))))


def requests_of(spark: SparkSession, ask: list[str]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(i).cast("long").alias("query_id"), F.lit(q).alias("query")) for i, q in enumerate(ask)))
    return spark.range(1).select(F.inline(rows))


def effective_city(query: Column, user_city: Column) -> Column:
    """The request's city, else the user's."""
    return F.coalesce(requests.city_of(query), F.nullif(user_city, F.lit("")))


def once(c: Column, f) -> Column:
    """``f`` of a column that it uses often: bound as a lambda's argument, so that the expression stays small."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def source_query(query: Column, user_city: Column, today: Column) -> Column:
    """What the source is asked: with the user's city if none is said, expanded and refined."""
    said = once(query, lambda q: F.when(requests.city_of(q).isNull() & user_city.isNotNull(), F.concat_ws(" ", user_city, q)).otherwise(q))
    return once(once(said, lambda q: requests.expand(q, today)), lambda q: requests.refine(q, today))


def hits_of(pages: DataFrame, asked: DataFrame, most: int = HITS) -> DataFrame:
    """Pages (pos, url, html) as a source's hits: a title of 60 characters, a snippet of 160; ``pos`` is the place.

    Only titles are read of all pages; nothing else is computed before the source's limit.
    """
    titled = pages.select("pos", "url", "html", text.truncate(extract.page_title(F.col("html")), TITLE_MOST).alias("title"))
    limited = source_limit(titled, asked, most).withColumn("pos", F.col("place").cast("long")).drop("place", "found")
    return few(limited, crawled_title=extract.page_title(F.col("html")), body=extract.main_text(page_body(F.col("html")))).withColumn("snippet", F.col("body").substr(1, SNIPPET_MOST))


def admitted(candidates: DataFrame) -> DataFrame:
    return candidates.filter(~extract.excluded(F.col("url")) & ~extract.travel_spam(F.col("title")) & ~extract.likely_foreign(F.col("title")))


def nodes(kept: DataFrame, today: Column) -> DataFrame:
    """Domain, date and city of each hit, from its title or else its snippet, which is its content."""
    placed = kept.withColumn("order", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")))
    return few(
        placed, domain=text.url_domain(F.col("url")), event_date=F.coalesce(dates.parse_date(F.col("title"), today), dates.parse_date(F.col("snippet"), today)),
        city=F.coalesce(text.city_in(F.col("title")), text.city_in(F.col("snippet"))), toks=text.query_tokens(F.col("query")), content=F.col("snippet"),
    )


def relevant(title: Column, tokens: Column) -> Column:
    """Whether any token is in the title."""
    t = F.lower(text.text_of(title))
    return F.exists(F.coalesce(tokens, F.array().cast("array<string>")), lambda w: F.contains(t, F.lower(w)))


_SUB = "array<struct<url:string,title:string,content:string,score:double>>"


def crawled(found: DataFrame, today: Column, most: int = CRAWLED) -> DataFrame:
    """Merges what a crawl of the first ``most`` hits gives; a page of a social site keeps its snippet.

    The longer title and the page's text are taken, a missing date and city filled in from both; relevant cards
    (20 at most, 5 points each) and the first four links of the site become sub-pages.
    """
    first, social = F.col("order") <= most, extract.social(F.col("domain"))
    both = F.concat_ws(" ", "crawled_title", "body")
    said = F.when(social, F.col("snippet")).otherwise(both)
    listed = F.filter(cards.event_cards(F.col("html"), F.col("url")), lambda c: relevant(c["title"], F.col("toks")))
    links = F.slice(cards.same_site_links(F.col("html"), F.col("url"), extract.hrefs(F.col("html"))), 1, LINKS)
    sub = lambda url, title, content, score: F.struct(url.alias("url"), title.alias("title"), content.alias("content"), F.lit(score).alias("score"))
    subs = F.concat(
        F.transform(listed, lambda c: sub(c["url"], c["title"], F.concat(c["date"], F.lit(" ")), CARD_POINTS)), F.transform(links, lambda u: sub(u, text.url_title(u), F.lit(""), 0.0)),
    )
    merged = few(
        found,
        new_title=F.when(first & ~social & (F.length("crawled_title") > F.length("title")), F.col("crawled_title")).otherwise(F.col("title")),
        new_content=F.when(first & ~social, F.col("body")).otherwise(F.col("content")),
        new_date=F.coalesce("event_date", F.when(first, dates.parse_date(said, today))),
        new_city=F.when(first & (F.col("city").isNull() | (~social & (F.col("city") == NOWHERE))), F.coalesce(text.city_in(said), F.col("city"))).otherwise(F.col("city")),
        subs=F.when(first & ~social, subs).otherwise(F.array().cast(_SUB)),
    )
    plain = merged.drop("title", "content", "event_date", "city", "html", "body", "snippet", "crawled_title", "order")
    return plain.withColumnsRenamed({"new_title": "title", "new_content": "content", "new_date": "event_date", "new_city": "city"})


def informed(found: DataFrame, today: Column) -> DataFrame:
    """Facts of title and content: their bonus, and a date and a city where those are missing or general."""
    info = extract.event_info(F.concat_ws(" ", "title", "content"), today)
    told = lambda i: F.struct(i["start_date"].alias("day"), i["city"].alias("town"), ranking.completeness_bonus(i).alias("bonus"))
    full = found.select("*", F.inline(F.transform(F.transform(F.array(F.lit(0)), lambda _: info), told)))
    city = F.when(F.col("city").isNull() | (F.col("city") == NOWHERE), F.coalesce("town", F.col("city"))).otherwise(F.col("city"))
    return full.withColumn("event_date", F.coalesce("event_date", "day")).withColumn("city", city).drop("day", "town")


def with_tfidf(found: DataFrame) -> DataFrame:
    """Adds ``points``: TF-IDF of title (three times) and content within each request's pages, the best of them 30.

    Counts of the request's terms are arrays, and a window over one request's pages, which the source's limit bounds,
    holds them all: no join back, so what comes before is planned and run once.
    """
    parts = F.concat(F.flatten(F.array_repeat(text.tokens(F.col("title")), 3)), text.tokens(F.col("content")))
    asked = text.tokens(F.col("query"))
    split = few(found, words=parts, terms=F.array_distinct(asked), all_terms=asked)
    times = F.transform("terms", lambda t: F.size(F.filter("words", lambda w: w == t)))
    counted = few(split, counts=times, asked=F.transform("terms", lambda t: F.size(F.filter("all_terms", lambda w: w == t))))
    whole = counted.withColumn("every", F.collect_list("counts").over(Window.partitionBy("query_id")))

    def part(term: Column, i: Column) -> Column:
        n = F.get(F.col("counts"), i)
        df = F.size(F.filter("every", lambda c: F.get(c, i) > 0))
        return F.when(n > 0, tfidf.log_tf(n) * tfidf.idf(df, F.size("every"), term) * F.get(F.col("asked"), i)).otherwise(0.0)

    scored = few(whole, raw=F.aggregate(F.transform("terms", part), F.lit(0.0), lambda x, y: x + y))
    best = F.max("raw").over(Window.partitionBy("query_id"))
    return scored.withColumn("points", F.col("raw") / F.when(best < 0.001, 1.0).otherwise(best) * 30.0).drop("words", "terms", "all_terms", "counts", "asked", "every", "raw")


_PROMOTED = "query_id long, query string, toks array<string>, place long, is_sub boolean, points double, url string, title string, content string, score double, event_date date, city string, domain string"


def promoted(pages: DataFrame, today: Column) -> DataFrame:
    """Relevant sub-pages become pages before their parent, each target once for a request.

    A parent stays if none of its own was promoted, or if its title says half of the tokens; a target that stands
    already isn't listed again.  The order is a fold over one request's pages, which the source's limit bounds.
    """
    scored = few(
        pages, relevance=F.transform("subs", lambda s: ranking.subpage_relevance(s["title"], s["content"], s["url"], F.col("toks"))), own=ranking.parent_relevant(F.col("title"), F.col("toks")),
    ).select("query_id", "query", "toks", "pos", "url", "title", "content", "score", "event_date", "city", "domain", "subs", "relevance", "own")

    def elect(f: pd.DataFrame) -> pd.DataFrame:
        seen, out = set(), []
        for r in f.sort_values("pos").itertuples():
            both = (r.score, r.event_date, r.city, r.domain)
            up = [(s, p) for s, p in zip(r.subs, r.relevance) if p >= 1 and s["url"] not in seen and not seen.add(s["url"])]
            out += [(r.query_id, r.query, r.toks, len(out) + i, True, p, s["url"], s["title"], s["content"], *both) for i, (s, p) in enumerate(up)]
            if (not up or r.own) and r.url not in seen:
                seen.add(r.url)
                out.append((r.query_id, r.query, r.toks, len(out), False, 0.0, r.url, r.title, r.content, *both))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PROMOTED.split(", ")])

    rows = scored.groupBy("query_id").applyInPandas(elect, _PROMOTED)
    said = F.concat_ws(" ", "title", "content")
    made = few(
        rows, sub_date=F.when(F.col("is_sub"), dates.parse_date(said, today)), sub_city=F.when(F.col("is_sub"), text.city_in(said)), sub_domain=F.when(F.col("is_sub"), text.url_domain(F.col("url"))),
    )
    final = {
        "score": F.when(F.col("is_sub"), F.col("score") * 0.5 + F.col("points") * 2).otherwise(F.col("score")), "event_date": F.when(F.col("is_sub"), F.col("sub_date")).otherwise(F.col("event_date")),
        "city": F.coalesce("sub_city", "city"), "domain": F.coalesce("sub_domain", "domain"), "pos": F.col("place"),
    }
    return made.withColumns(final).drop("sub_date", "sub_city", "sub_domain", "is_sub", "points", "place")


def totals(pages: DataFrame, today: Column, user_city: Column) -> DataFrame:
    """Final scores of each request's pages in the order of ``pos``."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    ready = few(pages.withColumn("place", place), when=requests.query_range(F.col("query"), today), near=effective_city(F.col("query"), user_city))
    total = ranking.final_score(
        F.col("score"), ranking.text_score(F.col("title"), F.col("content"), F.col("query"), F.col("toks")), ranking.date_score(F.col("event_date"), today, F.col("when")),
        ranking.freshness(F.col("place")), ranking.multiplier(F.col("title"), F.col("url"), F.col("city"), F.col("event_date"), F.col("near"), today),
    )
    return few(ready, total=total).drop("score", "when", "near", "place").withColumnRenamed("total", "score")


def candidates(pages: DataFrame, asked: DataFrame, today: Column, most: int = HITS, crawl: int = CRAWLED) -> DataFrame:
    return crawled(nodes(admitted(hits_of(pages, asked, most)), today), today, crawl)


def first_totals(pages: DataFrame, asked: DataFrame, today: Column, user_city: Column, most: int = HITS) -> DataFrame:
    """Source limit, admission, nodes, crawl of the first five, TF-IDF and facts, dedup, promotion, final scores."""
    full = informed(candidates(pages, asked, today, most), today)
    scored = with_tfidf(full).withColumn("score", F.col("points") + F.col("bonus")).drop("bonus", "points")
    return totals(promoted(dedup.deduplicate(scored), today), today, user_city)


def search(pages: DataFrame, asked: DataFrame, today: Column, user_city: Column, page: int = 1, most: int = HITS) -> DataFrame:
    """One page of ranked results of each request (query_id, query) over pages (pos, url, html).

    After the source's limit, every step has ``most`` rows a request.
    """
    ranked = ranking.normalise(first_totals(pages, asked, today, user_city, most))
    paged = ranking.paginate(ranked, F.lit(page), order=(F.col("score").desc(), F.col("pos")))
    return paged.select("query_id", "rank", "title", "url", "domain", "score", "city", F.coalesce(F.date_format("event_date", "yyyy-MM-dd"), F.lit("")).alias("event_date"), "total_count", "total_pages")


ASK = ["the of with", "und der die", "台北展覽", "rather long request about things"]


def _pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), "url", "html")


@query()
def ranked_search(spark, sf_dir):
    return search(_pages(spark, sf_dir), requests_of(spark, ASK), F.lit(TODAY).cast("date"), F.lit("台北"))


_ASKED = "asked(query_id, query) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(ASK)) + ")"


@query(f"""
WITH {_ASKED}, t AS (SELECT page_id, url, CASE WHEN length({_TITLE}) > {TITLE_MOST} THEN substr({_TITLE}, 1, {TITLE_MOST}) || '...' ELSE {_TITLE} END AS title FROM pages),
f AS (SELECT query_id, page_id, url, title, len(list_filter(string_split_regex(lower(query), ' +'), lambda w: contains(lower(title), w))) AS found FROM t, asked)
SELECT query_id, url, title, row_number() OVER (PARTITION BY query_id ORDER BY found DESC, page_id) AS place FROM f WHERE found > 0 QUALIFY place <= {HITS}""")
def search_source(spark, sf_dir):
    titled = _pages(spark, sf_dir).select("pos", "url", text.truncate(extract.page_title(F.col("html")), TITLE_MOST).alias("title"))
    return source_limit(titled, requests_of(spark, ASK)).select("query_id", "url", "title", "place")


_SUBS = f"""
WITH p AS (SELECT page_id, url, {_TITLE} AS title, {_HREFS} AS hs FROM pages),
l AS (SELECT page_id, title, unnest(hs) AS href, generate_subscripts(hs, 1) AS ord FROM p),
d AS (SELECT page_id, title, href, min(ord) AS ord FROM l GROUP BY ALL),
t AS (SELECT *, translate(regexp_extract(href, '([^/]*)$', 1), '-_', '  ') AS sub FROM d),
r AS (SELECT page_id, href, ord, title,
  (CASE WHEN contains(lower(sub), 'en') THEN 3 ELSE 0 END + CASE WHEN contains(lower(href), 'en') THEN 1 ELSE 0 END + CASE WHEN contains(lower(sub), '1') THEN 3 ELSE 0 END + CASE WHEN contains(lower(href), '1') THEN 1 ELSE 0 END
   + CASE WHEN contains(lower(sub), 'en') AND contains(lower(sub), '1') THEN 2 ELSE 0 END)::DOUBLE AS relevance FROM t)
"""
_TOKS = ["en", "1"]


def _subpages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", extract.page_title(F.col("html")).alias("title"), F.posexplode(extract.hrefs(F.col("html"))).alias("o", "href"))
    d = p.groupBy("page_id", "title", "href").agg((F.min("o") + 1).alias("ord"))
    toks = F.array(*map(F.lit, _TOKS))
    return d.withColumn("relevance", ranking.subpage_relevance(text.url_title(F.col("href")), F.lit(""), F.col("href"), toks)).withColumn("parent", ranking.parent_relevant(F.col("title"), toks))


@query(_SUBS + "SELECT page_id, href, relevance FROM r")
def subpage_relevance(spark, sf_dir):
    return _subpages(spark, sf_dir).select("page_id", "href", "relevance")


@query(_SUBS + """, g AS (SELECT page_id, href, ord, relevance, row_number() OVER (PARTITION BY href ORDER BY page_id, ord) AS seen FROM r WHERE relevance >= 1),
s AS (SELECT page_id, ord AS sub_pos, href AS target, 50 * 0.5 + 2 * relevance AS score FROM g WHERE seen = 1)
SELECT page_id, sub_pos, target, score::DOUBLE AS score FROM s
UNION ALL SELECT page_id, 1000000, '', 50.0 FROM (SELECT DISTINCT page_id, title FROM r) x WHERE page_id NOT IN (SELECT page_id FROM s) OR contains(lower(title), 'en') OR contains(lower(title), '1')""")
def subpage_promotion(spark, sf_dir):
    """Relevant sub-pages of pages that score 50, each URL once, before their parent; the parent stays if none is promoted or it is relevant itself."""
    s = _subpages(spark, sf_dir)
    seen = F.row_number().over(Window.partitionBy("href").orderBy("page_id", "ord"))
    up = s.filter("relevance >= 1").withColumn("seen", seen).filter("seen = 1").select("page_id", F.col("ord").alias("sub_pos"), F.col("href").alias("target"), (50 * 0.5 + 2 * F.col("relevance")).alias("score"))
    some = up.select("page_id").distinct().withColumn("promoted", F.lit(True))
    parents = s.select("page_id", "parent").distinct().join(some, "page_id", "left").filter(F.col("promoted").isNull() | F.col("parent"))
    return up.unionByName(parents.select("page_id", F.lit(1_000_000).alias("sub_pos"), F.lit("").alias("target"), F.lit(50.0).alias("score")))


_STOP = "[" + ", ".join(f"'{w}'" for w in dicts.STOP_WORDS) + "]"
_WORDS = f"list_filter(regexp_extract_all(lower({{}}), '[a-z]+'), lambda w: length(w) >= 2 AND NOT list_contains({_STOP}, w))"


@query(f"""
WITH w AS (SELECT page_id, unnest({_WORDS.format(_TITLE)}) AS term FROM pages), q AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS.format('text')}) AS term FROM benchmark),
h AS (SELECT query_id, page_id, count(*) AS n FROM w JOIN q USING (term) GROUP BY ALL)
SELECT query_id, page_id, n, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, page_id) AS rank FROM h QUALIFY rank <= 10""")
def title_search(spark, sf_dir):
    """The ten pages whose titles hold most of a request's terms; the requests are the texts of a table."""
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term")).distinct()
    w = table(spark, sf_dir, "pages").select("page_id", F.explode(text.tokens(extract.page_title(F.col("html")))).alias("term"))
    n = w.groupBy("page_id", "term").agg(F.count(F.lit(1)).alias("m")).join(terms, "term").groupBy("query_id", "page_id").agg(F.sum("m").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("n").desc(), "page_id"))).filter("rank <= 10")
