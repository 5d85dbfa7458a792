"""Queries over crawled pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import dicts, extract, text
from quillspark.operators import dedup
from quillspark.operators.tfidf import partitions

from .catalog import query, table, words

_DOMAIN = "regexp_replace(regexp_replace(lower(url), '^.*?://', ''), '/.*$', '')"
_KEY = "lower(url)"
for _p in ("^https?://", "^www\\.", "/$", "#.*$", "\\?utm_[^&]*", "\\?fbclid=[^&]*", "\\?ref=[^&]*"):
    _KEY = f"regexp_replace({_KEY}, '{_p}', '')"
_KEY = f"regexp_replace({_KEY}, '[?&](utm_|fbclid|gclid|ref=)[^&]*', '', 'g')"
_TITLE = "trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
_HREFS = """regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"''#]+)["'']', 1)"""
_TOKENS = f"list_filter(regexp_extract_all(lower({{}}), '[a-z]+'), lambda w: length(w) >= 2 AND NOT list_contains({words(dicts.STOP_WORDS)}, w))"


def _escaped(items):
    return "|".join(w.replace(".", "\\.") for w in items)


_ADMIT = f"(starts_with(lower(url), 'http') AND length(url) <= 300 AND NOT regexp_matches(lower(url), '(?:{_escaped(dicts.SKIP_EXTENSIONS)})(?:$|\\?)') AND NOT regexp_matches(lower(url), '{'|'.join(dicts.SKIP_PATHS)}'))"


def _simple(name: str, column, sql: str, alias: str):
    def run(spark, sf_dir):
        return table(spark, sf_dir, "pages").select("page_id", column().alias(alias))

    run.__name__ = name
    query(f"SELECT page_id, {sql} AS {alias} FROM pages")(run)


_simple("url_domain", lambda: text.url_domain(F.col("url")), _DOMAIN, "domain")
_simple("url_host", lambda: text.url_host(F.col("url")), "regexp_extract(url, '^[a-zA-Z]+://([^/:?#]*)', 1)", "host")
_simple("url_normalize", lambda: text.url_key(F.col("url")), _KEY, "url_key")
_simple("title_from_url", lambda: text.url_title(F.col("url")), "translate(regexp_extract(url, '([^/]*)$', 1), '-_', '  ')", "url_title")
_simple("page_title", lambda: extract.page_title(F.col("html")), _TITLE, "title")
_simple("title_normalize", lambda: text.title_key(extract.page_title(F.col("html"))), f"trim(regexp_replace(regexp_replace(regexp_replace(lower({_TITLE}), '[ \\t\\n\\x0B\\f\\r\\-_|｜–—]+', ' ', 'g'), '[【】\\[\\]()（）]', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))", "title_key")
_simple("title_truncate", lambda: text.truncate(extract.page_title(F.col("html")), 12), f"CASE WHEN length({_TITLE}) > 12 THEN substr({_TITLE}, 1, 12) || '...' ELSE {_TITLE} END", "short_title")
_simple("url_mask", lambda: text.mask(F.col("url")), "CASE WHEN length(url) <= 4 THEN '****' ELSE left(url, 2) || '****' || right(url, 2) END", "masked")
_simple("url_admissible", lambda: extract.admissible(F.col("url")), _ADMIT, "admissible")
_simple("url_excluded", lambda: extract.excluded(F.col("url")), f"len(list_filter({words(dicts.EXCLUDED_DOMAINS)}, lambda w: contains(lower(url), w))) > 0", "excluded")
_simple("url_social", lambda: extract.social(F.col("url")), f"len(list_filter({words(dicts.SOCIAL_DOMAINS)}, lambda w: contains(lower(url), w))) > 0", "social")
_simple("list_page", lambda: extract.looks_like_list(F.col("url"), F.col("html")), """(regexp_matches(lower(url), 'category|list|search|type=|演唱會|展覽|活動|concert|events') OR (contains(lower(url), 'ticket') AND contains(lower(url), '.aspx')) OR len(regexp_extract_all(html, '(?i)href=["''][^"'']*(?:event|activity|show|utk)[^"'']*["'']')) >= 3)""", "is_list")
#: Pages have no metadata of their own; forms of it are added by page, the same in both engines.
_METAS = ["", '<meta property="og:title" content="One {0}">', '<META content="Two {0}" class="x" property="og:title"/>', "<meta name='og:title' content='Three {0}'>", '<meta property="og:image" content="i.png">']
_LDS = ["", '<script type="application/ld+json">{{"name": "A {0}", "url": "u", "description" : "B"}}</script>', '<script id="s" type="application/ld+json">[{{"headline":"C"}}]</script> <script type="application/ld+json">{{"caption":"D {0}"}}</script>']
_MAINS = ["", "<main>Main {0} &amp; <b>bold</b><script>var x</script></main>", '<div class="post-content">Div {0}</div><p>out</p>', '<img src="a" alt="picture {0}"><img title="my LOGO"><img alt="ab">']


def _made(forms):
    """A form by page_id, with the id filled in."""
    at = F.get(F.array(*map(F.lit, (f.replace("{{", "{").replace("}}", "}") for f in forms))), (F.col("page_id") % len(forms)).cast("int"))
    return F.replace(at, F.lit("{0}"), F.col("page_id").cast("string"))


def _made_sql(forms):
    cases = " ".join("WHEN {} THEN '{}'".format(i, f.replace("{{", "{").replace("}}", "}").replace("'", "''")) for i, f in enumerate(forms))
    return f"replace(CASE page_id % {len(forms)} {cases} END, '{{0}}', page_id::VARCHAR)"


_OG = """coalesce(nullif(regexp_extract({h}, '(?is)<meta[^>]*property=["'']og:title["''][^>]*content=["'']([^"'']*)["'']', 1), ''),
  nullif(regexp_extract({h}, '(?is)<meta[^>]*content=["'']([^"'']*)["''][^>]*property=["'']og:title["'']', 1), ''), regexp_extract({h}, '(?is)<meta[^>]*name=["'']og:title["''][^>]*content=["'']([^"'']*)["'']', 1))"""
_LD = """coalesce(array_to_string(flatten(list_transform(regexp_extract_all({h}, '(?is)<script[^>]*type=["'']application/ld\\+json["''][^>]*>(.*?)</script>', 1), lambda b: regexp_extract_all(b, '"(?:caption|description|name|headline)"\\s*:\\s*"([^"]+)"', 1))), ' '), '')"""
_simple("og_title", lambda: extract.meta(F.concat("html", _made(_METAS)), "og:title"), _OG.replace("{h}", f"(html || {_made_sql(_METAS)})"), "og_title")
_simple("json_ld_text", lambda: extract.json_ld_text(F.concat("html", _made(_LDS))), _LD.replace("{h}", f"(html || {_made_sql(_LDS)})"), "ld_text")
_simple("page_links", lambda: F.array_join(F.array_distinct(extract.hrefs(F.col("html"))), " "), f"coalesce((SELECT string_agg(h, ' ' ORDER BY i) FROM (SELECT h, min(i) AS i FROM (SELECT unnest({_HREFS}) AS h, generate_subscripts({_HREFS}, 1) AS i) GROUP BY h)), '')", "links")
_simple("sanitize_title", lambda: text.sanitize(F.concat(extract.page_title(F.col("html")), F.lit(" <b>&'\""))), f"replace(replace(replace(replace(replace({_TITLE} || ' <b>&''\"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')", "safe_title")
_simple("unsanitize_title", lambda: text.unsanitize(text.sanitize(extract.page_title(F.col("html")))), _TITLE, "title")
_simple("keyword_occurrences", lambda: text.occurrences(F.lower(F.col("html")), F.lit("the")), "CAST((length(lower(html)) - length(replace(lower(html), 'the', ''))) / 3 AS INT)", "n")

_BARE = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"""


@query(f"""
WITH bare AS (SELECT page_id, {_BARE} AS h FROM pages), art AS (SELECT page_id, regexp_extract(h, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1) AS a FROM bare)
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(a, '(?s)<[^>]+>', ' ', 'g'), '&[a-zA-Z#0-9]+;', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS content FROM art""")
def page_content(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", extract.main_text(F.col("html")).alias("content"))


@query(f"""
WITH l AS (SELECT DISTINCT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) AS root, regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') AS folder, unnest({_HREFS}) AS href FROM pages)
SELECT page_id, href, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL
  WHEN starts_with(href, '//') THEN regexp_extract(root, '^[a-z]+:') || href WHEN starts_with(href, '/') THEN root || href ELSE folder || href END AS target FROM l""")
def url_resolve(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(extract.hrefs(F.col("html"))).alias("href")).distinct()
    return links.select("page_id", "href", text.url_resolve(F.col("url"), F.col("href")).alias("target"))


def scored_pages(spark, sf_dir):
    """Pages with a title, a host as their request and the length of the page as their score."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("pos"), "url", text.url_domain(F.col("url")).alias("query_id"), extract.page_title(F.col("html")).alias("title"), extract.main_text(F.col("html")).alias("content"), F.length("html").cast("double").alias("score"), F.lit(None).cast("string").alias("city"), F.lit(None).cast("date").alias("event_date"))


@query(f"""
WITH k AS (SELECT page_id, url, {_KEY} AS key, length(html) AS score FROM pages)
SELECT key AS url_key, arg_min(page_id, {{'s': -score, 'p': page_id}}) AS page_id, min(page_id) AS first_pos FROM k GROUP BY key""")
def url_dedup(spark, sf_dir):
    one = scored_pages(spark, sf_dir).drop("content").withColumn("query_id", F.lit(1))
    return dedup.by_url(one).select(text.url_key(F.col("url")).alias("url_key"), F.col("pos").alias("page_id"), "first_pos")


@query()
def title_dedup(spark, sf_dir):
    led = dedup.leaders(scored_pages(spark, sf_dir), text.title_key(F.col("title")), "title")
    return dedup.best_of(led).select("query_id", "pos", "title", "url")


@query()
def title_clusters(spark, sf_dir):
    led = dedup.leaders(scored_pages(spark, sf_dir), text.title_key(F.col("title")), "title")
    return led.groupBy("query_id", "leader").agg(F.array_join(F.array_sort(F.collect_list("pos")).cast("array<string>"), " ").alias("members"))


@query()
def dedup_pipeline(spark, sf_dir):
    return dedup.deduplicate(scored_pages(spark, sf_dir)).select("query_id", "pos", "url", "score")


@query()
def dedup_quick(spark, sf_dir):
    return dedup.deduplicate(scored_pages(spark, sf_dir), quick=True).select("query_id", "pos", "url", "score")


_GRAMS = "CASE WHEN length({0}) < 2 THEN [] ELSE list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))) END"


@query(f"""
WITH t AS (SELECT page_id, {_DOMAIN} AS host, trim(regexp_replace(regexp_replace(regexp_replace(lower({_TITLE}), '[ \\-_|｜–—]+', ' ', 'g'), '[【】\\[\\]()（）]', '', 'g'), ' +', ' ', 'g')) AS k FROM pages),
g AS (SELECT *, {_GRAMS.format('k')} AS gs FROM t)
SELECT a.page_id AS a, b.page_id AS b, round(CASE WHEN a.k = '' OR b.k = '' THEN 0.0 WHEN a.k = b.k THEN 1.0 WHEN contains(a.k, b.k) OR contains(b.k, a.k) THEN 0.85
  WHEN len(list_distinct(list_concat(a.gs, b.gs))) = 0 THEN 0.0 ELSE len(list_intersect(a.gs, b.gs))::DOUBLE / len(list_distinct(list_concat(a.gs, b.gs))) END::DOUBLE, 6) AS similarity
FROM (SELECT *, lag(page_id) OVER (PARTITION BY host ORDER BY page_id) AS last FROM g) b JOIN g a ON a.page_id = b.last""")
def title_similarity(spark, sf_dir):
    """Neighbouring pages of a host; all pairs of one would grow with its square."""
    w = Window.partitionBy("query_id").orderBy("pos")
    p = scored_pages(spark, sf_dir).select("pos", "title", F.lag("pos").over(w).alias("a"), F.lag("title").over(w).alias("other"))
    p = p.filter("a IS NOT NULL").repartition(partitions(table(spark, sf_dir, "pages")), "pos")  # a hot host is one task up to here
    return p.select("a", F.col("pos").alias("b"), F.round(text.title_similarity(F.col("other"), F.col("title")), 6).alias("similarity"))


@query(f"SELECT {_DOMAIN} AS domain, count(*) AS pages, sum(length(html))::BIGINT AS total FROM pages GROUP BY 1")
def site_totals(spark, sf_dir):
    p = table(spark, sf_dir, "pages").groupBy(text.url_domain(F.col("url")).alias("domain"))
    return p.agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("html")).cast("long").alias("total"))


@query(f"""
WITH w AS (SELECT {_DOMAIN} AS domain, unnest({_TOKENS.format(_TITLE)}) AS keyword FROM pages), n AS (SELECT domain, keyword, count(*) AS n FROM w GROUP BY ALL)
SELECT domain, keyword, n, row_number() OVER (PARTITION BY domain ORDER BY n DESC, keyword) AS place FROM n QUALIFY place <= 5""")
def site_top_keywords(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(text.url_domain(F.col("url")).alias("domain"), F.explode(text.tokens(extract.page_title(F.col("html")))).alias("keyword"))
    n = rows.groupBy("domain", "keyword").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.col("n").desc(), "keyword"))
    return n.withColumn("place", place).filter("place <= 5")
