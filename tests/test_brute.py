"""Queries without SQL, and rules in order, against plain Python."""

import json
import re
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from quillspark import plans
from quillspark.functions import cards, dicts, requests, text
from quillspark.operators import dedup, state, tfidf
from quillspark.plans import listings, responses, search
from quillspark.sources import event_csv, hits, settings

FOLDER = "/root/testdata/sf0.001"


def ask_all(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, q string").coalesce(1)
    return [r.v for r in df.select("i", column(F.col("q")).alias("v")).orderBy("i").collect()]


QUERIES = ["", "台北 演唱會", "台北爵士音樂節 -免費", "  展覽  高雄市集 ", "a展覽 展覽", "市集", "Taipei event", "台中親子活動", "免費展覽 台北", "音樂節 音樂節"]


def test_query_tokens(spark):
    def direct(q):
        out = []
        for w in q.split():
            if w.startswith("-"):
                continue
            out.append(w)
            s = next((s for s in dicts.QUERY_SUFFIXES if w.endswith(s) and len(w) > len(s)), None)
            if s:
                stem = w[: -len(s)]
                if len(stem) >= 2 and stem not in out:
                    out.append(stem)
                if s not in out:
                    out.append(s)
        return out

    assert ask_all(spark, text.query_tokens, QUERIES) == [direct(q) for q in QUERIES]


def test_tokens(spark):
    def direct(t):
        out = [w for w in re.findall("[a-z]+", t.lower()) if len(w) >= 2 and w not in dicts.STOP_WORDS]
        for run in re.findall("[一-鿿㐀-䶿]+", t.lower()):
            if len(run) < 2:
                continue
            terms = [w for w in dicts.IMPORTANT_TERMS if w in run]
            out += terms + [g for g in (run[i : i + 2] for i in range(len(run) - 1)) if g not in dicts.STOP_WORDS and not any(g in w for w in terms)]
            out += [g for g in (run[i : i + 3] for i in range(len(run) - 2)) if g not in dicts.STOP_WORDS]
        return out

    samples = [*QUERIES, "台北演唱會 Live in Taipei", "補助申請辦法 of 特展與音樂會", "x 的 一"]
    assert [sorted(x) for x in ask_all(spark, text.tokens, samples)] == [sorted(direct(t)) for t in samples]


def test_suggestions_and_related_queries(spark):
    def suggest(q, city):
        low, first = q.lower(), []
        add = lambda s, part: first.append(s) if part not in low and s not in first else None
        for k, v in dicts.TYPE_SUGGESTIONS.items():
            for s in v:
                if k in low:
                    add(s, s.lower())
        for k, v in dicts.CITY_SUGGESTIONS.items():
            for s in v:
                if city == k:
                    add(s, s.lower().replace(k, ""))
        for s in dicts.TIME_SUGGESTIONS:
            add(s, s.replace("活動", ""))
        if len(first) < 6:
            for s in dicts.HOT_SUGGESTIONS:
                add(s, s.lower())
        return first[:8]

    assert ask_all(spark, lambda q: requests.suggest(q, F.lit("台北")), QUERIES) == [suggest(q, "台北") for q in QUERIES]

    def related(q):
        kind = next((t for t in dicts.EVENT_TYPES if t in q), None)
        place = next((c for c in dicts.TAIWAN_CITIES if c in q), None) or next((v for k, v in dicts.CITY_ALIASES if k in q.lower()), None) or next((c for v, c in dicts.VENUE_CITY if v in q), None)
        out = [q.replace(k, s) for k, v in dicts.SYNONYMS.items() for s in v if kind == k and s not in q]
        return (out + [q.replace(place, c) for c in "台北 台中 高雄 台南".split() if place and place != c])[:5]

    assert ask_all(spark, requests.related, QUERIES) == [related(q) for q in QUERIES]


def test_request_parts_agree(spark):
    rows = plans.QUERIES["query_parse"](spark, FOLDER).collect()
    q = F.concat("city_txt", "type_txt", "date_txt")
    day = F.lit(listings.TODAY).cast("date")
    one = {r.listing_id: r for r in listings.listing(spark, FOLDER).select("listing_id", q.alias("q"), requests.expand(q, day).alias("e"), requests.type_of(q).alias("t"), requests.wants_free(q).alias("f")).collect()}
    assert len(rows) == len(one)
    assert all((r.original_query, r.expanded_query, r.event_type, r.wants_free) == (one[r.listing_id].q, one[r.listing_id].e, one[r.listing_id].t, one[r.listing_id].f) for r in rows)


def greedy(rows, alike):
    """rows: (pos, value) in order; position of each row's leader."""
    chosen, out = [], {}
    for pos, v in rows:
        hit = next((p for p, u in chosen if alike(u, v)), None)
        if hit is None:
            chosen.append((pos, v))
        out[pos] = pos if hit is None else hit
    return out


def titles_alike(a, b):
    if not a or not b:
        return False
    if a == b or a in b or b in a:
        return True
    x, y = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (a, b))
    return len(x | y) > 0 and len(x & y) / len(x | y) >= 0.7


def test_greedy_dedup(spark):
    from quillspark.plans.pages import scored_pages

    pages = scored_pages(spark, FOLDER).withColumn("k", text.title_key(F.col("title"))).withColumn("u", text.url_key(F.col("url")))
    rows = sorted(pages.collect(), key=lambda r: r.pos)
    rank = lambda r: (-r.score, -len(r.content or ""), r.pos)
    led = {}
    for q in {r.query_id for r in rows}:
        led |= greedy([(r.pos, r.k) for r in rows if r.query_id == q], titles_alike)
    clusters = {}
    for r in rows:
        clusters.setdefault(led[r.pos], []).append(r)
    got = {(r.query_id, r.leader): r.members for r in plans.QUERIES["title_clusters"](spark, FOLDER).collect()}
    assert got == {(m[0].query_id, k): " ".join(str(r.pos) for r in m) for k, m in clusters.items()}
    best = {k: min(m, key=rank) for k, m in clusters.items()}
    assert sorted((r.query_id, r.pos, r.url) for r in plans.QUERIES["title_dedup"](spark, FOLDER).collect()) == sorted((b.query_id, k, b.url) for k, b in best.items())
    # the quick form: URL keys first
    first = {}
    for r in rows:
        key = (r.query_id, r.u)
        old = first.get(key)
        first[key] = (r, r.pos) if old is None else ((r, old[1]) if r.score > old[0].score else old)
    left = sorted(((p, r) for r, p in first.values()), key=lambda x: x[0])
    led = {}
    for q in {r.query_id for r in rows}:
        led |= greedy([(p, r.k) for p, r in left if r.query_id == q], titles_alike)
    members = {}
    for p, r in left:
        members.setdefault(led[p], []).append((p, r))
    quick = {k: min(m, key=lambda x: (-x[1].score, -len(x[1].content or ""), x[0]))[1] for k, m in members.items()}
    assert sorted((r.query_id, r.pos, r.url) for r in plans.QUERIES["dedup_quick"](spark, FOLDER).collect()) == sorted((b.query_id, k, b.url) for k, b in quick.items())
    # then content, within five bits
    hashed = {r.pos: r.simhash for r in dedup.simhash(pages, "pos", text.hash_content(F.col("title"), F.col("content"))).withColumnRenamed("id", "pos").collect()}
    led, by_pos = {}, {r.pos: r for r in rows}
    for q in {r.query_id for r in rows}:
        led |= greedy([(k, hashed[b.pos]) for k, b in sorted(quick.items()) if b.query_id == q], lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 5)
    whole = {}
    for k in quick:
        whole.setdefault(led[k], []).append(k)
    want = {k: min(m, key=lambda x: (-quick[x].score, -len(quick[x].content or ""), x)) for k, m in whole.items()}
    assert sorted((r.query_id, r.pos, r.url) for r in plans.QUERIES["dedup_pipeline"](spark, FOLDER).collect()) == sorted((quick[b].query_id, k, quick[b].url) for k, b in want.items())
    assert by_pos


def squeeze(t):
    return re.sub(r"\s+", " ", t).strip()


def first_text(h):
    t = squeeze(re.sub("<[^>]+>", " ", h))
    if len(t) > 100:
        t = t[:100]
        if t.rfind(" ") > 50:
            t = t[: t.rfind(" ")]
    return t


def direct_cards(html, url):
    from urllib.parse import urljoin

    host, out, seen = re.match("[a-z]+://([^/]*)", url)[1], [], set()
    if "ticket.com.tw" in host:
        for m in re.finditer(r"(?is)<div[^>]*class=[\"'][^\"']*(?:event|item|card|product)[^\"']*[\"'][^>]*>(.*?)</div>", html):
            box = m[1]
            link, head, image, named = (re.search(p, box, re.I) for p in (r"<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>", r"<h[1-6][^>]*>([^<]+)</h[1-6]>", r"<img[^>]+alt=[\"']([^\"']+)[\"']", r"title=[\"']([^\"']+)[\"']"))
            title = next((squeeze(x[1]) for x in (head, image, named) if x), None) or (first_text(box) if not (head or image or named) else "")
            date = re.search(r"\d{4}[/.-]\d{1,2}[/.-]\d{1,2}|\d{1,2}[/.-]\d{1,2}|\d{1,2}月\d{1,2}日?", box)
            if link and len(title) > 3 and len(out) < 20:
                out.append((title, urljoin(url, link[1]), date[0] if date else ""))
        if not out:
            for m in re.finditer(r"(?i)<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>\s*<img[^>]+alt=[\"']([^\"']+)[\"']", html):
                if len(squeeze(m[2])) > 3 and not re.search("logo|banner", m[2].lower()) and len(out) < 20:
                    out.append((squeeze(m[2]), urljoin(url, m[1]), ""))
    elif "accupass" in host:
        for m in re.finditer(r"(?is)<a[^>]+href=[\"']([^\"']*?/event/[^\"']+)[\"'][^>]*>.*?(?:<[^>]*>)*([^<]{5,100})", html):
            u = urljoin(url, m[1])
            if u not in seen and len(squeeze(m[2])) > 3 and len(out) < 20:
                seen.add(u)
                out.append((squeeze(m[2]), u, ""))
    elif any(h in host for h in ("kktix", "opentix", "tixcraft")):
        path = "/activity/detail/" if "tixcraft" in host else "/events?/"
        for m in re.finditer(rf"(?is)<a[^>]+href=[\"']([^\"']*?{path}[^\"']+)[\"'][^>]*>", html):
            u = urljoin(url, m[1])
            if u not in seen and len(out) < 20:
                seen.add(u)
                if t := first_text(html[m.end() : m.end() + 200]):
                    out.append((t, u, ""))
    else:
        for m in re.finditer(r"(?is)<a[^>]+href=[\"']([^\"']*?(?:event|activity|show|concert|ticket|演唱|展覽|活動)[^\"']*)[\"'][^>]*>([^<]*(?:<[^>]+>[^<]*)*)</a>", html):
            u, t = urljoin(url, m[1]), squeeze(re.sub("<[^>]+>", " ", m[2]))
            if u not in seen and 5 < len(t) < 100 and len(out) < 20:
                seen.add(u)
                out.append((t, u, ""))
    return out


def test_event_cards(spark):
    rows = responses.card_pages(spark, FOLDER).collect()
    extra = [(1000 + i, h, p.replace("{0}", "7") * 12) for i, (h, p) in enumerate((h, p) for h in responses.CARD_HOSTS for p in responses.CARD_PAGES)] + [(2000, responses.CARD_HOSTS[2], ""), (2001, responses.CARD_HOSTS[5], None)]
    df = spark.createDataFrame([(r.page_id, r.url, r.html) for r in rows] + extra, "page_id long, url string, html string")
    got = {r.page_id: [tuple(c) for c in r.c] for r in df.select("page_id", cards.event_cards(F.col("html"), F.col("url")).alias("c")).collect()}
    for i, url, html in [(r.page_id, r.url, r.html) for r in rows] + extra:
        assert got[i] == direct_cards(html or "", url), (i, url)


@pytest.mark.parametrize("recent", [True, False])
def test_keyed_cache(spark, recent):
    import random

    rng = random.Random(5)
    rows = [(rng.randint(0, 2), rng.choice("abcdefghij"), t // 2, t) for t in range(400)] + [(0, None, 5, 1000), (None, "a", 5, 1001)]
    want, caches = {}, {}
    for c, k, t, o in rows[:400]:
        cache = caches.setdefault(c, OrderedDict())
        if k in cache and t - cache[k] > 20:
            del cache[k]
        want[o] = k in cache
        if k in cache:
            if recent:
                cache.move_to_end(k)
        else:
            cache[k] = t
            if len(cache) > 4:
                cache.popitem(last=False)
    df = spark.createDataFrame(rows, "c int, k string, t long, o long").withColumn("ts", F.timestamp_seconds("t")).repartition(3)
    got = {r.ordinal: r.hit for r in state.keyed_cache(df, "c", "k", "ts", "o", 4, 20, recent).collect()}
    assert got == want


def test_promotion(spark):
    sub = lambda u, t: (u, t, "", 0.0)
    rows = [
        (0, "台北 展覽", ["台北", "展覽"], 1, "p1", "台北展覽", "c", 10.0, [sub("s1", "台北 one"), sub("s2", "none"), sub("s1", "台北 again"), sub("p3", "展覽 台北")]),
        (0, "台北 展覽", ["台北", "展覽"], 2, "p2", "other", "c", 20.0, [sub("s1", "台北"), sub("s4", "展覽 four")]),
        (0, "台北 展覽", ["台北", "展覽"], 3, "p3", "third", "c", 30.0, []),
        (1, "x", ["x"], 1, "q1", "q", "c", 5.0, [sub("s1", "no")]),
    ]
    df = spark.createDataFrame(rows, "query_id long, query string, toks array<string>, pos long, url string, title string, content string, score double, subs array<struct<url:string,title:string,content:string,score:double>>")
    df = df.withColumn("event_date", F.lit("2024-05-05").cast("date")).withColumn("city", F.lit("高雄")).withColumn("domain", F.lit("d"))
    got = sorted((r.query_id, r.pos, r.url, r.score, r.city) for r in search.promoted(df, F.lit("2024-01-15").cast("date")).collect())
    assert got == [(0, 0, "s1", 11.0, "台北"), (0, 1, "p3", 21.0, "台北"), (0, 2, "p1", 10.0, "高雄"), (0, 3, "s4", 16.0, "高雄"), (1, 0, "q1", 5.0, "高雄")]


def test_search_tfidf_equals_a_direct_count(spark):
    import math

    rows = [(0, 1, "music market", "jazz music music", "music market jazz"), (0, 2, "market", "", "music market jazz"), (0, 3, "none", "words", "music market jazz"), (1, 1, "music", "a", "of the")]
    df = spark.createDataFrame(rows, "query_id long, pos long, title string, content string, query string")
    got = {(r.query_id, r.pos): round(r.points, 9) for r in search.with_tfidf(df).collect()}
    docs = {p: t.split() * 3 + c.split() for q, p, t, c, _ in rows if q == 0}
    raw = {}
    for p, words in docs.items():
        raw[p] = 0.0
        for term in ("music", "market", "jazz"):
            n, df_ = words.count(term), sum(term in w for w in docs.values())
            if n:
                raw[p] += (1 + math.log(n)) * (math.log(len(docs) / df_) + 1) * (1.3 if term in dicts.IMPORTANT_TERMS else 1.0)
    top = max(raw.values())
    assert got == {(0, p): round(v / top * 30, 9) for p, v in raw.items()} | {(1, 1): 0.0}


def test_ranked_search_takes_no_more_than_the_source_gives(spark):
    rows = plans.QUERIES["ranked_search"](spark, FOLDER).collect()
    assert rows and all(r.total_count <= search.HITS * 25 and 1 <= r.rank <= 10 for r in rows)
    by = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
    for rs in by.values():
        assert [r.rank for r in rs] == list(range(1, len(rs) + 1)) and all(a.score >= b.score for a, b in zip(rs, rs[1:])) and len({r.url for r in rs}) == len(rs)


def test_saved_hits(spark, tmp_path):
    item = lambda i: {"title": f"t{i}", "link": f"l{i}"} | ({"snippet": "s"} if i % 2 else {})
    (tmp_path / "1.json").write_text(json.dumps({"items": [item(i) for i in range(10)]}))
    (tmp_path / "11.json").write_text(json.dumps({"items": [item(i) for i in range(10, 15)]}))
    (tmp_path / "21.json").write_text(json.dumps({}))
    (tmp_path / "31.json").write_text(json.dumps({"items": [item(99)]}))
    assert [tuple(r) for r in hits.saved_hits(spark, str(tmp_path), 12).collect()] == [(i + 1, f"t{i}", f"l{i}", "s" if i % 2 else "") for i in range(12)]
    assert hits.saved_hits(spark, str(tmp_path)).count() == 15
    (tmp_path / "11.json").write_text("{")
    assert hits.saved_hits(spark, str(tmp_path)).count() == 10
    (tmp_path / "1.json").write_text("{")
    with pytest.raises(Exception):
        hits.saved_hits(spark, str(tmp_path)).count()


def test_settings_and_csv(spark, tmp_path):
    s = settings.Settings(settings.properties("# x\na.bC = 5\nflag:yes\nblank=\n"), {"SEARCH_API_KEY": "k", "A_B_D": " "})
    assert (s.get("search.apiKey"), s.get("a.bC"), s.get("a.bD", "d"), s.get("blank", "e")) == ("k", "5", "d", "e")
    assert (s.get_int("a.bC", 1), s.get_int("search.apiKey", 7), s.get_bool("flag", False), s.get_bool("none", True)) == (5, 7, True, True)
    (tmp_path / "e.csv").write_text("title,city,date,url,domain,tokens\n音樂節,台北,2025-11-10,https://ex1,a.tw,台北 音樂節\n展,台中,bad,u,d,\n")
    assert [tuple(r)[2:] for r in event_csv.found_events(spark, str(tmp_path / "e.csv")).collect()][1][0] is None
    (tmp_path / "r.csv").write_text('score,title,city,date,domain,url\n70.00,"a, b","台北","","d","u"\nx,t,c,2024-01-02,d,u\n')
    assert [(r.score, r.title, r.date and r.date.isoformat()) for r in event_csv.ranked_events(spark, str(tmp_path / "r.csv")).collect()] == [(70.0, "a, b", None), (None, "t", "2024-01-02")]


def test_subpages_and_answers(spark):
    html = '<a href="/a/">One <b>x</b></a><a href="/a#top">again</a><a href="mailto:x@y">m</a><a href="https://H.example.com/b"> </a><a href="http://other.com/">o</a><a href="#here">self</a><a href="javascript:void(0)">j</a>'
    row = spark.range(1).select(responses.subpages_of(F.lit(html), F.lit("http://h.example.com/p/")).alias("s")).first()
    assert [tuple(s) for s in row.s] == [("http://h.example.com/a", "One x"), ("https://H.example.com/b", "https://H.example.com/b")]
    bodies = [json.loads(r.body) for r in plans.QUERIES["suggestion_answers"](spark, FOLDER).collect()]
    assert bodies and all(b["success"] and len(b["suggestions"]) <= 8 for b in bodies)
    report = spark.range(1).select(responses.keyword_report(F.lit("q"), F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")), F.lit("q c")).alias("r")).first().r
    assert report == "query: q\nkeywords:\n  * a\n  * b\nsuggested:\n  * c\nexpanded: q c"
    probe = spark.range(1).select(responses.health(F.lit("1"), F.lit("2024-01-01").cast("timestamp"), F.lit(True)).alias("h")).first().h
    assert (probe.code, json.loads(probe.body)) == (503, {"status": "stopping", "version": "1", "timestamp": "2024-01-01T00:00:00Z"})


def test_answers_of_the_search_are_json(spark):
    rows = [(0, 1, "t", "u", "d", 99.96, None, "", 3, 1), (0, 2, "t2", "u2", "d", 10.0, "台北", "2024-01-02", 3, 1)]
    df = spark.createDataFrame(rows, "query_id long, rank int, title string, url string, domain string, score double, city string, event_date string, total_count long, total_pages int")
    body = json.loads(responses.as_json(df).first().body)
    assert (body["totalCount"], body["cached"], [r["rank"] for r in body["results"]], body["results"][0]["score"], body["results"][0]["city"]) == (3, False, [1, 2], 100.0, "")


def test_crawl_merge(spark):
    day = F.lit("2024-01-15").cast("date")
    page = '<a href="/event/1">台北 展覽 one</a><a href="/a">x</a><a href="/b">y</a><a href="http://other.com/">z</a><a href="/c-d">w</a>'
    rows = [  # pos, url, title, crawled title, body, snippet, date, city, order
        (1, "https://tixcraft.com/", "short", "a longer title", "body 2024/03/05 台中", "snip", None, None, 1),
        (2, "https://www.facebook.com/x", "short", "a longer title", "body", "social 2024/02/01 高雄", None, "全台", 2),
        (3, "https://b.example.com/", "the longest title", "less", "body 台南", "snip", "2024-05-05", "全台", 3),
        (4, "https://c.example.com/", "short", "a longer title", "body 台南", "snip", None, None, 6),
    ]
    df = spark.createDataFrame(rows, "pos long, url string, title string, crawled_title string, body string, snippet string, event_date string, city string, order int")
    df = df.withColumns({"event_date": F.col("event_date").cast("date"), "html": F.lit(page), "query_id": F.lit(0), "query": F.lit("台北"), "toks": F.array(F.lit("台北")), "domain": text.url_domain(F.col("url")), "content": F.col("snippet")})
    got = {r.pos: r for r in search.crawled(df, day).collect()}
    shown = {k: (r.title, r.content, str(r.event_date), r.city, [(s.url, s.title, s.score) for s in r.subs]) for k, r in got.items()}
    links = lambda h: [(f"https://{h}/event/1", "1", 0.0), (f"https://{h}/a", "a", 0.0), (f"https://{h}/b", "b", 0.0), (f"https://{h}/c-d", "c d", 0.0)]
    assert shown[1] == ("a longer title", rows[0][4], "2024-03-05", "台中", links("tixcraft.com"))
    assert shown[2] == ("short", rows[1][5], "2024-02-01", "全台", [])
    assert shown[3] == ("the longest title", rows[2][4], "2024-05-05", "台南", [("https://b.example.com/event/1", "台北 展覽 one x y z w", 5.0), *links("b.example.com")])  # a card to the last link's end
    assert shown[4] == ("short", "snip", "None", None, [])


def test_city_and_request_for_the_source(spark):
    day = F.lit("2024-01-15").cast("date")
    assert ask_all(spark, lambda q: search.effective_city(q, F.lit("高雄")), ["台中展覽", "展覽", "taipei x"]) == ["台中", "高雄", "台北"]
    assert ask_all(spark, lambda q: search.effective_city(q, F.lit(None).cast("string")), ["展覽"]) == [None]
    assert ask_all(spark, lambda q: search.source_query(q, F.lit("高雄"), day), ["台中展覽", "展覽"]) == ["台中展覽 特展 (2024 OR 2025)", "高雄 展覽 特展 (2024 OR 2025)"]


def test_leaders_of_a_hot_group(spark):
    """Some thousand titles of one host, against the plain rule; before, each was held against all leaders in Python."""
    import random
    import time

    rnd = random.Random(5)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    make = lambda n: "".join(rnd.choice(syllables) + " " * (rnd.random() < 0.3) for _ in range(n))
    titles = ["", "", "x", "ab", "台北音樂節", "台北音樂節 2025", "𠀀𠀁"]
    while len(titles) < 500:
        t = rnd.choice(titles)
        cut = rnd.randrange(len(t) + 1)
        titles.append(rnd.choice([make(rnd.randrange(1, 30)), make(25), t, t[cut:], t[:cut] + rnd.choice("xyz") + t[cut + 1 :], t + make(2)]))
    hashes = [rnd.getrandbits(64) - (1 << 63) for _ in range(150)]
    hashes += [h ^ sum({1 << rnd.randrange(63) for _ in range(n)}) for h in hashes for n in (0, 4, 5, 6)]
    for alike, kind, values, test in (("title", "string", titles, titles_alike), ("hash", "long", hashes, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 5)):
        rows = [(g, p * 3, values[(p * 7 + (g or 0)) % len(values)]) for g in (1, None) for p in range(len(values))]
        df = spark.createDataFrame(rows, f"g long, pos long, v {kind}")
        got = {(r.g, r.pos): r.leader for r in dedup.leaders(df, F.col("v"), alike, "g").collect()}
        assert got == {(g, p): k for g in (1, None) for p, k in greedy([(p, v) for h, p, v in rows if h == g], test).items()}
    index = dedup._Titles(6000)
    began = time.process_time()
    for _ in range(6000):
        index.find(make(25))
    assert time.process_time() - began < 60  # the plain rule took 254 s for a host of 3,119 distinct titles


def test_hamming_pairs_of_alike_hashes(spark, tmp_path):
    """Hashes that agree in most bits: six bands made groups of nearly all of them."""
    import random

    rnd = random.Random(3)
    hashes = sorted({sum(rnd.getrandbits(1) << b for b in range(0, 64, 5)) - (1 << 63) for _ in range(700)})
    want = {}
    for k, a in enumerate(hashes):
        for b in hashes[:k]:
            n = (a ^ b).bit_count()
            if n <= 5:
                want[n] = want.get(n, 0) + 1
    df = spark.createDataFrame([(h,) for h in hashes * 2], "simhash long")
    assert {r.distance: r.pairs for r in dedup.pairs_within(df).collect()} == want
    # texts without bigrams aren't in the SQL; they counted as hash 0 before
    texts = ["", "x", None, *("ab cd ef gh"[i:] for i in range(9))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = plans.QUERIES["hamming_pairs"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(plans.ORACLE_SQL["hamming_pairs"]).fetchall())


def test_common_terms_are_not_one_task(spark):
    """Documents are scored where they are: no exchange by term or request, and more documents make more partitions."""
    for name in ("tfidf_scores", "tfidf_normalized", "index_lookup"):
        plan = plans.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(doc_id" in plan
        assert not re.search(r"hashpartitioning\(term#\d+, \d+\)[^\n]*\n[^\n]*Sort|hashpartitioning\(query_id#\d+L?, doc_id|SortMergeJoin|Window", plan), name
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert tfidf.partitions(docs, 10_000) >= 20


def test_pairs_of_a_hot_host_are_dealt_out(spark):
    """Titles are compared after an exchange by page; before, in the task that has a whole host."""
    for name, column in (("title_similarity", "pos"), ("page_pairs", "page_id")):
        plan = plans.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert plan.index("array_intersect") < plan.index(f"hashpartitioning({column}") < plan.index("Window"), name
