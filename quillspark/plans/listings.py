"""Queries over event listings: dates, facts, filters, scores and ranks."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quillspark.functions import dates, dicts, extract, requests, text
from quillspark.operators import ranking

from .catalog import LISTED, TODAY, first_hit, held, listing, query, words

_DAY = f"DATE '{TODAY}'"


def _t():
    return F.lit(TODAY).cast("date")


# the patterns are written out here, so that SQL and Spark don't share a mistake
_M, _D, _Y = "(0?[1-9]|1[0-2])", "(0?[1-9]|[12][0-9]|3[01])", "(20[2-9][0-9])"


def _made(y: str, m: str, d: str) -> str:
    return f"try_cast(lpad({y}, 4, '0') || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"


def _or(part: str, other: int) -> str:
    return f"coalesce(nullif({part}, ''), '{other}')"


def _all(expr: str, pattern: str, y: str) -> str:
    """DuckDB's list of dates; y is an expression over z (year, month, day as matched, 1-based)."""
    return f"list_filter(list_transform(list_zip(regexp_extract_all({expr}, '{pattern}', 1), regexp_extract_all({expr}, '{pattern}', 2), regexp_extract_all({expr}, '{pattern}', 3)), lambda z: {_made(y, 'z[2]', 'z[3]')}), lambda d: d IS NOT NULL)"


_FULL = _all("title", "(20[2-9][0-9])[-/.年](0?[1-9]|1[0-2])[-/.月](0?[1-9]|[12][0-9]|3[01])", "z[1]")
_ROC_P = "(1[0-9][0-9])年(?:(0?[1-9]|1[0-2])月(0?[1-9]|[12][0-9]|3[01])日?)?"
_THEN = _all("title", "(20[2-9][0-9])(?:年|[ \\t\\n]|#)*(?:台|活動|花|聖誕|跨年|春節|演唱|展覽|市集|節|祭).{0,30}?(0?[1-9]|1[0-2])月(0?[1-9]|[12][0-9]|3[01])日?", "z[1]")
_POST = "'(?:(?:張貼|發布|更新)日期|發佈)[：:]?[ \\t\\n]*(20[12][0-9])[/.-](0?[1-9]|1[0-2])[/.-](0?[1-9]|[12][0-9]|3[01])'"
_POSTED = f"CASE WHEN nullif(regexp_extract(title, {_POST}, 1), '')::INT < 2023 THEN {_made(*(f'regexp_extract(title, {_POST}, {i})' for i in (1, 2, 3)))} END"
_QUICK = "nullif(regexp_extract(title, '(1[0-9][0-9])年度?(?:原|市集|活動|展覽|好市)', 1), '')::INT"
_ROC = (
    f"list_filter(list_transform(list_zip(regexp_extract_all(title, '{_ROC_P}', 1), regexp_extract_all(title, '{_ROC_P}', 2), regexp_extract_all(title, '{_ROC_P}', 3)), "
    f"lambda z: {_made('(z[1]::INT + 1911)::STRING', _or('z[2]', 12), _or('z[3]', 31))}), lambda d: d IS NOT NULL)"
)
# without a look-behind: the character before is part of the match
_BARE_P = f"(?:^|[^0-9]){_M}[/月]{_D}(?:日|[ \\t\\n]|\\)|$)"
_CONTEXT = f"nullif(regexp_extract(title, '(?:^|[ 【\\[(#]){_Y}(?:$|[ 】\\])年]|全台|精選|最新|活動|整理|市集|展覽|大賞|節|懶人包)', 1), '')"
_EVENT_YEAR = f"nullif(regexp_extract(title, '{_Y}(?:年| |#)*(?:活動|市集|展覽|演唱|音樂|聖誕|跨年|春節|節|祭)', 1), '')"
_BARE = f"list_filter(list_transform(list_zip(regexp_extract_all(title, '{_BARE_P}', 1), regexp_extract_all(title, '{_BARE_P}', 2)), lambda z: {_made(f'coalesce({_EVENT_YEAR}, {_CONTEXT}, (2024)::STRING)', 'z[1]', 'z[2]')}), lambda d: d IS NOT NULL)"
_RELATIVE = f"""CASE WHEN regexp_matches(title, '今[天日]') THEN {_DAY} WHEN regexp_matches(title, '[這本]週末') THEN DATE '2024-01-20'
  WHEN contains(title, '下週三') THEN DATE '2024-01-24' WHEN contains(title, '星期日') THEN DATE '2024-01-21' END"""


def _joined(list_sql: str) -> str:
    return f"array_to_string(list_transform({list_sql}, lambda d: strftime(d, '%Y-%m-%d')), ' ')"


def _days(c):
    return F.array_join(F.transform(c, lambda d: F.date_format(d, "yyyy-MM-dd")), " ")


def _simple(name: str, columns: dict, sql: str):
    def run(spark, sf_dir):
        return listing(spark, sf_dir).select("listing_id", *(c.alias(a) for a, c in ((a, f()) for a, f in columns.items())))

    run.__name__ = name
    query(f"{LISTED} SELECT listing_id, {sql} FROM listing" if sql else None)(run)


_simple("date_full", {"dates": lambda: _days(dates.full_dates(F.col("title")))}, f"{_joined(_FULL)} AS dates")
_simple("date_roc", {"dates": lambda: _days(dates.roc_dates(F.col("title")))}, f"{_joined(_ROC)} AS dates")
_simple("date_noyear", {"dates": lambda: _days(dates.bare_dates(F.col("title"), _t()))}, f"{_joined(_BARE)} AS dates")
_simple("date_relative", {"date": lambda: dates.relative_date(F.col("title"), _t())}, f"{_RELATIVE} AS date")
_DATED = f"list_concat(list_concat({_ROC}, {_FULL}), {_THEN})"
_CASCADE = f"""CASE WHEN {_QUICK} < 112 THEN make_date({_QUICK} + 1911, 12, 31) WHEN {_RELATIVE} IS NOT NULL THEN {_RELATIVE} WHEN {_POSTED} IS NOT NULL THEN {_POSTED} ELSE (
  SELECT CASE WHEN len(ds) > 0 THEN coalesce(list_min(list_filter(ds, lambda d: d >= {_DAY})), CASE WHEN regexp_matches(t.title, '(^|[^0-9])20(2[5-9]|[3-9][0-9])([^0-9]|$)') THEN make_date(list_max(list_transform(regexp_extract_all(t.title, '(?:^|[^0-9]){_Y}(?:[^0-9]|$)', 1), lambda y: y::INT))::INT, 1, 1) END, list_max(ds))
    WHEN regexp_matches(t.title, '即日起|常設展|長期展出') THEN DATE '2024-02-14' WHEN {_CONTEXT.replace('title', 't.title')}::INT < 2024 THEN make_date({_CONTEXT.replace('title', 't.title')}::INT, 12, 31) END
  FROM (SELECT CASE WHEN len(a) > 0 THEN a ELSE b END AS ds FROM (SELECT {_DATED.replace('title', 't.title')} AS a, {_BARE.replace('title', 't.title')} AS b))) END"""


def date_cascade(spark, sf_dir):
    return listing(spark, sf_dir).select("listing_id", dates.parse_date(F.col("title"), _t()).alias("date"))


query(f"{LISTED} SELECT listing_id, {_CASCADE} AS date FROM listing t")(date_cascade)


def _smart(pattern: str, y: str) -> str:
    if y == "none":
        inner = f"list_transform(list_zip(regexp_extract_all(title, '{pattern}', 1), regexp_extract_all(title, '{pattern}', 2)), lambda z: {_made(chr(39) + '2024' + chr(39), 'z[1]', 'z[2]')})"
    else:
        inner = f"list_transform(list_zip(regexp_extract_all(title, '{pattern}', 1), regexp_extract_all(title, '{pattern}', 2), regexp_extract_all(title, '{pattern}', 3)), lambda z: {_made('(z[1]::INT + CASE WHEN z[1]::INT < 200 THEN 1911 ELSE 0 END)::STRING', 'z[2]', 'z[3]')})"
    return f"list_filter({inner}, lambda d: d IS NOT NULL AND d >= DATE '2023-01-15')"


_SPAN = "[ \\t\\n]*[~至到-][ \\t\\n]*"
_NUM, _ROCDAY = "([0-9]{4})[/.-]([0-9]{1,2})[/.-]([0-9]{1,2})", "([0-9]{2,3})年([0-9]{1,2})月([0-9]{1,2})日?"
_NEAR = "flatten([" + ", ".join(_smart(p, y) for p, y in (
    (f"{_NUM}{_SPAN}{_NUM}", "y"), (f"{_NUM}{_SPAN}([0-9]{{1,2}})[/.-]([0-9]{{1,2}})", "y"), (f"{_ROCDAY}{_SPAN}{_ROCDAY}", "y"), (f"{_ROCDAY}{_SPAN}([0-9]{{1,2}})月([0-9]{{1,2}})日?", "y"),
    (_ROCDAY, "y"), (_NUM, "y"), ("([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日", "y"), ("([0-9]{1,2})月([0-9]{1,2})日", "none"),
)) + "])"
_SMART_CTE = f"{LISTED}, near AS (SELECT listing_id, body_txt, {_NEAR} AS ds FROM listing), span AS (SELECT *, list_filter(ds, lambda d: d >= {_DAY}) AS fs FROM near)"


def smart_dates(spark, sf_dir):
    span = dates.smart_dates(F.col("title"), _t())
    return listing(spark, sf_dir).select("listing_id", span["start"].alias("start_date"), span["end"].alias("end_date"))


query(f"{_SMART_CTE} SELECT listing_id, coalesce(list_min(fs), list_max(ds)) AS start_date, CASE WHEN len(fs) >= 2 THEN list_max(fs) END AS end_date FROM span")(smart_dates)

_CLOCK = "regexp_extract(body_txt, '([0-9]{1,2})[:：]([0-9]{2})\\s*[~至到-]?\\s*(?:([0-9]{1,2})[:：]([0-9]{2}))?', {})"


def _clock(h: int) -> str:
    a, b = _CLOCK.replace("{}", str(h)), _CLOCK.replace("{}", str(h + 1))
    return f"CASE WHEN try_cast({a} AS INT) < 24 AND try_cast({b} AS INT) < 60 THEN lpad({a}, 2, '0') || ':' || {b} END"


_simple("time_range", {"start_time": lambda: dates.time_range(F.col("body_txt"))["start"], "end_time": lambda: dates.time_range(F.col("body_txt"))["end"]}, f"{_clock(1)} AS start_time, CASE WHEN {_clock(1)} IS NOT NULL THEN {_clock(3)} END AS end_time")

_FREE = "regexp_matches(body_txt, '免[費票]|free|Free|FREE|自由入場')"
_PRICES = ["NT\\$?\\s*([0-9]{1,5})\\s*[~至到-]\\s*NT?\\$?\\s*([0-9]{1,5})", "票價[：:]?\\s*([0-9]{1,5})\\s*[~至到/-]\\s*([0-9]{1,5})", "票價[：:]?\\s*NT?\\$?\\s*([0-9]{1,5})", "([0-9]{3,5})\\s*元", "\\$([0-9]{3,5})"]
_LOW = f"CASE WHEN {_FREE} THEN 0 ELSE coalesce({', '.join(f'''nullif(regexp_extract(body_txt, '{p}', 1), '')''' for p in _PRICES)})::INT END"
_HIGH = f"CASE WHEN {_FREE} THEN 0 " + " ".join(f"WHEN regexp_matches(body_txt, '{p}') THEN regexp_extract(body_txt, '{p}', {2 if i < 2 else 1})::INT" for i, p in enumerate(_PRICES)) + " END"
_VENUE = first_hit("body_txt", [(v, v) for v, _ in dicts.VENUE_CITY])
_ADDRESS = "nullif(regexp_extract(body_txt, '(台北|新北|桃園|台中|台南|高雄|基隆|新竹|苗栗|彰化|南投|雲林|嘉義|屏東|宜蘭|花蓮|台東|澎湖|金門|連江)[市縣]?.{2,30}[路街道巷弄號樓]', %d), '')"
_HOST = "trim(regexp_replace(coalesce(" + ", ".join(f"nullif(regexp_extract(body_txt, '{p}[：:]\\s*(.{{2,30}})', 1), '')" for p in ("主辦[單位方]?", "指導單位", "協辦")) + "), '[，。,、；;\\s]+$', ''))"
_HOST = f"CASE WHEN length({_HOST}) BETWEEN 2 AND 30 THEN {_HOST} END"
_TYPE = first_hit("lower(type_txt)", dicts.EVENT_TYPE_KEYWORDS)
_VCITY = first_hit("body_txt", dicts.VENUE_CITY)
_simple("price", {"price_min": lambda: extract.price(F.col("body_txt"))["low"], "price_max": lambda: extract.price(F.col("body_txt"))["high"], "is_free": lambda: extract.price(F.col("body_txt"))["free"]}, f"{_LOW} AS price_min, {_HIGH} AS price_max, {_FREE} AS is_free")
_simple("venue_city", {"venue": lambda: extract.venue(F.col("body_txt")), "city": lambda: text.first_hit(F.col("body_txt"), dicts.VENUE_CITY)}, f"{_VENUE} AS venue, {_VCITY} AS city")
_simple("address", {"address": lambda: extract.address(F.col("body_txt"))}, f"{_ADDRESS % 0} AS address")
_simple("organizer", {"organizer": lambda: extract.organizer(F.col("body_txt"))}, f"{_HOST} AS organizer")
_simple("event_type", {"event_type": lambda: extract.event_type(F.col("type_txt"))}, f"{_TYPE} AS event_type")
_simple("city_extract", {"city": lambda: text.city_in(F.concat("city_txt", "body_txt"))}, f"coalesce({first_hit('city_txt || body_txt', dicts.VENUE_CITY)}, {first_hit('city_txt || body_txt', [(c, c) for c in dicts.TAIWAN_CITIES])}) AS city")
_simple("city_normalize", {"city": lambda: text.page_city(F.col("city_txt")), "alias_city": lambda: text.alias_city(F.col("city_txt"))},
        f"coalesce(CASE lower(trim(city_txt)) {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in dicts.CITY_ALIASES)} END, city_txt) AS city, coalesce({first_hit('lower(trim(city_txt))', sorted(dicts.CITY_ALIASES, key=lambda p: -len(p[0])))}, trim(city_txt)) AS alias_city")
_simple("district_extract", {"district": lambda: text.district_in(F.col("body_txt"))}, f"{first_hit('body_txt', [(d, d) for d, _ in dicts.DISTRICT_COORDS])} AS district")

_TXT = "(l.title || l.body_txt)"
_OVER = lambda sql: sql.replace("body_txt", _TXT) if "l.body_txt" not in sql else sql
_INFO = f"""{LISTED}, near AS (SELECT listing_id, {re.sub("title", "(title || body_txt)", _NEAR)} AS ds FROM listing), span AS (SELECT *, list_filter(ds, lambda d: d >= {_DAY}) AS fs FROM near),
facts AS (SELECT span.listing_id, coalesce(list_min(fs), list_max(ds)) AS a, CASE WHEN len(fs) >= 2 THEN list_max(fs) END AS b, {_OVER(_clock(1))} AS c, {_OVER(_VENUE)} AS v, coalesce({_OVER(_VCITY)}, {_OVER(_ADDRESS % 1)}) AS city,
  {_OVER(_LOW)} AS low, {_OVER(_FREE)} AS free, {_OVER(_HOST)} AS host, {first_hit(f"lower({_TXT})", dicts.EVENT_TYPE_KEYWORDS)} AS kind FROM span JOIN listing l USING (listing_id)),
points AS (SELECT *, ((a IS NOT NULL)::INT * 20 + (b IS NOT NULL)::INT * 10 + (c IS NOT NULL)::INT * 10 + (v IS NOT NULL)::INT * 15 + (city IS NOT NULL)::INT * 10 + (low IS NOT NULL)::INT * 20 + (host IS NOT NULL)::INT * 10 + (kind IS NOT NULL)::INT * 5)::DOUBLE AS completeness FROM facts)"""


def _info():
    return extract.event_info(F.concat("title", "body_txt"), _t())


def completeness(spark, sf_dir):
    rows = listing(spark, sf_dir).select("listing_id", _info().alias("i"))
    return rows.select("listing_id", "i.city", "i.completeness", F.round(ranking.completeness_bonus(F.col("i")), 4).alias("bonus"))


query(f"{_INFO} SELECT listing_id, city, completeness, round(0.2 * completeness + CASE WHEN low IS NOT NULL OR free THEN 5 ELSE 0 END + CASE WHEN v IS NOT NULL THEN 3 ELSE 0 END, 4) AS bonus FROM points")(completeness)

# Filters

_FOREIGN = f"len(list_filter({words(dicts.FOREIGN_KEYWORDS)}, lambda w: contains(title, w))) >= 2"
_TAIWAN = f"(len(list_filter({words(['台灣', '臺灣', *dicts.TAIWAN_LANDMARKS, *dicts.TAIWAN_CITIES, *(v for v, _ in dicts.VENUE_CITY)])}, lambda w: contains(title, w))) > 0)"
_simple("filter_foreign", {"is_foreign": lambda: extract.foreign(F.col("title")), "in_taiwan": lambda: extract.in_taiwan(F.col("title")), "likely_foreign": lambda: extract.likely_foreign(F.col("title"))}, f"{_FOREIGN} AS is_foreign, {_TAIWAN} AS in_taiwan, ({_FOREIGN} AND NOT {_TAIWAN}) AS likely_foreign")
_NOISE = f"(len(list_filter({words(dicts.NOISE_KEYWORDS)}, lambda w: contains(title, w))) > 0)"
_APPLY = f"(len(list_filter({words(dicts.APPLICATION_KEYWORDS)}, lambda w: contains(title, w))) > 0)"
_simple("filter_noise", {"is_noise": lambda: extract.noise(F.col("title")), "is_application": lambda: extract.application(F.col("title"))}, f"{_NOISE} AS is_noise, {_APPLY} AS is_application")
_SPAM = "(regexp_matches(lower({0}), '機票|航班|飛往|cheap flights|airfare') OR (regexp_matches(lower({0}), '航空|airline') AND NOT regexp_matches(lower({0}), '[展節祭]|活動')) OR (contains({0}, '特價優惠') AND contains({0}, '預訂')))"
_ADS = ["", " 機票", " 航空", " airline 活動", " 特價優惠", " 特價優惠 預訂", " Cheap Flights"]
_AD = "(title || CASE listing_id % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_ADS)) + " END)"
_simple("filter_spam", {"spam": lambda: extract.travel_spam(F.concat("title", F.get(F.array(*map(F.lit, _ADS)), F.col("listing_id") % 7))), "ham": lambda: extract.travel_spam(F.col("title"))}, f"{_SPAM.format(_AD)} AS spam, {_SPAM.format('title')} AS ham")
_simple("validate_query", {"problem": lambda: extract.valid_query(F.concat("city_txt", F.when(F.col("listing_id") % 5 == 0, "; drop").when(F.col("listing_id") % 5 == 1, "<script>").otherwise("")))},
        "CASE WHEN length(city_txt || s) < 2 THEN 'short' WHEN contains(s, '<script') THEN 'markup' WHEN contains(s, ';') THEN 'sql' ELSE '' END AS problem".replace("s)", "CASE WHEN listing_id % 5 = 0 THEN '; drop' WHEN listing_id % 5 = 1 THEN '<script>' ELSE '' END)").replace("contains(s,", "contains(CASE WHEN listing_id % 5 = 0 THEN '; drop' WHEN listing_id % 5 = 1 THEN '<script>' ELSE '' END,"))
_simple("title_tokens", {"tokens": lambda: F.array_join(text.tokens(F.col("type_txt")), " ")}, "")

# Requests

_REQ = "city_txt || type_txt"
_AT = "NULL::DATE AS target"
_simple("query_city", {"city": lambda: requests.city_of(F.concat("city_txt", "type_txt")), "event_type": lambda: requests.type_of(F.concat("city_txt", "type_txt"))},
        f"coalesce({first_hit(_REQ, [(c, c) for c in dicts.TAIWAN_CITIES])}, {first_hit(f'lower({_REQ})', dicts.CITY_ALIASES)}) AS city, {first_hit(_REQ, [(t, t) for t in dicts.EVENT_TYPES])} AS event_type")
_SYN = " || ".join(f"CASE WHEN contains({_REQ}, '{k}') AND NOT contains({_REQ}, '{v[0]}') THEN ' {v[0]}' ELSE '' END" for k, v in dicts.SYNONYMS.items())
_simple("query_expand", {"expanded": lambda: requests.expand(F.concat("city_txt", "type_txt"), _t())}, f"trim({_REQ} || {_SYN} || CASE WHEN regexp_matches(lower({_REQ}), '活動|event|展覽|演唱會|市集') THEN '' ELSE ' 活動' END) AS expanded")
_PLACE = f"(len(list_filter({words(dicts.REFINE_PLACE_WORDS)}, lambda w: contains(q, w))) > 0 AND len(list_filter({words([t.lower() for t in dicts.EVENT_TERMS])}, lambda w: contains(lower(q), w))) = 0)"


def query_refine(spark, sf_dir):
    return listing(spark, sf_dir).select("listing_id", requests.refine(F.concat("city_txt", "date_txt"), _t()).alias("refined"))


query(f"""{LISTED}, r AS (SELECT listing_id, trim(city_txt || date_txt) AS q FROM listing),
k AS (SELECT listing_id, q, CASE WHEN {_PLACE} THEN q || ' (市集 OR 展覽 OR 演唱會 OR 音樂節 OR 活動 OR 演出 OR 表演)' ELSE q END AS s FROM r)
SELECT listing_id, CASE WHEN q = '' THEN q WHEN contains(s, '2024') THEN replace(s, '2024', '(2024 OR 2025)') WHEN regexp_matches(s, '202[0-4]') THEN s ELSE s || ' (2024 OR 2025)' END AS refined FROM k""")(query_refine)


def query_intent(spark, sf_dir):
    q = F.concat("city_txt", "type_txt", "body_txt")
    return listing(spark, sf_dir).select("listing_id", F.array_join(requests.intents(q, _t()), " ").alias("intents"))


_ALLREQ = "city_txt || type_txt || body_txt"
query(f"""{LISTED}, i AS (SELECT listing_id, concat_ws(' ',
  CASE WHEN regexp_matches({_ALLREQ}, '今天|明天|週末') THEN 'DATE' END,
  CASE WHEN coalesce({first_hit(_ALLREQ, [(c, c) for c in dicts.TAIWAN_CITIES])}, {first_hit(f'lower({_ALLREQ})', dicts.CITY_ALIASES)}, {first_hit(_ALLREQ, dicts.VENUE_CITY)}) IS NOT NULL THEN 'PLACE' END,
  CASE WHEN {first_hit(_ALLREQ, [(t, t) for t in dicts.EVENT_TYPES])} IS NOT NULL THEN 'TYPE' END,
  CASE WHEN regexp_matches(lower({_ALLREQ}), '免費|free') THEN 'FREE' END) AS s FROM listing)
SELECT listing_id, CASE WHEN s = '' THEN 'FIND_EVENT' ELSE s END AS intents FROM i""")(query_intent)


def query_parse(spark, sf_dir):
    p = requests.parse(F.concat("city_txt", "type_txt", "date_txt"), _t())
    rows = listing(spark, sf_dir).select("listing_id", p.alias("p"))
    return rows.select("listing_id", "p.original_query", "p.expanded_query", "p.primary_intent", "p.city", "p.event_type", "p.target_date", "p.range_start", "p.range_end", "p.wants_free")


query()(query_parse)
_simple("query_suggest", {"suggestions": lambda: F.array_join(requests.suggest(F.concat("city_txt", "type_txt"), F.col("city_txt")), " ")}, "")
_simple("related_queries", {"related": lambda: F.array_join(requests.related(F.concat("city_txt", "type_txt")), "|")}, "")
_simple("query_tokens", {"tokens": lambda: F.array_join(text.query_tokens(F.concat_ws(" ", "city_txt", "type_txt")), " ")}, "")

# Scores

_PROD = "coalesce(CASE " + " ".join(f"WHEN contains(title, '{k}') THEN {v}" for k, v in dicts.EVENT_TYPE_BOOST) + " END, 1.0)"
_FACTOR = f"""CASE WHEN day < {_DAY} OR {_NOISE} OR coalesce(nullif(regexp_extract(title, '(201[0-9]|202[0-3])年?(?:全台|精選|最新|整理|市集|展覽|演唱會|音樂節)', 1), '')::INT < 2023, false) THEN 0.0
  ELSE CASE WHEN trim(city_txt) <> '' THEN 1.15 ELSE 1.08 END * CASE WHEN {_APPLY} THEN 0.15 ELSE 1.0 END * {_PROD} * CASE WHEN trim(city_txt) = '' THEN 1.0 WHEN city_txt = '台北' THEN 1.25 ELSE 0.6 END END"""
_DATE = f"CASE WHEN day < {_DAY} THEN 0.0 WHEN day - {_DAY} <= 30 THEN 25.0 WHEN day - {_DAY} <= 90 THEN 15.0 ELSE 8.0 END"
_FACTOR, _DATE = (re.sub(r"(?<![0-9])([0-9]+\.[0-9]+)", r"\1e0", x) for x in (_FACTOR, _DATE))
_simple("date_score", {"points": lambda: ranking.date_score(F.col("day"), _t(), F.struct(F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end")))}, f"({_DATE})::DOUBLE AS points")
_simple("multiplier", {"factor": lambda: F.round(_factor(), 6)}, f"round(({_FACTOR})::DOUBLE, 6) AS factor")


def _factor():
    return ranking.multiplier(F.col("title"), F.lit(""), F.col("city_txt"), F.col("day"), F.lit("台北"), _t())


_HITS = "(contains(title, '台北')::INT + contains(title, '展覽')::INT + contains(title, '駁二')::INT)"
_INBODY = "((contains(body_txt, '台北') AND NOT contains(title, '台北'))::INT + (contains(body_txt, '展覽') AND NOT contains(title, '展覽'))::INT + (contains(body_txt, '駁二') AND NOT contains(title, '駁二'))::INT)"
_TEXT = f"""(CASE WHEN contains(title, '台北展覽') THEN 40 WHEN contains(body_txt, '台北展覽') THEN 15 ELSE 0 END + CASE WHEN {_HITS} / 3.0 >= 0.5 THEN 25 WHEN {_HITS} > 0 THEN 12 ELSE 0 END
  + CASE WHEN {_HITS} = 0 AND {_INBODY} = 0 THEN -20 ELSE 5 * least({_INBODY}, 3) END + CASE WHEN contains(title, '駁二') THEN 12 WHEN contains(body_txt, '駁二') THEN 4 ELSE 0 END
  + CASE WHEN {_FOREIGN.replace('title', "(title || ' ' || body_txt)")} AND NOT {_TAIWAN.replace('title', "(title || ' ' || body_txt)")} THEN -40 ELSE 0 END)::DOUBLE"""


def _text_points():
    return ranking.text_score(F.col("title"), F.col("body_txt"), F.lit("台北展覽"), F.array(F.lit("台北"), F.lit("展覽"), F.lit("駁二")))


_simple("text_score", {"points": _text_points}, f"{_TEXT} AS points")


def _ranked(spark, sf_dir):
    rows = listing(spark, sf_dir).withColumn("query_id", F.col("listing_id") % 50)
    none = F.struct(F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end"))
    total = ranking.final_score(F.col("score"), _text_points(), ranking.date_score(F.col("day"), _t(), none), F.lit(0.0), _factor())
    # held: filters, windows and the norm use the score some five times
    return held(rows, total=ranking.half_up(total, 4)).select("query_id", "listing_id", F.col("total").alias("score"))


_FINAL = f"{LISTED}, f AS (SELECT listing_id % 50 AS query_id, listing_id, floor(greatest(0e0, (score + {_TEXT} + {_DATE}) * {_FACTOR}) * 1e4 + 0.5e0) / 1e4 AS score FROM listing)"
_NORM = f"{_FINAL}, n AS (SELECT query_id, listing_id, floor(((score - min(score) OVER w) / CASE WHEN max(score) OVER w - min(score) OVER w < 0.001 THEN 1 ELSE max(score) OVER w - min(score) OVER w END * 90 + 10) * 10 + 0.5) / 10 AS score FROM f WHERE score > 0.01 WINDOW w AS (PARTITION BY query_id))"


@query(f"{_FINAL} SELECT * FROM f")
def rank_final(spark, sf_dir):
    return _ranked(spark, sf_dir)


@query(f"{_NORM} SELECT * FROM n")
def rank_normalized(spark, sf_dir):
    return ranking.normalise(_ranked(spark, sf_dir))


@query(f"{_NORM} SELECT query_id, listing_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, listing_id) AS rank, count(*) OVER (PARTITION BY query_id) AS total_count, ceil(count(*) OVER (PARTITION BY query_id) / 10.0)::INT AS total_pages FROM n QUALIFY rank BETWEEN 11 AND 20")
def paginate(spark, sf_dir):
    return ranking.paginate(ranking.normalise(_ranked(spark, sf_dir)), F.lit(2), order=(F.col("score").desc(), F.col("listing_id")))


@query(f"{LISTED} SELECT listing_id, CASE WHEN listing_id % 40 <= 0 THEN 20.0 ELSE greatest(0.0, 10 - 0.5 * (listing_id % 40 - 1)) END::DOUBLE AS points FROM listing")
def freshness(spark, sf_dir):
    return listing(spark, sf_dir).select("listing_id", ranking.freshness(F.col("listing_id") % 40).alias("points"))
