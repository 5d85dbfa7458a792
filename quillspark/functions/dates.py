"""Dates and times in text: Gregorian, ROC calendar and relative; ``today`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dicts
from .text import first_hit, text_of

MONTH, DAY = "(0?[1-9]|1[0-2])", "(0?[1-9]|[12][0-9]|3[01])"
YEAR = "(20[2-9][0-9])"
_ROC = "(1[0-9][0-9])"
_TYPES = "活動 市集 展覽 演唱 音樂 聖誕 跨年 春節 節 祭".split()
_CONTEXT_AFTER = "全台 精選 最新 活動 整理 市集 展覽 大賞 節 懶人包".split()
FULL = f"{YEAR}[-/.年]{MONTH}[-/.月]{DAY}"
ROC_FULL = f"{_ROC}年(?:{MONTH}月{DAY}日?)?"
BARE = rf"(?<![0-9]){MONTH}[/月]{DAY}(?:日|\s|\)|$)"
CONTEXT_YEAR = rf"(?:^|[\s【\[(#]){YEAR}(?:$|[\s】\])年]|{'|'.join(_CONTEXT_AFTER)})"
ROC_EVENT = f"{_ROC}年度?(?:原|{'|'.join(('市集', '活動', '展覽', '好市'))})"
YEAR_EVENT = rf"{YEAR}(?:年|\s|#)*(?:{'|'.join(_TYPES)})"
_YEAR_THEN = rf"{YEAR}(?:年|\s|#)*(?:{'|'.join('台 活動 花 聖誕 跨年 春節 演唱 展覽 市集 節 祭'.split())}).{{0,30}}?{MONTH}月{DAY}日?"
_POSTED = rf"(?:{'|'.join(x + '日期' for x in ('張貼', '發布', '更新'))}|發佈)[：:]?\s*(20[12][0-9])[/.\-]{MONTH}[/.\-]{DAY}"
TIMES = r"([0-9]{1,2})[:：]([0-9]{2})\s*[~至到-]?\s*(?:([0-9]{1,2})[:：]([0-9]{2}))?"


def _some(s: Column) -> Column:
    return F.nullif(s, F.lit(""))


def make_date(y: Column, m: Column, d: Column) -> Column:
    """A date, or null where there is no such day."""
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def _all(t: Column, pattern: str) -> Column:
    """All matches of a pattern: one scan of the text; groups are read from the short matches."""
    return F.regexp_extract_all(t, F.lit(pattern), F.lit(0))


def _dates(matches: Column, pattern: str, made) -> Column:
    """``made`` of the groups (a function of the number) of each match, without nulls."""
    return F.filter(F.transform(matches, lambda m: made(lambda g: F.regexp_extract(m, pattern, g))), lambda d: d.isNotNull())


def _ymd(group) -> Column:
    return make_date(group(1), group(2), group(3))


def full_dates(text: Column) -> Column:
    """All dates with a year of 2020 to 2099."""
    return _dates(_all(text_of(text), FULL), FULL, _ymd)


def roc_dates(text: Column) -> Column:
    """Dates of the ROC calendar; a year alone stands for its last day."""
    full = lambda x, other: F.coalesce(_some(x), F.lit(other))
    return _dates(_all(text_of(text), ROC_FULL), ROC_FULL, lambda g: make_date(g(1).cast("int") + 1911, full(g(2), "12"), full(g(3), "31")))


def context_year(text: Column) -> Column:
    return _some(F.regexp_extract(text_of(text), CONTEXT_YEAR, 1)).cast("int")


def bare_dates(text: Column, today: Column) -> Column:
    """Month and day without a year, in the year of an event named, else the context's, else the current one."""
    t = text_of(text)
    year = F.coalesce(_some(F.regexp_extract(t, YEAR_EVENT, 1)).cast("int"), context_year(t), F.year(today))
    return _dates(_all(t, BARE), BARE, lambda g: make_date(year, g(1), g(2)))


def weekday_date(text: Column, today: Column) -> Column:
    """The next such weekday after today, a week later after 下; Monday is looked for first."""
    t = text_of(text)
    out = F.lit(None).cast("date")
    for k, names in reversed(list(enumerate("一 二 三 四 五 六 日天".split()))):
        one = f"[{names}]"
        pattern = f"([這本下]?)(?:[週周]{names[0]}|星期{one}|禮拜{one})"
        ahead = (F.lit(k) - F.weekday(today) + 7) % 7
        ahead = F.when(ahead == 0, 7).otherwise(ahead)
        later = F.when(F.regexp_extract(t, pattern, 1) == "下", 7).otherwise(0)
        out = F.when(t.rlike(pattern), F.date_add(today, (ahead + later).cast("int"))).otherwise(out)
    return out


def saturday(today: Column) -> Column:
    return F.next_day(F.date_sub(today, 1), "SAT")


def relative_date(text: Column, today: Column) -> Column:
    t = text_of(text)
    return (
        F.when(t.rlike("今[天日]"), today).when(t.rlike("明[天日]"), F.date_add(today, 1)).when(F.contains(t, F.lit("後天")), F.date_add(today, 2))
        .when(t.rlike("[這本]週末|這個週末|本周末"), saturday(today)).when(t.rlike("下[週周]末|下個週末"), F.date_add(saturday(today), 7)).otherwise(weekday_date(t, today))
    )


def parse_date(text: Column, today: Column) -> Column:
    """One date for a text, by the cascade: ROC year of an event, relative words, the day of an old post, explicit dates, hints; or null."""
    t = text_of(text)
    context = context_year(t)
    roc_year = _some(F.regexp_extract(t, ROC_EVENT, 1)).cast("int")
    roc = F.when(roc_year < F.year(today) - 1911 - 1, make_date(roc_year + 1911, F.lit(12), F.lit(31)))
    year_then = _dates(_all(t, _YEAR_THEN), _YEAR_THEN, _ymd)
    posted_year = _some(F.regexp_extract(t, _POSTED, 1)).cast("int")
    posted = F.when(posted_year < F.year(today) - 1, make_date(posted_year, F.regexp_extract(t, _POSTED, 2), F.regexp_extract(t, _POSTED, 3)))
    dated = F.concat(roc_dates(t), full_dates(t), year_then)
    dated = F.when(F.size(dated) > 0, dated).otherwise(bare_dates(t, today))
    years = F.transform(F.regexp_extract_all(t, F.lit(f"(?<![0-9]){YEAR}(?![0-9])"), F.lit(1)), lambda y: y.cast("int"))
    rescue = F.array_max(F.filter(years, lambda y: y > F.year(today)))
    hint = F.when(t.rlike("即日起|常設展|長期展出"), F.date_add(today, 30)).when(context < F.year(today), make_date(context, F.lit(12), F.lit(31)))
    chosen = F.coalesce(F.array_min(F.filter(dated, lambda d: d >= today)), make_date(rescue, F.lit(1), F.lit(1)), F.array_max(dated))
    return F.coalesce(roc, relative_date(t, today), posted, F.when(F.size(dated) > 0, chosen).otherwise(hint))


_N, _TO = "([0-9]{1,2})", r"\s*[~至到-]\s*"
_NUMERIC, _ROC_DAY = f"([0-9]{{4}})[/.-]{_N}[/.-]{_N}", f"([0-9]{{2,3}})年{_N}月{_N}日?"
#: Of a range only the start is read; the day alone is read once more by the forms of a single day.
_SMART = [
    rf"{_NUMERIC}{_TO}[0-9]{{4}}[/.-][0-9]{{1,2}}[/.-][0-9]{{1,2}}", rf"{_NUMERIC}{_TO}[0-9]{{1,2}}[/.-][0-9]{{1,2}}", rf"{_ROC_DAY}{_TO}[0-9]{{2,3}}年[0-9]{{1,2}}月[0-9]{{1,2}}日?",
    rf"{_ROC_DAY}{_TO}[0-9]{{1,2}}月[0-9]{{1,2}}日?", _ROC_DAY, _NUMERIC, f"([0-9]{{4}})年{_N}月{_N}日",
]
_SMART_BARE = f"{_N}月{_N}日"


def smart_dates(text: Column, today: Column) -> Column:
    """struct<start, end> from all date forms: years under 200 are ROC; a day over a year ago is ignored.

    A day without a year is of this one, or of the next in November and December if it is in January or February.
    The end is the latest of two future matches or more; a range counts its start twice.
    """
    t = text_of(text)

    def own(g):
        y = g(1).cast("int")
        return make_date(F.when(y < 200, y + 1911).otherwise(y), g(2), g(3))

    def bare(g):
        return make_date(F.year(today) + F.when((F.month(today) >= 11) & (g(1).cast("int") <= 2), 1).otherwise(0), g(1), g(2))

    found = F.concat(*(_dates(_all(t, p), p, own) for p in _SMART), _dates(_all(t, _SMART_BARE), _SMART_BARE, bare))
    near = F.filter(found, lambda x: x >= F.date_sub(today, 365))
    future = F.filter(near, lambda x: x >= today)
    start = F.coalesce(F.array_min(future), F.array_max(near))
    return F.struct(start.alias("start"), F.when(F.size(future) >= 2, F.array_max(future)).alias("end"))


def time_range(text: Column) -> Column:
    """struct<start, end> as HH:mm; an end that is no time doesn't undo the start."""
    g = [F.regexp_extract(text_of(text), TIMES, i) for i in (1, 2, 3, 4)]

    def clock(h: Column, m: Column) -> Column:
        good = (_some(h).cast("int") < 24) & (_some(m).cast("int") < 60)
        return F.when(good, F.concat(F.lpad(h, 2, "0"), F.lit(":"), m))

    start = clock(g[0], g[1])
    return F.struct(start.alias("start"), F.when(start.isNotNull(), clock(g[2], g[3])).alias("end"))


def query_range(query: Column, today: Column) -> Column:
    """struct<target, start, end> of what a request says about time; a month over 12 gives none."""
    q = F.lower(text_of(query))
    none = F.lit(None)
    span = lambda target, start, end: F.struct(target.cast("date").alias("target"), start.cast("date").alias("start"), end.cast("date").alias("end"))
    year = F.year(today)
    month = _some(F.regexp_extract(q, "([0-9]{1,2})月", 1)).cast("int")
    of_month = make_date(year + F.when(month < F.month(today), 1).otherwise(0), month, F.lit(1))
    first, sat = F.trunc(today, "month"), saturday(today)
    noel = year + F.when((F.month(today) == 12) & (F.dayofmonth(today) > 25), 1).otherwise(0)
    winter = F.when(F.month(today) >= 11, year).otherwise(year - 1)
    lunar = F.when(F.month(today) > 2, year + 1).otherwise(year)
    day = first_hit(q, dicts.WEEKDAY_MAP).cast("int")
    weekday = F.date_add(today, ((day - 1 - F.weekday(today) + 7) % 7).cast("int"))
    fixed = lambda y, m, d: make_date(y, F.lit(m), F.lit(d))
    return (
        F.when(q.rlike("今天|today"), span(today, none, none)).when(q.rlike("明天|tomorrow"), span(F.date_add(today, 1), none, none))
        .when(q.rlike("[週周]末|weekend"), span(none, sat, F.date_add(sat, 1)))
        .when(q.rlike("這個月|本月"), span(none, today, F.last_day(today)))
        .when(q.rlike("下個?月"), span(none, F.add_months(first, 1), F.last_day(F.add_months(first, 1))))
        .when(month.isNotNull(), span(none, of_month, F.last_day(of_month)))
        .when(q.rlike("[聖耶]誕|christmas"), span(none, fixed(noel, 12, 20), fixed(noel, 12, 26)))
        .when(q.rlike("跨年|新年|元旦"), span(none, fixed(winter, 12, 28), fixed(winter + 1, 1, 3)))
        .when(q.rlike("春節|過年"), span(none, fixed(lunar, 1, 20), fixed(lunar, 2, 15)))
        .when(day.isNotNull(), span(weekday, none, none))
        .otherwise(span(none, none, none))
    )
