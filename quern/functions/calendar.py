"""Solar Hijri and Gregorian dates, partial dates and dates in prose."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import fold_digits

#: Words around years in prose.
MONTHS = "فروردین|اردیبهشت|خرداد|تیر|مرداد|شهریور|مهر|آبان|آذر|دی|بهمن|اسفند"
NOT_DEATH_BEFORE = r"متولد|تولد|زاده|زادهٔ|ورودی|ورود|سال\s*تولد|سن|ساله|اردیبهشت\s*$"
NOT_DEATH_AFTER = r"^\s*(?:به\s*دنیا|متولد|تولد|زاده|–|-|تا\s|د\s*دنیا)"
DEATH_WORDS = "جان[\\s‌]?باخت|جان[\\s‌]?فدا|کشته|شهید\\s*شد|اعدام|به[\\s‌]?قتل|به\\s*خاک\\s*سپرده|تیرباران"
DEY_YEAR = "دی[\\s‌]*(?:ماه|مَاه)?[\\s‌]*(1[34]\\d{2})"
BIRTH_BEFORE, BIRTH_AFTER = "متولد|زاده|زادهٔ|تولد", "به دنیا آمد|متولد شد|زاده شد"
ANNIVERSARY, OTHERS = r"(?:سالگرد|سالروز|ورودی|دانشجوی?\s*ورودی)", r"(?:مزار|آرامگاه|جان‌باختگان|جانباختگان)\s"
FIRST_YEAR, LAST_YEAR = 1357, 1405
#: Fixed values of the 33-year rule: the cycle's first year, its years, its first day (since 1970) and its days.
CYCLE, CYCLE_YEARS, FIRST_DAY, DAYS = 1210, 425, -50690, 155228
#: Days of 33 years, of which each fourth but the last is a leap year, and of four years.
DAYS_33, DAYS_4 = 12053, 1461


def month_day(c: Column) -> Column:
    """struct(month, day) of the first y/m/d or y-m-d in a text, else null."""
    t, p = fold_digits(c), r"\d{2,4}[/-](\d{1,2})[/-](\d{1,2})"
    m = F.regexp_extract(t, p, 1).try_cast("int")
    return F.when(m.isNotNull(), F.struct(m.alias("month"), F.regexp_extract(t, p, 2).try_cast("int").alias("day")))


def full_date(c: Column) -> Column:
    return F.nullif(F.regexp_extract(fold_digits(c), r"\d{3,4}[/-]\d{1,2}[/-]\d{1,2}", 0), F.lit(""))


def month_day_text(c: Column) -> Column:
    """``/m/d`` as it is written, for comparing as text."""
    return F.nullif(F.regexp_extract(fold_digits(c, False), r"/\d{1,2}/\d{1,2}", 0), F.lit(""))


def jalali_year(c: Column, mode: str = "prefix") -> Column:
    """Year of a partial date: ``prefix`` 13xx or 14xx; ``month`` with a month, 1370 to 1410; ``full`` with month and day.

    ``month`` is the first pass's, which takes months 10 and later of 1400 for a misread 1404.
    """
    pattern = {"prefix": r"^(1[34]\d\d)", "month": r"^(1[34]\d\d)\s*/\s*(\d{1,2})", "full": r"^(\d{3,4})/\d{1,2}/\d{1,2}"}[mode]
    y = F.regexp_extract(fold_digits(c, mode != "month"), pattern, 1).try_cast("int")
    if mode != "month":
        return y
    month = F.regexp_extract(fold_digits(c, False), pattern, 2).try_cast("int")
    return F.when((y == 1400) & (month >= 10), 1404).when(y.between(1370, 1410), y)


def has_month(c: Column) -> Column:
    m = F.regexp_extract(fold_digits(c), r"^1[34]\d\d/(\d{1,2})/\d{1,2}", 1).try_cast("int")
    return F.coalesce(m.between(1, 12), F.lit(False))


def approx_jalali_year(c: Column) -> Column:
    """Of an ISO date of 1990 to 2030: year less 621 from April on, else 622. Late March is off by one."""
    y, m = (F.regexp_extract(c, r"^(\d{4})-(\d{2})", i).try_cast("int") for i in (1, 2))
    return F.when(y.between(1990, 2030), F.when(m >= 4, y - 621).otherwise(y - 622))


def from_jalali(y: Column, m: Column, d: Column) -> Column:
    """Gregorian date of a Solar Hijri one; null outside the calendar, years 1210 to 1634."""
    n = y - CYCLE
    at = n % 33
    leap = (at % 4 == 0) & (at != 32) & (n != CYCLE_YEARS - 1)
    last = F.when(m <= 6, 31).when((m <= 11) | leap, 30).otherwise(29)
    ok = n.between(0, CYCLE_YEARS - 1) & m.between(1, 12) & d.between(1, last)
    # a group of four years begins with its leap year
    days = F.floor(n / 33) * DAYS_33 + F.floor(at / 4) * DAYS_4 + F.when(at % 4 == 0, 0).otherwise(at % 4 * 365 + 1)
    days += (m - 1) * 30 + F.least(m - 1, F.lit(6)) + d - 1
    return F.when(ok, F.date_from_unix_date((days + FIRST_DAY).cast("int")))


def to_jalali(c: Column) -> Column:
    """struct(y, m, d) of a Gregorian date; its fields are null outside the years 1210 to 1634."""
    n = F.unix_date(c) - FIRST_DAY
    n = F.when(n.between(0, DAYS - 1), n)
    r = n % DAYS_33
    s = r % DAYS_4
    first = s < 366
    y = CYCLE + F.floor(n / DAYS_33) * 33 + F.floor(r / DAYS_4) * 4 + F.when(first, 0).otherwise(F.floor((s - 1) / 365))
    k = F.when(first, s).otherwise((s - 1) % 365)
    m = F.when(k < 186, F.floor(k / 31) + 1).otherwise(F.floor((k - 186) / 30) + 7)
    d = F.when(k < 186, k % 31 + 1).otherwise((k - 186) % 30 + 1)
    return F.when(c.isNotNull(), F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d")))


def jalali_text(c: Column) -> Column:
    j = to_jalali(c)
    return F.when(c.isNotNull(), F.format_string("%d/%02d/%02d", j["y"], j["m"], j["d"]))


def parse_wd_time(c: Column) -> Column:
    """Date of +YYYY-MM-DDT...: from 1900, month and day given and valid; else null."""
    p = r"^\+?(\d{4})-(\d{2})-(\d{2})T"
    y, m, d = (F.regexp_extract(c, p, i) for i in (1, 2, 3))
    ok = (y.try_cast("int") >= 1900) & (m != "00") & (d != "00")
    return F.when(ok, F.try_to_date(F.concat_ws("-", y, m, d)))


def relative_time(c: Column, now: Column) -> Column:
    """struct(unit, n): now, minutes, hours, days, or months of thirty days."""
    s = F.unix_timestamp(now) - F.unix_timestamp(c)
    step = lambda unit, size: F.struct(F.lit(unit).alias("unit"), F.floor(s / size).cast("long").alias("n"))
    return (
        F.when(s.isNull(), None)
        .when(s < 60, F.struct(F.lit("now").alias("unit"), F.lit(0).cast("long").alias("n")))
        .when(s < 3600, step("minute", 60)).when(s < 86400, step("hour", 3600)).when(s < 2592000, step("day", 86400)).otherwise(step("month", 2592000))
    )


_FOLD = str.maketrans("۰۱۲۳۴۵۶۷۸۹", "0123456789")
_re = {
    k: re.compile(v) for k,
    v in {
        "before": NOT_DEATH_BEFORE, "after": NOT_DEATH_AFTER, "death": DEATH_WORDS, "dey": DEY_YEAR, "year": "13[0-9]{2}|14[0-9]{2}",
        "bb": BIRTH_BEFORE, "ba": BIRTH_AFTER, "an": ANNIVERSARY, "ob": OTHERS, "dmy": rf"\d{{1,2}}\s*(?:{MONTHS})\s*(13[7-9][0-9]|140[0-9])"
    }.items()
}


def read_story_year(text: str | None) -> tuple[int | None, str | None]:
    """Year of death that a story tells, and how surely: high, medium or weak."""
    t = (text or "").translate(_FOLD)

    def about_life(a: int, b: int, back: int) -> bool:
        return bool(_re["before"].search(t[max(0, a - back) : a]) or _re["after"].search(t[b : b + 12]))

    inside = lambda y: FIRST_YEAR <= y <= LAST_YEAR
    explicit = (int(m[1]) for m in _re["dey"].finditer(t) if inside(int(m[1])) and not about_life(m.start(), m.end(), 18))
    y = next(explicit, None)
    if y is not None:
        return y, "high"
    seen = [(int(m[0]), m.start()) for m in _re["year"].finditer(t) if inside(int(m[0])) and not about_life(m.start(), m.end(), 16)]
    if len({y for y, _ in seen}) != 1:
        return None, None
    near = any(_re["death"].search(t[max(0, at - 35) : at + 10]) for _, at in seen)
    return seen[0][0], "medium" if near else "weak"


def read_story_year_v1(text: str | None) -> int | None:
    """The one year that day, month and year in a story name, outside births, anniversaries and others' graves."""
    t = (text or "").translate(_FOLD)
    years = set()
    for m in _re["dmy"].finditer(t):
        before, after = t[max(0, m.start() - 28) : m.start()], t[m.end() : m.end() + 18]
        if not (_re["bb"].search(before) or _re["ba"].search(after) or _re["an"].search(before) or _re["ob"].search(before)):
            years.add(int(m[1]))
    return years.pop() if len(years) == 1 else None


#: A year of the century in digits of any script; a story without one tells none.
HAS_YEAR = r"[1۱][34۳۴]\p{Nd}{2}"


def tells_year(story: Column) -> Column:
    """The story if it has a year at all, else null, which Python passes over."""
    return F.when(story.rlike(HAS_YEAR), story)


@F.pandas_udf(T.StructType([T.StructField("year", T.IntegerType()), T.StructField("conf", T.StringType())]))
def story_year(c: pd.Series) -> pd.DataFrame:
    got = [read_story_year(x) for x in c]
    return pd.DataFrame({"year": pd.array([y for y, _ in got], dtype="Int32"), "conf": [k for _, k in got]})


@F.pandas_udf(T.IntegerType())
def story_year_v1(c: pd.Series) -> pd.Series:
    return pd.Series([read_story_year_v1(x) for x in c], dtype="Int32")


def best_year(date_jalali: Column, date_gregorian: Column, story: Column) -> Column:
    """struct(year, source), the most trusted first: Jalali date, Gregorian date, story's year (a column)."""
    tag = lambda y, s: F.when(y.isNotNull(), F.struct(y.cast("int").alias("year"), F.lit(s).alias("source")))
    return F.coalesce(tag(jalali_year(date_jalali, "month"), "dj"), tag(approx_jalali_year(date_gregorian), "dg"), tag(story, "story"))
