"""Faceted browsing: filter, search, stable sort, page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.empties import empty_text, truthy
from quern.functions.text import host, link_kind, to_native_digits, truncate

SEARCHED = ("name", "name_en", "city", "province", "cause", "occupation", "story")
#: Age buckets, both bounds within.
BUCKETS = {"child": (None, 17), "youth": (18, 30), "adult": (31, 50), "senior": (51, None)}


@dataclass(frozen=True)
class BrowseQuery:
    """One browse request; ``all`` and empty text switch a facet off."""

    event: str = "all"
    verification: str = "all"
    gender: str = "all"
    province: str = "all"
    age: str = "all"
    photo: bool = False
    notable: bool = False
    text: str = ""
    sort: str = "age"
    offset: int = 0
    limit: int = 48


def in_bucket(age: Column, bucket: str) -> Column:
    """A null age is in no bucket; an unknown bucket holds every age there is."""
    low, high = BUCKETS.get(bucket, (None, None))
    ok = age.isNotNull()
    if low is not None:
        ok &= age >= low
    return ok & (age <= high) if high is not None else ok


def contains_text(text: str, columns: tuple[str, ...] = SEARCHED) -> Column:
    """Case-blind substring of the columns joined by a space, so it may span two; nulls are empty."""
    joined = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.contains(F.lower(joined), F.lit(text.strip().lower()))


def any_contains(text: str, columns: tuple[str, ...], fold: bool = True) -> Column:
    """Substring of any one column; case counts unless ``fold``."""
    t, out = text.strip(), F.lit(False)
    for c in columns:
        col = F.coalesce(F.col(c).cast("string"), F.lit(""))
        out |= F.contains(F.lower(col), F.lit(t.lower())) if fold else F.contains(col, F.lit(t))
    return out


def lookup(text: str, columns: tuple[str, ...]) -> Column:
    """Case-blind LIKE with the text's own wildcards alive; under two characters nothing matches."""
    t, out = text.strip(), F.lit(False)
    for c in columns if len(t) >= 2 else ():
        out |= F.col(c).ilike(f"%{t}%")
    return out


def filtered(people: DataFrame, q: BrowseQuery) -> DataFrame:
    out = people
    for column in ("event", "verification", "gender"):
        if getattr(q, column) != "all":
            out = out.where(F.col(column) == getattr(q, column))
    if q.province != "all":
        out = out.where(F.trim("province") == q.province)
    if q.photo:
        out = out.where(~empty_text(F.col("photo_url")))
    if q.notable:
        out = out.where(truthy(F.col("notable")))
    if q.age != "all":
        out = out.where(in_bucket(F.col("age"), q.age))
    return out.where(contains_text(q.text)) if q.text.strip() else out


def relevance() -> Column:
    """Twice notable plus photo."""
    return F.when(truthy(F.col("notable")), 2).otherwise(0) + F.when(~empty_text(F.col("photo_url")), 1).otherwise(0)


def event_order(order: str = "order", default: int = 99) -> Column:
    """Missing or zero counts as ``default``."""
    return F.coalesce(F.nullif(F.col(order), F.lit(0)), F.lit(default))


def sort_keys(sort: str) -> list[Column]:
    """Sort keys with the hidden tie-break that a stable sort of the relevance order has."""
    c = F.col
    tie = [relevance().desc(), c("ordinal").asc()]
    date = F.nullif(c("date_gregorian"), F.lit(""))
    keys = {
        "age": [c("age").asc_nulls_last()],
        "age_desc": [c("age").desc_nulls_last()],
        "date": [date.desc_nulls_last()],
        "date_asc": [date.asc_nulls_last()],
        "name": [F.collate(c("name"), "fa").asc_nulls_last()],
        "name_desc": [F.collate(c("name"), "fa").desc_nulls_last()],
        "event": [event_order().asc()],
        "relevance": [],
    }
    return [*keys[sort], *tie]


def browse(people: DataFrame, events: DataFrame | None, q: BrowseQuery) -> DataFrame:
    """A page of matching people. ``people`` has an ``ordinal`` (place in the archive); events
    (event, title, order) give labels and order, and are a small dimension left to the optimizer."""
    out = filtered(people, q)
    if events is not None:
        out = out.join(events.select("event", "title", "order"), "event", "left").withColumn("label", F.coalesce("title", "event"))
    return out.orderBy(*sort_keys(q.sort)).offset(q.offset).limit(q.limit)


def facet(df: DataFrame, column: str, least: int = 1, letters: bool = False) -> DataFrame:
    """(value, n) of trimmed non-blank values with ``least`` rows, the most frequent first.

    ``letters`` keeps short values with an Arabic-block letter only.
    """
    v = F.trim(F.col(column).cast("string"))
    out = df.where(~empty_text(v))
    if letters:
        out = out.where((F.char_length(v) < 25) & v.rlike("[\\u0600-\\u06FF]"))
    return out.groupBy(v.alias("value")).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "value")


def dimension_counts(df: DataFrame, dim: DataFrame, key: str, order: str, hide_zero: bool = False) -> DataFrame:
    """(key, n) for every row of the dimension, in its order; zeros hidden on request."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    out = dim.select(key, order).join(n, key, "left").select(key, F.col(order).alias("place"), F.coalesce("n", F.lit(0)).alias("n"))
    return (out.where("n > 0") if hide_zero else out).orderBy(F.coalesce("place", F.lit(999)), key)


def cards(people: DataFrame, events: DataFrame) -> DataFrame:
    """Cards: the event's title or else its key, age and city as there are, a badge and a star."""
    c = F.col
    out = people.join(events.select("event", "title"), "event", "left")
    meta = F.concat_ws(" · ", F.concat(to_native_digits(c("age")), F.lit(" ساله")), F.nullif(c("city"), F.lit("")))
    badge = F.when(c("verification") == "documented", "documented").otherwise("reported")
    return out.select(
        "id", "name", F.coalesce("title", "event").alias("label"), meta.alias("meta"), badge.alias("badge"), truthy(c("notable")).alias("star"),
        F.nullif(c("photo_url"), F.lit("")).alias("photo")
    )


def details(people: DataFrame) -> DataFrame:
    """Details: the facts that are there in order, the first six links with host and kind, the story, and the English one if it differs."""
    c = F.col
    fact = lambda label, v: F.when(v.isNotNull() & (v != ""), F.struct(F.lit(label).alias("label"), v.alias("value")))
    facts = F.array_compact(F.array(fact("age", F.concat(to_native_digits(c("age")), F.lit(" سال"))), fact("gender", c("gender")), fact("date", to_native_digits(c("date_jalali"))), *[fact(k, c(k)) for k in ("city", "province", "occupation", "cause")]))
    story, english = F.nullif(c("story"), F.lit("")), F.nullif(c("story_en"), F.lit(""))
    return people.select(
        "id", facts.alias("facts"), links(c("memorial_links")).alias("links"), story.alias("story"),
        F.when(~english.eqNullSafe(story), english).alias("story_en")
    )


def links(urls: Column, most: int = 6) -> Column:
    """The first ``most`` links as structs (url, host, kind); a constant where a URL has no host."""
    return F.transform(
        F.slice(urls, 1, most),
        lambda u: F.struct(
            u.alias("url"), F.coalesce(host(u), F.lit("منبع")).alias("host"),
            F.when(host(u).isNull(), "generic").otherwise(link_kind(u)).alias("kind")
        )
    )


def summary_rows(df: DataFrame, exclude: str = "صنفی", width: int = 60) -> DataFrame:
    """The timeline's table: entries of every decade but one, the spark cut to ``width`` characters."""
    return df.where(F.col("decade") != exclude).select("id", "title", "date", truncate(F.col("spark"), width).alias("spark"), "casualties")


def timeline(
    df: DataFrame, decade: str = "all", text: str = "", columns: tuple[str, ...] = ("title", "summary", "spark", "details", "outcome", "category")
) -> DataFrame:
    """Entries of a decade that contain the text, case counting, in any of the columns."""
    out = df if decade == "all" else df.where(F.col("decade") == decade)
    return out.where(any_contains(text, columns, fold=False)) if text.strip() else out
