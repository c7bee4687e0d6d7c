"""Counts and coverage of record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(df: DataFrame, key: str, drop_empty: bool = False) -> DataFrame:
    """(key, n); the null group stays unless ``drop_empty``."""
    d = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")) if drop_empty else df
    return d.groupBy(key).agg(F.count("*").alias("n"))


def ages(df: DataFrame, age: str, minor: int = 18) -> DataFrame:
    """One row: all rows, those under ``minor``, and the rounded mean."""
    return df.agg(F.count("*").alias("total"), F.count_if(F.col(age) < minor).alias("under"), F.round(F.avg(age)).cast("long").alias("mean"))


def distinct_counts(df: DataFrame, **keys: str) -> DataFrame:
    """One row: all rows, and the distinct values of each key."""
    return df.agg(F.count("*").alias("n"), *[F.count_distinct(k).alias(n) for n, k in keys.items()])


def dependents(df: DataFrame, key: str, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``df`` with the number of rows that each dependent table has for its key, zero where it has none; each is counted before it is joined."""
    out = df
    for name, (d, k) in tables.items():
        out = out.join(d.groupBy(F.col(k).alias(key)).agg(F.count("*").alias(name)), key, "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in tables})


def coverage(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """(field, n): rows in which each field is not empty, in one pass."""
    row = df.agg(*[F.count_if(~empty).alias(n) for n, empty in tests.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("n")) for n in tests])).alias("x")).select("x.*")


def top(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` most frequent values, ties by value."""
    return counts(df, key, True).orderBy(F.desc("n"), key).limit(n)


def scalars(**parts: DataFrame) -> DataFrame:
    """One row of the single rows of several tables, each scanned once."""
    out = None
    for d in parts.values():
        out = d if out is None else out.crossJoin(d)  # one row each
    return out


def rarity(df: DataFrame, key: str, alias: str) -> DataFrame:
    """The rows with the number of rows that share their key (null keys: null)."""
    n = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(alias))
    return df.join(n, key, "left")


def add_missing(dim: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The dimension with those rows of ``new`` whose key it lacks."""
    return dim.unionByName(new.join(dim.select(key), key, "left_anti").select(*dim.columns))


def before_after(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, before, after): rows of each value, zero where a side has none."""
    n = lambda d, k: d.groupBy(key).agg(F.count("*").alias(k))
    j = n(before, "before").withColumnRenamed(key, "_k").join(n(after, "after"), F.col("_k").eqNullSafe(F.col(key)), "full")
    return j.select(F.coalesce("_k", key).alias(key), F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def largest(boxes: Column, w: str = "w", h: str = "h") -> Column:
    """The box (a struct) of the largest area of an array, the first of equal ones; null of none."""
    sized = F.transform(boxes, lambda b, i: F.struct((b[w] * b[h]).alias("area"), (-i).alias("at"), b.alias("box")))
    return F.array_max(sized)["box"]


def moves(audit: DataFrame, *by: str) -> DataFrame:
    """Tallies of an audit table, the most frequent first."""
    return audit.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)
