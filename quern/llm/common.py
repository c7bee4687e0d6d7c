"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources.stage import stage

#: Rows and bytes of one Arrow batch at most; texts may be long, so a batch stays small.
BATCH_ROWS, BATCH_BYTES = 500, 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts within a worker's memory; a smaller setting of the user's stays."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name).rstrip("b")  # a size with a larger unit, or no bound, is above ours
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def tidied(run):
    """``run`` over Arrow batches, and at its end the memory it freed is given back, as a worker lives on for other tasks."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def as_bytes(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column, None for null."""
    return column.cast(pa.large_binary()).to_pylist()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be no column of ``docs``."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with two columns that name each row, and their names.

    A scan of files has its rows' file and place in it, which a second reading finds
    again; anything else is staged with numbers of its own. So a decision on rows comes
    back to their texts by a unique key, whatever ids are null or repeated.
    """
    a, b = fresh(docs, "__file"), fresh(docs, "__row")
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in docs.columns:
        return docs.select("*", F.xxhash64("_metadata.file_path").alias(a), F.col("_metadata.row_index").alias(b)), a, b
    return stage(docs.withColumns({a: F.lit(0).cast("long"), b: F.monotonically_increasing_id()})), a, b


def without(docs: DataFrame, numbers: tuple[str, str], dropped: DataFrame) -> DataFrame:
    """Numbered ``docs`` without the rows of ``dropped`` (their two columns), which are staged.

    The optimizer sees the size of what is dropped: while it is small the texts stay where
    they are, and beyond its limit both sides are dealt by a unique key.
    """
    a, b = numbers
    x, y = fresh(docs, "__a"), fresh(docs, "__b")
    out = stage(dropped.select(F.col(a).alias(x), F.col(b).alias(y)))
    return docs.join(out, (F.col(a) == F.col(x)) & (F.col(b) == F.col(y)), "left_anti").drop(a, b)


def ranked(rows: DataFrame, keys: list[str], at: Column, order: list[str], count: str, limit: int) -> DataFrame:
    """``rows`` with ``upto``: the sum of ``count`` over the rows of the same keys up to each, in order of ``at`` and ``order``.

    Groups of more than ``limit`` rows are cut into cells of equal width in ``at``, which
    is in [0, 1); cells are ranked side by side and only their sums in turn, so no task
    holds a large group. How many cells there are changes no place.
    """
    same = lambda n: [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(n)]
    as_key = lambda d, n, *more: d.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(n)], *more)
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_rows")).withColumn("_cells", F.ceil(F.col("_rows") / limit))
    # by merging: both grow with the input, and a hot key is split by adaptive execution
    d = rows.withColumn("_at", at).join(
        as_key(groups, keys, "_cells").hint("merge"), same(keys)
    ).withColumn("_cell", F.floor(F.col("_at") * F.col("_cells")))
    d = d.select(*rows.columns, "_at", "_cell")
    cells = d.groupBy(*keys, "_cell").agg(F.sum(count).alias("_n"))
    line = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("_before", F.sum("_n").over(line) - F.col("_n"))
    inside = Window.partitionBy(*keys, "_cell").orderBy("_at", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_upto", F.sum(count).over(inside))
    d = d.join(as_key(cells, [*keys, "_cell"], "_before").hint("merge"), same([*keys, "_cell"]))
    return d.select(*rows.columns, (F.col("_before") + F.col("_upto")).alias("upto"))
