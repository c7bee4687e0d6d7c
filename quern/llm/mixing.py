"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import fresh, numbered, ranked
from quern.sources.stage import stage

WORD = r"[^\x20\x09-\x0D]+"
#: A source's weights by its place, the most times a source may be taken, and the rows alike
#: in source and size (or in doc_id too) that one task ranks; it changes no result.
WEIGHTS, MOST, TIES, SEED = (1, 2, 3), 3, 1_000, 7
#: Sources that are broadcast at most; more are joined by merging.
SOURCES = 10_000


def unit(*cols: Column) -> Column:
    """A number in [0, 1) that the columns' text decides."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, sid, source_size, target, per_copy).

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all
    sizes; a target stops at ``most`` times its source's size and the excess is shared
    again by weight. Filling in order of size per weight finds that level in one pass. The
    windows run over one row a source. Sources of size 0 get 0.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    s = sizes.withColumn("sid", F.row_number().over(place))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % n + 1).cast("double"))
    s = s.withColumn("cap", F.col("source_size").cast("double") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    upto, every = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(F.lit(0))
    s = s.withColumns(
        {
            "cap_upto": F.sum("cap").over(upto), "w_upto": F.sum("w").over(upto), "w_all": F.sum("w").over(every),
            "total": F.sum(F.col("source_size").cast("double")).over(every)
        }
    )
    # before each source: what the sources not yet stopped would get for a unit of weight
    s = s.withColumn("level", (F.col("total") - (F.col("cap_upto") - F.col("cap"))) / (F.col("w_all") - (F.col("w_upto") - F.col("w"))))
    s = s.withColumn("stops", F.col("cap") <= F.col("level") * F.col("w"))
    s = s.withColumn("open_level", F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("w"), "sid", "level"))).over(every)["level"])
    target = F.when(F.col("stops"), F.col("cap")).otherwise(F.col("open_level") * F.col("w"))
    return s.select(
        "source", "sid", "source_size", target.alias("target"),
        F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(0.0).alias("per_copy")
    )


def order_of(doc_id: Column, seed: int) -> Column:
    """Where a doc_id stands among those of its source and size: a fixed hash as a number in [0, 1)."""
    return unit(F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("n")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """Carried columns, doc_id, source, size, source_size, target, copies, taken: one row per input row.

    size counts words (null text: 0). Every document of a source expects target /
    source_size copies. Within a source documents line up by size, then a fixed hash of
    doc_id, then doc_id; the running sum of expected copies starts at one random offset,
    and a document is emitted once per integer it crosses. Neighbours in that line are
    alike in size, so the words taken are within about one long document of the target.

    The line's places come from counts per (source, size); rows tied in both are ranked by
    the hash, and rows alike in doc_id too, which nothing tells apart, by their numbers
    here. All three in cells, so no task sees a whole source or a whole group of ties.
    Null sources are a source of their own; repeated rows count each; an empty table
    gives no rows; other columns are ignored.
    """
    rows = docs.select(*carry, "doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    rows = stage(rows.withColumn("rid", F.monotonically_increasing_id()))
    tied = ["source", "size"]
    alike = stage(rows.groupBy(*tied, "doc_id").agg(F.count("*").alias("cnt")))
    by_size = stage(alike.groupBy(*tied).agg(F.sum("cnt").alias("cnt")))
    t = stage(targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("cnt")).alias("source_size")), weights, most))
    t = t.withColumn("offset", unit(F.lit(str(seed)), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))))
    # one row a source and size in each window, cells or not
    sizes = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = by_size.withColumn("start", F.sum("cnt").over(sizes) - F.col("cnt")).select(
        F.col("source").alias("_s"), F.col("size").alias("_z"), "start"
    )
    ids = ranked(alike, tied, order_of(F.col("doc_id"), seed), ["doc_id"], "cnt", TIES)
    ids = ids.join(start.hint("merge"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    ids = stage(ids.select(*tied, "doc_id", "cnt", (F.col("start") + F.col("upto") - F.col("cnt")).alias("before")))
    key = lambda d, *more: d.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("doc_id").alias("_d"), *more)
    on = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    both = rows.join(key(ids, "cnt", "before").hint("merge"), on).select(*rows.columns, "cnt", "before")
    once = both.where("cnt = 1").select(*rows.columns, (F.col("before") + 1).alias("place"))
    again = both.where("cnt > 1").withColumn("one", F.lit(1).cast("long"))
    again = ranked(again, [*tied, "doc_id"], unit(F.col("rid").cast("string")), ["rid"], "one", TIES)
    rows = once.unionByName(again.select(*rows.columns, (F.col("before") + F.col("upto")).alias("place")))
    t = t.select(F.col("source").alias("_s"), "source_size", "target", "per_copy", "offset")
    rows = rows.join(t.hint("broadcast" if t.count() <= SOURCES else "merge"), F.col("source").eqNullSafe(F.col("_s")))
    crossed = lambda k: F.floor(k * F.col("per_copy") + F.col("offset"))
    copies = F.least(crossed(F.col("place")) - crossed(F.col("place") - 1), F.lit(most)).cast("long")
    return rows.select(*carry, "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken; columns as in ``docs``.

    Rows meet their copies by their numbers, so texts are dealt once and by a unique key.
    """
    rows, a, b = numbered(docs)
    x, y, k, each = (fresh(rows, n) for n in ("__a", "__b", "__k", "__copy"))
    copies = mix(rows, weights, most, seed, (a, b)).where("copies > 0").select(F.col(a).alias(x), F.col(b).alias(y), F.col("copies").alias(k))
    both = rows.join(copies, (F.col(a) == F.col(x)) & (F.col(b) == F.col(y)))
    return both.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(k).cast("int")))).select(*docs.columns)


#: DuckDB SQL of op3.
MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS sid FROM d GROUP BY source),
w AS (SELECT *, ((sid - 1) % 3 + 1)::DOUBLE AS w, source_size::DOUBLE * {MOST} AS cap FROM s),
f AS (
  SELECT *, sum(cap) OVER o AS cap_upto, sum(w) OVER o AS w_upto, sum(w) OVER () AS w_all, sum(source_size::DOUBLE) OVER () AS total
  FROM w WINDOW o AS (ORDER BY cap / w, sid ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (total - (cap_upto - cap)) / (w_all - (w_upto - w)) AS level FROM f),
k AS (SELECT *, cap <= level * w AS stops FROM l),
t AS (
  SELECT source, source_size, CASE WHEN stops THEN cap ELSE (SELECT level FROM k WHERE NOT stops ORDER BY cap / w, sid LIMIT 1) * w END AS target FROM k),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, {MOST}.0::DOUBLE) ELSE 0.0 END AS per_copy,
    ('0x' || substr(md5('{SEED}|' || coalesce('s' || source, 'n')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS "offset" FROM t),
r AS (
  SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.per_copy, p."offset",
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5('{SEED}|' || coalesce(d.doc_id::VARCHAR, 'n'))[:8], d.doc_id) AS place
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
c AS (
  SELECT *, least((floor(place * per_copy + "offset") - floor((place - 1) * per_copy + "offset"))::BIGINT, {MOST}) AS copies FROM r)
SELECT doc_id, source, size, source_size, target, copies::BIGINT AS copies, (copies * size)::BIGINT AS taken FROM c
"""
