"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many arcs of a ring of 64-bit positions; a document's position is a hash
of its doc_id. Documents arrive along the ring. One whose home shard is full goes on
clockwise to the next virtual node of a shard that is not. With capacities that add up
to the number of documents and differ by one at most, row counts do too. Only counts per
arc are gathered, as many as there are virtual nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import ranked
from quern.sources.stage import stage

SHARDS, VNODES = 8, 256
#: The ring's positions are looked up by their first bits.
CELL_BITS = 12
#: Rows of an arc that one window ranks, and copies that one row becomes at once.
RUN = 10_000


def ring(spark: SparkSession, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, by position."""
    at = spark.range(shards * vnodes).select(F.floor(F.col("id") / vnodes).cast("int").alias("shard"), (F.col("id") % vnodes).alias("copy"))
    return sorted((r[1], r[0]) for r in at.select("shard", F.xxhash64(F.lit("node"), "shard", "copy").alias("at")).collect())


def fill(counts: list[int], nodes: list[int], shards: int) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pieces (arc, from rank, to rank, shard, first slot) of the bounded-load walk, and the shards' loads."""
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, pieces, n = [0] * shards, [], len(nodes)
    for arc, count in enumerate(counts):
        at, step = 0, 0
        while at < count:
            s = nodes[(arc + step) % n]
            take = min(count - at, room[s] - used[s])
            if take:
                pieces.append((arc, at, at + take, s, used[s]))
                used[s] += take
                at += take
            step += 1
    return pieces, used


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard: one row per input row.

    The law is ``rows``: counts at most one apart. size is the text's UTF-8 bytes plus 1
    (null text: 1) and text_crc32 that of the empty text then. Ring positions mix in the
    text, so rows that repeat a doc_id, null included, spread over the ring. Rows of an arc
    are ranked along the ring in cells of bounded size; rows alike in id, size and checksum
    share a position, nothing tells them apart, and they are counted first and written out
    in bounded runs. Adding a shard moves rows onto it and, since capacities shrink, some
    clockwise. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    spark = docs.sparkSession
    like = ["doc_id", "size", "text_crc32"]
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32")
    )
    rows = rows.groupBy(*like).agg(F.count("*").alias("cnt")).withColumn("at", F.xxhash64("doc_id", "text_crc32", "size"))
    nodes = ring(spark, shards, vnodes)
    # a position belongs to the first node at or after it; cells of equal width list their nodes
    shift = 64 - CELL_BITS
    inside: dict[int, list[int]] = {}
    for p, _ in nodes:
        inside.setdefault(p >> shift, []).append(p)
    cells: list[tuple[int, int, list[int]]] = []
    base = 0
    for c in range(-(1 << (CELL_BITS - 1)), 1 << (CELL_BITS - 1)):
        cells.append((c, base, inside.get(c, [])))
        base += len(cells[-1][2])
    lookup = F.broadcast(spark.createDataFrame(cells, "cell long, base int, inside array<long>"))  # 4,096 rows
    rows = rows.join(lookup, F.shiftright("at", shift) == F.col("cell"))
    arc = (F.col("base") + F.size(F.filter("inside", lambda x: x < F.col("at")))) % len(nodes)
    rows = stage(rows.select(*like, "cnt", "at", arc.cast("int").alias("arc")))
    counts = [0] * len(nodes)
    for a, n in rows.groupBy("arc").agg(F.sum("cnt")).collect():  # one row a virtual node
        counts[a] = n
    # an arc begins after the node before it; its place there as a share, the ring being closed
    arcs = [(a, float(nodes[a - 1][0]), float((p - nodes[a - 1][0]) % (1 << 64) or 1 << 64)) for a, (p, _) in enumerate(nodes)]
    begin = F.broadcast(spark.createDataFrame(arcs, "arc int, begin double, width double"))  # one row a virtual node
    gone = F.col("at").cast("double") - F.col("begin")
    share = F.least(F.when(gone < 0, gone + float(1 << 64)).otherwise(gone) / F.col("width"), F.lit(1 - 2.0**-40))
    rows = rows.join(begin, "arc").withColumn("share", share).drop("begin", "width")
    rows = ranked(rows, ["arc"], F.col("share"), ["at", *like], "cnt", RUN).withColumn("first", F.col("upto") - F.col("cnt"))
    few = rows.where(F.col("cnt") <= RUN).withColumn("lo", F.lit(0).cast("long"))
    many = rows.where(F.col("cnt") > RUN).withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cnt") - 1, F.lit(RUN).cast("long"))))
    rows = few.unionByName(many.repartition("at", "lo")).withColumn("k", F.explode(F.sequence("lo", F.least(F.col("lo") + RUN, F.col("cnt")) - 1)))
    rows = rows.select(*like, "arc", (F.col("first") + F.col("k")).alias("rank"))
    pieces, _ = fill(counts, [s for _, s in nodes], shards)
    schema = "arc int, from long, upto long, shard int, slot_from long, home_shard int"
    plan = F.broadcast(spark.createDataFrame([(*p, nodes[p[0]][1]) for p in pieces], schema))  # about one row a virtual node
    rows = rows.join(plan, "arc").where((F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("upto")))
    return rows.select(
        *like, F.lit("rows").alias("law"), "shard", (F.col("slot_from") + F.col("rank") - F.col("from")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "home_shard"
    )
