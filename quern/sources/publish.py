"""Published forms of the archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import schema as S
from quern.functions.text import json_text
from quern.sources.stage import stage


def csv_rows(people: DataFrame) -> DataFrame:
    """The CSV form's columns as text: lists joined, booleans in words, null as empty."""
    def cell(n: str):
        c = F.array_join(n, "; ") if n == "sources" else F.col(n).cast("string")
        return F.coalesce(c, F.lit("")).alias(n)

    return people.select([cell(n) for n in S.CSV])


def csv_lines(people: DataFrame) -> DataFrame:
    """One column, value: the CSV form's lines without their ends; quotes, commas and line breaks quoted, quotes doubled."""
    cells = [F.when(F.col(n).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(F.col(n), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(n)) for n in S.CSV]
    return csv_rows(people).select(F.concat_ws(",", *cells).alias("value"))


def write_csv(people: DataFrame, path: str, one_file: bool = False) -> None:
    """UTF-8 with a mark at its start, CRLF, quotes doubled: a folder whose files in order of their names are the document.

    The first holds mark and header alone and each task writes a file of rows, so none
    writes the archive; ``one_file`` is for archives that one task may write.
    """
    spark = people.sparkSession
    head = spark.createDataFrame([("\ufeff" + ",".join(S.CSV),)], "value string").coalesce(1)
    rows = csv_lines(people)
    if one_file:
        rows = head.unionByName(rows).coalesce(1)
    else:
        head.write.option("lineSep", "\r\n").text(f"{path}/0-header")
    rows.write.option("lineSep", "\r\n").text(path if one_file else f"{path}/1-rows")


def record_json(people: DataFrame, pretty: bool = False) -> Column:
    return F.to_json(F.struct(*people.columns), {"ignoreNullFields": "false"} | ({"pretty": "true"} if pretty else {}))


def document_lines(people: DataFrame, events: DataFrame, meta: DataFrame, lite: bool = False) -> DataFrame:
    """(part, value): the archive document {metadata, events, people}, in parts whose values one after the other are the JSON.

    A record is a part, so no row holds the people; ordered by part, ordinal records first come first.
    """
    name = "meta" if lite else "metadata"
    m = meta.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("m"))  # a handful of rows each
    e = events.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event", F.struct(*[c for c in events.columns if c != "event"]).alias("i"))))).alias("e"))
    head = m.crossJoin(e).select(
        F.struct(F.lit(0).alias("kind"), F.lit("").alias("id")).alias("part"),
        F.concat(F.lit(f'{{"{name}":'), F.to_json("m"), F.lit(',"events":'), F.to_json("e"), F.lit(',"people":[')).alias("value")
    )
    first = people.agg(F.min("id").alias("_first"))
    shown = S.to_lite(people) if lite else people
    text = F.to_json(F.struct(*shown.columns), {"ignoreNullFields": "true" if lite else "false"})
    rows = shown.crossJoin(first).select(F.struct(F.lit(1).alias("kind"), F.col("id")).alias("part"), F.concat(F.when(F.col("id") == F.col("_first"), "").otherwise(","), text).alias("value"))  # the right side is one row
    tail = head.select(F.struct(F.lit(2).alias("kind"), F.lit("").alias("id")).alias("part"), F.lit("]}").alias("value"))
    return head.unionByName(rows).unionByName(tail)


def write_document(people: DataFrame, events: DataFrame, meta: DataFrame, path: str, lite: bool = False) -> None:
    """The archive document as text files that, in order of their names, are one JSON text."""
    document_lines(people, events, meta, lite).repartitionByRange("part").sortWithinPartitions("part").select("value").write.text(path)


def by_event(people: DataFrame, events: DataFrame) -> DataFrame:
    """(event, part, value): for every known event the document {event, info, count, people} in parts, a record each.

    Events without people have one too; people of unknown events are left out.
    """
    docs = event_documents(people, events)
    info = [c for c in events.columns if c != "event"]
    head = docs.select(
        "event", F.lit("").alias("part"),
        F.concat(
            F.lit('{"event":'), json_text(F.col("event")), F.lit(',"info":'),
            F.to_json(F.struct(*[F.col(f"info.{c}").alias(c) for c in info]), {"ignoreNullFields": "false"}), F.lit(',"count":'),
            F.col("count").cast("string"), F.lit(',"people":[')
        ).alias("value")
    )
    known = people.join(events.select("event"), "event", "left_semi").select(*people.columns)
    first = known.groupBy("event").agg(F.min("id").alias("_first"))
    rows = known.join(first, "event").select(
        "event", F.concat(F.lit("p"), F.col("id")).alias("part"),
        F.concat(F.when(F.col("id") == F.col("_first"), "").otherwise(","), record_json(people)).alias("value")
    )
    tail = docs.select("event", F.lit("z").alias("part"), F.lit("]}").alias("value"))
    return head.unionByName(rows).unionByName(tail)


def write_event_documents(people: DataFrame, events: DataFrame, path: str) -> None:
    """A folder ``event=...`` for every known event, whose files in order of their names are its document."""
    by_event(people, events).repartitionByRange("event", "part").sortWithinPartitions("event", "part").select("event", "value").write.partitionBy("event").text(path)


def append(rows: DataFrame, path: str) -> None:
    """Rows added to a table of Parquet files; what is there stays."""
    rows.write.mode("append").parquet(path)


def head(rows: DataFrame, part: str, n: int, order: str) -> DataFrame:
    """The first ``n`` rows in order, under the name of the report's part."""
    return rows.orderBy(order).limit(n).select(F.lit(part).alias("part"), *rows.columns)


def apply_versioned(new: DataFrame, folder: str, version: str, apply: bool = True) -> str | None:
    """Write ``new`` as a version of its own and return its path; what is there already, the backup, stays. Without ``apply`` a dry run: nothing is written."""
    if not apply:
        return None
    path = f"{folder}/{version}"
    new.write.option("ignoreNullFields", "false").json(path)
    return path


def save_in_steps(rows: DataFrame, work, key: str, folder: str, every: int) -> DataFrame:
    """``work`` on the rows whose key is not in the folder yet, ``every`` rows a step, each step in the folder as soon as it is done.

    A run that is cut short goes on where it stopped. Steps are cells by a hash, of about ``every`` rows.
    A step is a task, so steps run side by side and each reads its own rows only; the second
    commit algorithm moves a task's file to the folder when the task ends, under a name that a
    repeated task takes again. ``work`` is by row. Returns what is in the folder.
    """
    spark = rows.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    here = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    done = spark.read.schema(rows.select(key).schema).parquet(folder) if here else None
    left = stage(rows.join(done, key, "left_anti") if here else rows)
    steps = -(-left.count() // every)
    if steps or not here:
        out = work(left.repartition(max(steps, 1), key)).write.mode("append")
        out.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(folder)
    return spark.read.parquet(folder)


def write_json(people: DataFrame, path: str, pretty: bool = False) -> None:
    """A record a line with explicit nulls, or pretty-printed records."""
    if pretty:
        people.select(F.to_json(F.struct(*people.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).write.text(path)
    else:
        people.write.option("ignoreNullFields", "false").json(path)


def write_lite(people: DataFrame, path: str) -> None:
    S.to_lite(people).write.option("ignoreNullFields", "true").json(path)


def event_documents(people: DataFrame, events: DataFrame) -> DataFrame:
    """(event, info, count): every known event; people of unknown events are left out."""
    n = people.groupBy("event").agg(F.count("*").alias("count"))
    return events.select(
        "event", F.struct(*[c for c in events.columns if c != "event"]).alias("info")
    ).join(n, "event", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def write_by_event(people: DataFrame, events: DataFrame, path: str) -> None:
    """people/ partitioned by event, and info/ with a row for every event, none of them collected in one row."""
    known = people.join(events.select("event"), "event", "left_semi")
    known.write.partitionBy("event").option("ignoreNullFields", "false").json(f"{path}/people")
    event_documents(people, events).write.json(f"{path}/info")


def statistics(people: DataFrame, events: DataFrame) -> DataFrame:
    """One row: total, notable, and maps of counts by event (all known), verification and gender. All are counted anew."""
    def as_map(key: str, counted: DataFrame) -> DataFrame:
        return counted.where(F.col(key).isNotNull()).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("n"))))).alias(f"by_{key}")
        )

    n = lambda k: people.groupBy(k).agg(F.count("*").alias("n"))
    by_event = events.select("event").join(n("event"), "event", "left").select("event", F.coalesce("n", F.lit(0)).alias("n"))
    total = people.agg(F.count("*").alias("total"), F.count_if("notable").alias("notable"))
    return total.crossJoin(as_map("event", by_event)).crossJoin(as_map("verification", n("verification"))).crossJoin(as_map("gender", n("gender")))


def publish(people: DataFrame, events: DataFrame, out: str) -> None:
    """All forms under ``out``, a new folder: a reader moves on to it by name, and what is being read stays."""
    people = stage(people)
    write_json(people, f"{out}/full", pretty=True)
    write_json(people, f"{out}/min")
    write_lite(people, f"{out}/lite")
    write_csv(people, f"{out}/csv")
    write_by_event(people, events, f"{out}/by-event")
    statistics(people, events).write.option("ignoreNullFields", "false").json(f"{out}/statistics")
