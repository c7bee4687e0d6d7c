"""Scans of archive documents, fingerprints and landed data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import schema as S


def read_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(people in the long form with their ordinal, events, meta) of one archive document."""
    shape = T.StructType(
        [
            T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
            T.StructField("events", T.MapType(T.StringType(), T.StructType(S.EVENT.fields[1:]))), T.StructField("people", T.ArrayType(S.PERSON_SHORT))
        ]
    )
    doc = spark.read.schema(shape).option("multiLine", True).json(path)
    rows = doc.select(F.posexplode("people").alias("ordinal", "p"))
    people = rows.select("ordinal", "p.*").select("ordinal", *[c.alias(n) for n, c in zip(S.LONG, _long_columns())])
    events = doc.select(F.explode("events").alias("event", "i")).select("event", "i.*")
    return people, events, doc.select(F.explode("meta").alias("key", "value"))


def _long_columns():
    none = F.array().cast("array<string>")
    for s, n in S.SHORT_TO_LONG.items():
        if n in ("memorial_links", "sources"):
            yield F.coalesce(F.col(s), none)
        elif n == "notable":
            yield F.coalesce(F.col(s).isin("1", "true"), F.lit(False))
        else:
            yield F.col(s)


def read_flags(spark: SparkSession, path: str) -> DataFrame:
    """(id, flagged_review) of an earlier long file; none if there is no such file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "id string, flagged_review string")
    return spark.read.schema(S.PERSON).json(path).where(F.coalesce("flagged_review", F.lit("")) != "").select("id", "flagged_review")


def carry_flags(people: DataFrame, flags: DataFrame) -> DataFrame:
    f = flags.select(F.col("id").alias("_id"), F.col("flagged_review").alias("_f"))
    return people.join(f, people.id == F.col("_id"), "left").withColumn("flagged_review", F.coalesce("flagged_review", "_f")).select(*people.columns)


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """A row per id: the last good fingerprint in the file's order."""
    d = spark.read.schema(S.FINGERPRINT).json(path)
    # the files in order of their names, a file's lines in order of their blocks and places there
    d = d.select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("n"))
    x = d.where("ok").select("n", F.explode("ids").alias("id"), "sha1", "phash", "dhash", "face_phash")
    last = x.groupBy("id").agg(F.max_by(F.struct("sha1", "phash", "dhash", "face_phash"), "n").alias("r"))
    return last.select("id", "r.*")


def urls_to_ids(people: DataFrame) -> DataFrame:
    return people.where(
        F.coalesce(F.trim("photo_url"), F.lit("")) != ""
    ).groupBy(F.trim("photo_url").alias("url")).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def cached_images(spark: SparkSession, folder: str, urls: DataFrame) -> DataFrame:
    """(url, ok, missing, sha1, length): the cache's files by sha1 of the URL; one that is missing, or empty, which a scan passes over, is not ok."""
    files = spark.read.format("binaryFile").load(folder).select(
        F.regexp_extract("path", r"([0-9a-f]{40})[^/]*$", 1).alias("key"), F.sha1("content").alias("sha1"), "length"
    )
    return urls.withColumn("key", F.sha1("url")).join(files, "key", "left").select(
        "url", F.coalesce(F.col("length") > 0, F.lit(False)).alias("ok"), F.col("length").isNull().alias("missing"), "sha1", "length"
    )


def todo(all_rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return all_rows.join(done.select(key), key, "left_anti")


def newest(paths: DataFrame, name: str = "path") -> DataFrame:
    """One row, column path: the newest of timestamped names, which is the greatest; null if there is none."""
    return paths.agg(F.max(name).alias("path"))


def row_of(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Point lookup: the first row of a key, by ``order``, or none."""
    return rows.where(F.col(key) == F.lit(value)).orderBy(order).limit(1)


def page_details(raw: DataFrame, lang: str, page: str = "pages") -> DataFrame:
    """Details of the first page of an encyclopedia's answer (JSON, pages by their number) for each id; page -1 is no page, its fields are null."""
    first = F.get(F.json_object_keys(F.get_json_object(page, "$.query.pages")), F.lit(0))
    c = F.col
    at = lambda p: F.get_json_object(
        F.call_function("get_json_object", c(page), F.concat(F.lit("$.query.pages['"), c("_p"), F.lit("']"))), f"$.{p}"
    )
    d = raw.withColumn("_p", F.nullif(first, F.lit("-1")))
    fields = {
        "title": "title", "pageid": "pageid", "qid": "pageprops.wikibase_item", "extract": "extract", "pageimage_original": "original.source",
        "pageimage_thumb": "thumbnail.source", "fullurl": "fullurl"
    }
    out = [at(p).cast("long" if n == "pageid" else "string").alias(n) for n, p in fields.items()]
    return d.select("id", *out, F.when(c("_p").isNotNull(), F.lit(lang)).alias("lang"))


def entity_claims(raw: DataFrame, claims: str = "claims", links: str = "sitelinks") -> DataFrame:
    """Wikidata claims (JSON) of each id: image, birth, death, place, occupations; and the titles of its two pages, if there are links (JSON)."""
    snak = lambda p, rest="": F.get_json_object(claims, f"$.{p}[0].mainsnak.datavalue.value{rest}")
    jobs = F.from_json(F.get_json_object(claims, "$.P106[*].mainsnak.datavalue.value.id"), "array<string>")
    one = F.get_json_object(claims, "$.P106[*].mainsnak.datavalue.value.id")
    title = lambda k: F.get_json_object(links, f"$.{k}.title")
    both = F.map_filter(F.create_map(*[x for k in ("enwiki", "fawiki") for x in (F.lit(k), title(k))]), lambda _, v: v.isNotNull())
    more = [both.alias("sitelinks")] if links in raw.columns else []
    return raw.select(
        "id", *more, snak("P18").alias("image"), snak("P569", ".time").alias("birth"), snak("P570", ".time").alias("death"),
        snak("P19", ".id").alias("birth_place"),
        F.coalesce(jobs, F.when(one.isNotNull(), F.array(F.regexp_replace(one, '"', "")))).alias("occupations")
    )
