"""Scans of files that queries cannot bring along."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from quern.sources import archive, publish
from quern.sources.stage import scratch, stage


def test_cached_images(spark, tmp_path):
    """Files are found by the sha1 of their address; one that is missing or empty is not ok."""
    urls = [f"http://x/{i}" for i in range(4)]
    for u, body in zip(urls, (b"one", b"", b"two")):
        (tmp_path / (hashlib.sha1(u.encode()).hexdigest() + ".img")).write_bytes(body)
    got = {r.url: r for r in archive.cached_images(spark, str(tmp_path), spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert [(got[u].ok, got[u].missing) for u in urls] == [(True, False), (False, True), (True, False), (False, True)]
    assert got[urls[0]].sha1 == hashlib.sha1(b"one").hexdigest() and got[urls[0]].length == 3


def test_fingerprints_over_several_files(spark, tmp_path):
    """The last file's line wins, in order of the files' names."""
    for name, sha in (("a", "1"), ("c", "3"), ("b", "2")):
        spark.createDataFrame([("u", True, sha, ["p"]), ("v", False, "9", ["p"])], "url string, ok boolean, sha1 string, ids array<string>").coalesce(1).write.json(str(tmp_path / "in" / f"f={name}"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for name in "abc":
        (part,) = (tmp_path / "in" / f"f={name}").glob("*.json")
        part.rename(flat / f"{name}.json")
    assert [(r.id, r.sha1) for r in archive.read_fingerprints(spark, str(flat)).collect()] == [("p", "3")]


def test_nothing_to_look_up(spark):
    none = spark.createDataFrame([], "path string")
    assert archive.newest(none).collect() == [(None,)]
    assert archive.todo(none, none, "path").count() == 0


def test_steps_go_on_where_they_stopped(spark, tmp_path):
    rows = spark.range(100)
    seen = []

    def work(d):
        ids = [r.id for r in d.collect()]
        seen.append(ids)
        return d.withColumn("twice", F.col("id") * 2)

    publish.save_in_steps(rows.where("id < 30"), work, "id", str(tmp_path / "out"), 10)
    out = publish.save_in_steps(rows, work, "id", str(tmp_path / "out"), 25)
    assert sorted(i for s in seen for i in s) == list(range(100)) and out.count() == 100


def test_steps_are_tasks_of_one_job_and_stay_when_it_fails(spark, tmp_path):
    rows, calls, folder = spark.range(0, 2000, 1, 4), [], str(tmp_path / "out")

    def work(d, bad=-1):
        calls.append(d.rdd.getNumPartitions())
        return d.withColumn("twice", F.when(F.col("id") == bad, F.raise_error(F.lit("cut short")).cast("long")).otherwise(F.col("id") * 2))

    with pytest.raises(Exception, match="cut short"):
        publish.save_in_steps(rows, lambda d: work(d, 1234), "id", folder, 20)
    kept = spark.read.schema("id long").parquet(folder).count()
    assert 0 < kept < 2000
    out = publish.save_in_steps(rows, work, "id", folder, 20)
    assert out.count() == out.select("id").distinct().count() == 2000 and out.where("twice = 2 * id").count() == 2000
    assert len(calls) == 2 and calls[0] == 100


def test_scratch_deletes_what_it_does_not_keep(spark):
    with scratch() as s:
        gone, kept = stage(spark.range(3)), s.keep(stage(spark.range(5)))
    assert kept.count() == 5
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(gone._quern_path)
    assert not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
