"""Stage tables: results written once to the folder all executors share.

A stage table cuts lineage, so losing an executor costs the tasks it ran and not the
jobs before, and a value that several branches need is computed once.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
#: Stage tables written and not deleted yet.
_made: list[DataFrame] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; one of our own only on a local master."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _local:
        _local["dir"] = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, _local["dir"], ignore_errors=True)
    return f"file://{_local['dir']}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back, same schema and rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    _made.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete a stage table that nothing will read again."""
    path = getattr(df, "_quern_path", None)
    if path:
        _made[:] = [d for d in _made if d is not df]
        jvm, jsc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


class scratch:
    """``with scratch() as s``: on leaving, the stage tables written inside are deleted, but those given to ``s.keep``.

    For work whose result has been written by then; what is still to be read must be kept.
    """

    def __enter__(self) -> scratch:
        self.before, self.kept = {id(d) for d in _made}, set()
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df._quern_path)
        return df

    def __exit__(self, *_) -> None:
        for d in [d for d in _made if id(d) not in self.before and d._quern_path not in self.kept]:
            discard(d)
