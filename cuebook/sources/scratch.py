"""Tables written in the folder that the cluster shares, to be read more than once with the same rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a folder of our own only on a local master, where every executor sees it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        set_ = spark.conf.get("spark.checkpoint.dir", None)
        if not set_ and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(set_ or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


#: Folders made since the last release().
_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> int:
    """Delete the tables that operators wrote so far, once their results are used up; their number."""
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), len(_made)
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def written(rows: DataFrame) -> DataFrame:
    """rows, written once; each reading of them gives the same, whatever is lost meanwhile."""
    folder = new_folder(rows.sparkSession, "rows")
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
