"""Where intermediate results that cut lineage are kept."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession

from corpusq.functions import files

#: Spark's setting to delete the shuffle files of a query as it ends, not when the driver happens to collect its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. A temporary one of this machine serves where none is set, but in local mode only:
    on a cluster its parts would lie on different machines."""
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not set_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all machines share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="corpusq-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(set_dir)
    return set_dir


def run_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it is deleted when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = files.join(shared_dir(spark), f"corpusq-{app}-{uuid.uuid4().hex[:8]}")
        files.delete_at_exit(spark, _own[app])
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return files.join(run_dir(spark), f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a parquet table in the shared folder, read back with its statistics known."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_in_parts(df: DataFrame, name: str, parts: Iterable[Column]) -> DataFrame:
    """As `written`, for a table that is exchanged as a whole: of the conditions in `parts` each row meets exactly one, and the
    shuffle files of a part are deleted as its writing ends, so the disk holds those of one part at a time."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        for part in parts:
            df.where(part).write.mode("append").parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all tables written so far; results that were not read yet are lost."""
    if (path := _own.pop(spark.sparkContext.applicationId, None)) is not None:
        files.delete(spark, path)
