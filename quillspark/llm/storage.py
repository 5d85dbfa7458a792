"""Materialised intermediate tables that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a temporary one where unset on a local master.

    A temporary folder of one machine is of no use to executors elsewhere, so a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage, never re-runs.

    The written table outlives executors; it is removed with the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver's cleaner remove the shuffle files of jobs that are done.

    It acts when the driver collects garbage; the last job's plan is held until another job ends, so an empty one runs.
    """
    spark.range(1).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jvm.System.gc()


def discard(made: DataFrame) -> None:
    """Remove a table that ``materialise`` wrote, once what was made of it is written itself."""
    sc = made.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in made.inputFiles()}:
        if shared_dir(made.sparkSession).removeprefix("file:").lstrip("/") in folder:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
