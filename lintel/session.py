"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lintel")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    Only a single-machine session may leave it unnamed; it then uses a folder of its own under
    ``spark.local.dir``.  On a cluster no local folder is visible to all, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not is_local(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"{spark.conf.get('spark.local.dir', '/tmp')}/checkpoints-{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return re.match(r"local(\[[^-]*\])?$", master) is not None


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let ``checkpoint()`` write to the shared folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a stage to the shared folder and go on from the written table.

    Later steps then read columns of a finished table instead of computing the
    stage again, and a lost executor costs no more than its own tasks.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_dir(spark: SparkSession) -> str:
    """This application's own folder within the shared one; all stored stages lie in it."""
    return f"{shared_dir(spark)}/run-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the run's folder."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def clean_run(spark: SparkSession) -> None:
    """Remove what this application has stored; call it when its results have been written elsewhere."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something lies at ``path``, in whichever store it names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
