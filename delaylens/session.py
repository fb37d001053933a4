"""Session defaults, reliable materialisation and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", **extra: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("delaylens")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own: on a cluster a
    machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if configured is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            configured = tempfile.mkdtemp(prefix="delaylens-")
        sc.setCheckpointDir(configured)
        current = sc.getCheckpointDir()
    return configured or current


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into reliable storage; later stages read it from there.

    Used where a result feeds several branches that must agree row for row
    (partition ids, sampled boundaries) or where an iteration would grow the plan.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table written and read back."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    As ``materialize``, for wide or long frames: packed columns take a fraction of a checkpoint's disk, and
    each later reading takes only the columns it needs.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_checkpoint(rdd: RDD) -> None:
    """Delete the checkpoint of an RDD that nothing reads any more; else it stays until the driver collects its garbage."""
    if name := rdd.getCheckpointFile():
        path = rdd.context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(rdd.context._jsc.hadoopConfiguration()).delete(path, True)
