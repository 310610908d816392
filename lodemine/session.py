"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# With this setting, the shuffle files of a query are removed when it ends, not when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "lodemine", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and skew-join splitting switched on.

    On a cluster leave ``master`` unset and let spark-submit name it; shuffle partitions are left to the
    cluster's own setting, from which adaptive execution coalesces.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder; a cluster without it is an
    error, because a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodemine-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession, folder: str) -> None:
    """Remove a folder named by :func:`scratch_path`, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, small: bool = False, folder: str | None = None) -> DataFrame:
    """Write ``df`` once as a parquet table in the shared folder and read it back.

    This cuts the lineage, survives the loss of executors, computes the frame a single time (an RDD checkpoint
    runs its last stage twice), and gives Catalyst real sizes to choose joins by. ``small`` frames, where the
    latency of the extra files outweighs that second run, are checkpointed as RDDs in the same folder.
    Tables for :func:`remove_scratch` go below a ``folder`` of their own. Nothing reads the shuffles of a stored frame again, so they go at once.
    """
    spark = df.sparkSession
    path = f"{folder}/{uuid.uuid4().hex}" if folder else scratch_path(spark, "table")
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        if small:
            return df.select("*").checkpoint(eager=True)  # planned anew under the setting
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)
