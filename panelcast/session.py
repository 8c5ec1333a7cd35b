"""Session helpers: a sensible builder and durable cuts of long lineages."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


# The JVM never compiles methods above 8000 bytes. Fused code for the widest
# feature table exceeds that and is interpreted, which doubles its run time;
# with this limit Spark generates smaller methods instead.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
METHOD_BYTES = "8000"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "panelcast") -> SparkSession:
    """A session for tests and benchmarks. On a cluster use the session it provides."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config(METHOD_LIMIT, METHOD_BYTES)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def tune_for_wide_tables(spark: SparkSession) -> None:
    """Session setting for runs that build the full feature table; call it once per run."""
    spark.conf.set(METHOD_LIMIT, METHOD_BYTES)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; a
    cluster without it is refused, since a machine-local folder would be lost
    together with its executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="panelcast-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
