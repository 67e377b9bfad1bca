"""Session helpers. Nothing here but the session zone overrides what a cluster has already set."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "fairline", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench. A cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every job relies on.

    UTC session zone; and plain per-operator code when a fused stage would exceed 8000 bytes of bytecode,
    because the JVM never compiles larger methods (a fused stage that stays interpreted is several times slower).
    A limit that the caller has set stays; the zone is part of the results, so another one is replaced.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":  # Spark's own default
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a scratch folder only in local runs."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="fairline-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives executor loss and is computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
