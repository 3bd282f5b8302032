"""Session building and the scratch folder that long jobs cut their lineage in."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sparkloom", master: str | None = None, **conf) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; cluster settings win over these."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where none is set, a temporary one on a local master, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder, for tables a later job reads back."""
    import uuid

    return f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of executors."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_round(df: DataFrame) -> DataFrame:
    """A round of a loop, written to the scratch folder and read back, so that its estimated size is that of its files.

    A checkpoint keeps the estimate of the plan that made it. A join multiplies the estimates of its sides, so in a loop that joins a table with itself the
    number doubles its digits every round, until it fills the driver's memory.
    """
    path = new_scratch_path(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
