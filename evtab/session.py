"""Session helpers: one place for the configs the jobs rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Configs every evtab job assumes. AQE re-plans joins at run time from real
# shuffle sizes (broadcast only when the measured side is under the
# threshold, sort-merge otherwise) and splits skewed partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "evtab", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared folder for lineage cuts.

    Read ``spark.checkpoint.dir`` from the session (the cluster names a
    shared folder there). Only when it is unset -- tests, local runs -- use
    ``fallback``; with neither, fail instead of writing to a local path.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if fallback is None:
            raise RuntimeError("spark.checkpoint.dir is not set; pass a shared folder")
        path = fallback
    spark.sparkContext.setCheckpointDir(path)
    return path


def landed(df: DataFrame, name: str, fallback: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder as parquet and read back: a lineage cut whose readers prune columns."""
    path = f"{checkpoint_dir(df.sparkSession, fallback).rstrip('/')}/evtab-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
