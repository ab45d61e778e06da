"""Intermediate tables in the folder that all machines share, for plans that read a result several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the session's ``spark.checkpoint.dir`` and read back, so later steps
    read files instead of computing it again, and survive lost executors. Where it is unset, a local session
    uses a temporary folder; on a cluster that is an error."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = tempfile.mkdtemp(prefix="modsieve-")
        spark.sparkContext.setCheckpointDir(where)
    path = f"{where.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
