"""Tables that cut lineage, in the folder every executor shares."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a folder under /tmp for a session in
    one process (tests); a cluster's machines don't share one, so there it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = f"/tmp/checkpoints/modsieve-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Later steps then read files instead of recomputing, and survive lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each changed if ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    return [n if n.lower() not in taken else f"{n}_{uuid.uuid4().hex}" for n in names]


def text_key(doc_id: Column, text: Column) -> Column:
    """A text that rows share if they have one doc_id and one text: the id and a SHA-256."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(F.sha2(text.cast("string"), 256), F.lit("null")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
