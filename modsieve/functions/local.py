"""Small tables as local relations: Spark knows their size, so it broadcasts them by itself and never
shuffles the other side of a join for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _text(v, kind: str) -> str:
    if v is None:
        return f"cast(null AS {kind})"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"cast({str(v).lower()} AS {kind})"


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """``rows`` (a fixed, small number of them) under ``schema``, as an inline table."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    values = ", ".join("(" + ", ".join(_text(v, kind) for v, (_, kind) in zip(r, fields, strict=True)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(n for n, _ in fields)})")
