"""Readers and writers.

CSV / TSV / JSON / text / parquet go through Spark's own sources; ingest applies D1
(NaN -> NULL).  Scratch output lives under the session's checkpoint folder (shared on a
cluster), never a machine-local temp directory.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera import core
from tessera.session import checkpoint_dir

SUMMARY_KEYS = ("analysis_type", "results")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tessera-{name}-{uuid.uuid4().hex[:12]}"


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """Header row, inferred (or declared) types, NaN -> NULL."""
    r = spark.read.option("header", True).option("sep", sep)
    r = r.schema(schema) if schema else r.option("inferSchema", True)
    return core.nan_to_null(r.csv(path))


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """.tsv / .csv / .parquet / .txt / .json chosen by extension (or ``fmt``)."""
    kind = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if kind == "tsv":
        return read_csv(spark, path, sep="\t")
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "parquet":
        return core.nan_to_null(spark.read.parquet(path))
    if kind == "txt":
        return spark.read.option("wholetext", False).text(path)
    if kind == "json":
        return read_json_records(spark, path)
    raise ValueError(f"unsupported format {kind!r}")


def read_json_records(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Records -> rows; refuses an EDA summary (top-level analysis_type / results keys)."""
    df = spark.read.option("multiLine", multiline).json(path)
    bad = [k for k in SUMMARY_KEYS if k in df.columns]
    if bad:
        raise ValueError(f"file looks like an analysis summary (keys {bad}), not records")
    return core.nan_to_null(df)


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite", partition_by=()) -> None:
    """CSV with header (no index) or parquet, optionally partitioned."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "tsv":
        w.option("header", True).option("sep", "\t").csv(path)
    else:
        w.format(fmt).save(path)


def write_json_summary(summary: DataFrame, path: str) -> None:
    """A metrics / summary frame as one JSON document per row, one file per partition."""
    summary.write.mode("overwrite").json(path)


def save_model(model, path: str) -> None:
    """PipelineModel (model + preprocessors) saved in Spark's format."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """Load a saved PipelineModel."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)

