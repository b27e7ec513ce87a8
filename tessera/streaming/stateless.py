"""Structured Streaming use of the stateless operators.

The reference has no streaming runtime; what carries over are the per-row operators
(text cleaning, tokenising, fixed-statistics scaling) which run unchanged on a streaming
DataFrame.  ``clean_text_stream`` wires one such chain from a parquet folder to any sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T


def read_parquet_stream(spark: SparkSession, folder: str, like: DataFrame, glob: str = "*.parquet",
                        max_files: int = 1) -> DataFrame:
    """Streaming scan of the parquet files in ``folder`` matching ``glob``, schema of ``like``."""
    return (spark.readStream.schema(like.schema).option("maxFilesPerTrigger", max_files)
            .option("pathGlobFilter", glob).parquet(folder))


def clean_text_stream(stream: DataFrame, key: str, text_col: str) -> DataFrame:
    """Stateless per-row chain: F01 cleaning, X01 tokens, F05 lengths."""
    return stream.select(
        key,
        T.clean_basic(text_col).alias("cleaned"),
        F.size(T.tokenize_words(text_col)).alias("n_tokens"),
        T.char_length(text_col).alias("char_count"),
    )


def scale_stream(stream: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """G02/C09 with fixed statistics: (x - mean) / std per column from a batch-computed dict."""
    return stream.withColumns({c: (F.col(c) - F.lit(mu)) / F.lit(sd if sd else 1.0) for c, (mu, sd) in stats.items()})
