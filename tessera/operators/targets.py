"""Target selection rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import core
from tessera.operators.relational import movement_label

KEYWORDS = ("target", "label", "class", "outcome", "result")
VALUE_WORDS = ("price", "close", "value", "amount")


def infer_target(df: DataFrame, name: str | None = None, order_by=None) -> tuple[DataFrame, str]:
    """P10: the given column; else a column named like target/label/class/outcome/result
    (substring) or exactly 'y' (D17); else a movement label from 'Close' (W02, needs an
    explicit order, D9/D18); else an error."""
    if name:
        core.require_columns(df, [name])
        return df, name
    for c in df.columns:
        lc = c.lower()
        if lc == "y" or any(k in lc for k in KEYWORDS):
            return df, c
    if "Close" in df.columns:
        if not order_by:
            raise ValueError("a 'Close' movement target needs an explicit order_by")
        return movement_label(df, "Close", list(order_by)), "target"
    raise ValueError("no target column found")


def create_target(df: DataFrame) -> DataFrame:
    """P11: 'target' if present; else profit_loss > 0; else the first column whose name
    contains price/close/value/amount compared with its exact median; else the last numeric
    column vs its median.  The median is one aggregate row, broadcast."""
    if "target" in df.columns:
        return df
    if "profit_loss" in df.columns:
        return df.withColumn("target", (F.col("profit_loss") > 0).cast("int"))
    num = core.numeric_columns(df)
    cands = [c for c in df.columns if any(w in c.lower() for w in VALUE_WORDS)]
    col = cands[0] if cands else (num[-1] if num else None)
    if col is None:
        raise ValueError("no column to derive a target from")
    med = core.quantile_row(df, [col], [0.5], fmt="__med")
    return core.broadcast_row(df, med).withColumn("target", (F.col(col) > F.col("__med")).cast("int")).drop("__med")
