"""Registry of named plans over the driver tables.

Each entry binds an operator to the test tables: ``fn(spark, sf_dir) -> DataFrame`` plus,
where SQL can express the result, the DuckDB oracle text over the same parquet views.
Computed doubles are rounded to 6 decimals on both sides (last-bit differences between
engines, SURVEY §5.2).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Plan:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: tuple[str, ...]
    doc: str


PLANS: dict[str, Plan] = {}


def plan(name: str, sql: str | None = None, ids: tuple[str, ...] = ()):
    def deco(fn):
        if name in PLANS:
            raise ValueError(f"duplicate plan {name}")
        PLANS[name] = Plan(name, fn, sql, ids, (fn.__doc__ or "").strip())
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_all() -> dict[str, Plan]:
    # importing the modules registers their plans
    from tessera.plans import (  # noqa: F401
        q_catalog,
        q_numeric,
        q_text,
        q_augment,
        q_ml,
        q_images,
        q_io,
    )

    return PLANS
