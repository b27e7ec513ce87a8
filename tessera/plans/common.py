"""Fixtures derived inside the plans (so the oracle can repeat them) and SQL helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.registry import table

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def round_doubles(df: DataFrame, dp: int = 6) -> DataFrame:
    """Round every float/double column (top level) to ``dp`` decimals."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(F.round(F.col(f"`{f.name}`").cast("double"), dp).alias(f.name))
        else:
            exprs.append(F.col(f"`{f.name}`"))
    return df.select(*exprs)


def lineitem_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem measures with deterministic NULLs: quantity where orderkey % 7 = 0,
    discount where orderkey % 11 = 0 (FIXTURES 'Nulls').  All rows kept."""
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(F.col("l_orderkey") % 11 != 0, F.col("l_discount")).alias("l_discount"),
        "l_tax",
        "l_returnflag",
        "l_linestatus",
    )


LINEITEM_NULLS_SQL = """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  l_extendedprice,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_discount END AS l_discount,
  l_tax, l_returnflag, l_linestatus
FROM lineitem"""


def lineitem_key_expr() -> F.Column:
    """Row key of lineitem (unique at every scale, FIXTURES B)."""
    parts = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"]
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in parts]))


LINEITEM_KEY_SQL = ("md5(concat_ws(':', l_orderkey::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR, "
                    "l_linenumber::VARCHAR, l_quantity::VARCHAR, l_extendedprice::VARCHAR, "
                    "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')))")


def r(expr: str, alias: str, dp: int = 6) -> str:
    return f"round(({expr})::DOUBLE, {dp}) AS {alias}"


def sql_unit_hash(key_sql: str, salt_sql: str) -> str:
    """DuckDB twin of core.hash_uniform."""
    return (f"(('0x' || substr(md5(concat_ws(':', ({key_sql})::VARCHAR, ({salt_sql})::VARCHAR)), 1, 13))::UBIGINT"
            f"::DOUBLE / 4503599627370496.0)")


def sql_normal(key_sql: str, salt: str) -> str:
    u1 = sql_unit_hash(key_sql, f"'{salt}:a'")
    u2 = sql_unit_hash(key_sql, f"'{salt}:b'")
    return f"(sqrt(-2.0 * ln(1.0 - {u1})) * cos(2.0 * 3.141592653589793 * {u2}))"


def sql_quantiles(src: str, cols: list[str], probs: list[float], fmt: str = "{c}__q{i}") -> str:
    sel = ", ".join(
        f"quantile_cont({c}, {p}) AS {fmt.format(c=c, i=i)}" for c in cols for i, p in enumerate(probs)
    )
    return f"SELECT {sel} FROM {src}"


def sql_avg_rank(col: str, src: str, part: str | None = None) -> str:
    """pandas 'average' rank of col over src (NULLs excluded by the caller)."""
    return f"(rank() OVER (ORDER BY {col}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2.0)"
