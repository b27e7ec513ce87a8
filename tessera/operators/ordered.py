"""Prefix scans along an order (C04, W02, W04) without a window over a whole group.

Rows are dealt into ranges of (group, order) by Spark's range partitioner, whose borders come from
the data, so a group with most of the rows spans many ranges.  Windows then run inside (range,
group), and what has to cross a border comes from a summary with one row for each range and group.
At most one group crosses a border, so the rows carried over are fewer than the ranges and their
broadcast has that bound.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

#: Rows of a range; the number of ranges grows with the table.
ROWS = 500_000
RANGE = "__range"


def with_order_ranges(df: DataFrame, group: Sequence[str], order: Sequence[str], rows: int = ROWS) -> DataFrame:
    """``df`` with the number of its range of (group, order), one range a task.  The numbers are
    written once, as a retried or coalesced stage could deal them anew."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / rows))
    dealt = df.repartitionByRange(n, *group, *order).withColumn(RANGE, F.spark_partition_id())
    return cut_lineage(dealt).repartitionByRange(n, RANGE)


def _with_carry(d: DataFrame, carry: DataFrame, group: Sequence[str], taken: Sequence[str]) -> DataFrame:
    """Left join on (range, group); null groups are groups."""
    c = carry.select(F.col(RANGE).alias("__r"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], *taken)
    same = F.col(RANGE) == F.col("__r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return d.join(F.broadcast(c), same, "left")  # fewer rows than ranges


def last_value(df: DataFrame, group: Sequence[str], order: Sequence[str], cols: Sequence[str], rows: int = ROWS) -> DataFrame:
    """Each of ``cols`` replaced by its last value up to the row that is not null, inside groups."""
    d = with_order_ranges(df, group, order, rows)
    upto = Window.partitionBy(RANGE, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = d.withColumns({f"__f{i}": F.last(c, ignorenulls=True).over(upto) for i, c in enumerate(cols)})
    at = F.struct(*order)
    ends = d.groupBy(RANGE, *group).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"__s{i}") for i, c in enumerate(cols)])
    ranges = Window.partitionBy(*group).orderBy(RANGE)
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(RANGE, *group, F.row_number().over(ranges).alias("__k"), *[F.last(f"__s{i}", ignorenulls=True).over(before).alias(f"__c{i}") for i in range(len(cols))]).where("__k > 1")
    out = _with_carry(filled, carry, group, [f"__c{i}" for i in range(len(cols))])
    new = {c: F.coalesce(F.col(f"__f{i}"), F.col(f"__c{i}")).alias(c) for i, c in enumerate(cols)}
    return out.select(*[new.get(c, F.col(c)) for c in df.columns])


def next_value(df: DataFrame, group: Sequence[str], order: Sequence[str], col: str, out: str, rows: int = ROWS) -> DataFrame:
    """Adds ``out``: the value of ``col`` in the next row of the group, null in its last row."""
    d = with_order_ranges(df, group, order, rows)
    w = Window.partitionBy(RANGE, *group).orderBy(*order)
    led = d.withColumns({"__n": F.lead(col).over(w), "__last": F.lead(F.lit(1)).over(w).isNull()})
    heads = d.groupBy(RANGE, *group).agg(F.min_by(col, F.struct(*order)).alias("__s"))
    ranges = Window.partitionBy(*group).orderBy(RANGE)
    carry = heads.select(RANGE, *group, F.lead("__s").over(ranges).alias("__c"), F.lead(F.lit(1)).over(ranges).alias("__k")).where("__k IS NOT NULL")
    j = _with_carry(led, carry, group, ["__c"])
    return j.select(*df.columns, F.when(F.col("__last"), F.col("__c")).otherwise(F.col("__n")).alias(out))
