"""Balanced contiguous shards by global prefix sums of byte sizes.

DataFrame functions only.  Rows are dealt into id ranges; each range's total gives the offset of
the next, so the running sum inside a range plus its offset is the sum over all earlier rows, and
cutting it at equal targets gives the shards.  No task sees more than one range, and what goes
to one place is a row for each range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import write_cut


def shard_by_size(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns ``id_col``, ``size`` (UTF-8 bytes of the text, null: none, plus 1), ``text_crc32``
    (unsigned, of the UTF-8 bytes; null as empty), ``shard`` and ``slot``.

    Rows are ordered by id (null first; rows of one id by size, then crc32, then place in the
    input).  A row belongs to the shard in which the middle of its bytes falls, so two shards'
    sizes differ by no more than about the largest row.  Slots count a shard's rows from 0 in
    that order.  Hot sources, ids or copies only change where range borders lie: ties are parted
    by the place in the input.  An empty table gives an empty result; with fewer rows than
    shards, some shards stay empty.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = df.select(F.col(id_col).cast("long").alias("id"), (F.length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("place"))
    order = ["id", "size", "text_crc32", "place"]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = write_cut(rows.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")
    # one row for each range
    totals = dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.sum("bytes").over(everything).alias("all_bytes"))
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.join(F.broadcast(offsets), "range").select(
        "id", "size", "text_crc32",
        (F.col("n_before") + F.count("*").over(inside) - 1).alias("n"),
        (F.col("bytes_before") + F.sum("size").over(inside)).alias("upto"),
        "all_bytes",
    )
    # floor(shards * middle / all), in whole numbers: the middle is upto - size / 2
    cut = placed.withColumn("shard", F.expr(f"CAST(({shards} * (2 * upto - size)) DIV (2 * all_bytes) AS int)"))
    first = cut.groupBy("shard").agg(F.min("n").alias("first"))  # one row for each shard
    return cut.join(F.broadcast(first), "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("n") - F.col("first")).alias("slot"))
