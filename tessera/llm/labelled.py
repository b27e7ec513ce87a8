"""Labelled rows for the classifiers: a bounded sample and the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_text


def fold(id_col: str | Column) -> Column:
    """crc32 of the id as text, mod 5 (a null id counts as an empty text); fold 0 is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), F.lit(""))) % 5


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, weight, text) for at most ``per_class`` documents of each of the labels 0 and 1,
    those with the smallest hashes of their ids, never of fold 0.  Of an id's labels the largest
    counts, and of an id's texts the least.  ``weight`` gives both classes their shares back."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    known = known.where(fold("id") != 0).groupBy("id").agg(F.max("label").alias("label"))
    counts = known.groupBy("label").count()  # two rows
    some = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    sample = some[0].unionAll(some[1])
    taken = sample.groupBy("label").agg(F.count("*").alias("taken"))
    share = counts.join(taken, "label").select("label", (F.col("count") / F.col("taken")).alias("weight"))
    sample = sample.join(F.broadcast(share), "label")
    rows = id_text(docs, id_col, text_col).join(F.broadcast(sample), "id")  # at most 2 * per_class rows
    return rows.groupBy("id", "label", "weight").agg(F.min("text").alias("text"))
