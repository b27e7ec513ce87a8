"""Language detection by rank profiles of character n-grams (X24), learned from labelled rows.

A profile is a language's ``top`` most frequent n-grams of its words (a space on either side), by
rank.  A text goes to the language whose profile is the least out of place: the sum, over the
text's own ``top`` n-grams, of the distance between the two ranks, ``top`` where a profile lacks
the n-gram (Cavnar and Trenkle, 1994).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.text import by_own_key
from tessera.session import cut_lineage

SIZES = (1, 2, 3)
TOP = 300


def _words(text_col: str) -> Column:
    return F.split(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}]+", " "), " ")


def _own_ngrams(sizes: Sequence[int], top: int):
    """The ranked n-grams of one text, from the array of its words."""

    def ranked(words) -> list[str]:
        n: Counter = Counter()
        for w, times in Counter(words).items():
            p = f" {w} " if w else ""
            for s in sizes:
                for i in range(len(p) - s + 1):
                    n[p[i : i + s]] += times
        n.pop(" ", None)
        return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:top]]

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(ranked)

    return run.asNondeterministic()  # once for a row


def ranked_ngrams(df: DataFrame, key: str, text_col: str, sizes: Sequence[int] = SIZES, top: int = TOP) -> DataFrame:
    """(key, gram, rank): the ``top`` most frequent n-grams of the words of all texts that share a
    key, ties by the n-gram.  Words are counted first, so that an n-gram is cut from each distinct
    word once a key, and ranks are limited in each task before the shuffle."""
    counted = df.select(key, F.explode(_words(text_col)).alias("w")).where("w <> ''").groupBy(key, "w").agg(F.count("*").alias("n"))
    padded = counted.select(key, "n", F.concat(F.lit(" "), "w", F.lit(" ")).alias("p"))

    def cut(s: int):
        starts = F.sequence(F.lit(1), F.length("p") - (s - 1))
        return F.when(F.length("p") >= s, F.transform(starts, lambda i: F.substring("p", i, F.lit(s)))).otherwise(F.array().cast("array<string>"))

    grams = padded.select(key, "n", F.explode(F.concat(*[cut(s) for s in sizes])).alias("gram")).where("gram <> ' '")
    total = grams.groupBy(key, "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "gram"))
    return total.withColumn("rank", rank).where(F.col("rank") <= top).select(key, "gram", F.col("rank").cast("long").alias("rank"))


def learn_profiles(df: DataFrame, lang_col: str, text_col: str, sizes: Sequence[int] = SIZES, top: int = TOP) -> DataFrame:
    """(lang, gram, rank) from labelled texts; rows without a label teach nothing."""
    labelled = df.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return ranked_ngrams(labelled, "lang", "text", sizes, top)


def detect_by_profiles(df: DataFrame, key: str, text_col: str, profiles: DataFrame, sizes: Sequence[int] = SIZES, top: int = TOP) -> DataFrame:
    """``df`` with ``detected_lang`` and ``out_of_place``, the least distance (ties by language).

    ``key`` names a text: rows that share one are judged as one text.  A text without letters, or
    with no n-gram of any profile, is 'unknown' with a null distance; so is a row with a null key.
    """
    # ranked in place, where no other row has the key
    def own(rows: DataFrame) -> DataFrame:
        grams = rows.where(F.col(key).isNotNull()).select(key, _own_ngrams(sizes, top)(_words(text_col)).alias("__g"))
        ranked = grams.select(key, (F.size("__g") * F.lit(top).cast("long")).alias("__most"), F.posexplode("__g").alias("rank", "gram"))
        return ranked.select(key, "__most", "gram", (F.col("rank") + 1).cast("long").alias("rank"))

    def shared(rows: DataFrame) -> DataFrame:
        most = (F.count("*").over(Window.partitionBy(key)) * top).alias("__most")
        return ranked_ngrams(rows, key, text_col, sizes, top).select(key, most, "gram", "rank")

    # written, so that Spark knows their size and sends them to the texts' n-grams if they are small
    held = cut_lineage(profiles.select("lang", "gram", F.col("rank").alias("r")))
    met = by_own_key(df, key, own, shared).join(held, "gram")
    # what a shared n-gram saves against one that the profile lacks
    saved = met.groupBy(key, "lang").agg(F.sum(top - F.abs(F.col("rank") - F.col("r"))).alias("s"), F.max("__most").alias("__most"))
    best = saved.groupBy(key).agg(F.min(F.struct((F.col("__most") - F.col("s")).alias("d"), "lang")).alias("__b"))
    return df.join(best, key, "left").select(*df.columns, F.coalesce("__b.lang", F.lit("unknown")).alias("detected_lang"), F.col("__b.d").alias("out_of_place"))
