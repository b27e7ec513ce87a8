"""Subword tokenisation learned from the corpus (X05, re-aimed: no downloaded vocabulary).

Byte-pair-encoding merges are learned with Spark jobs over the distinct-word table: each
round counts adjacent symbol pairs weighted by word frequency (explode + map-side combined
aggregate), keeps the best pair (one row to the driver) and rewrites every word's symbol
string with a regular expression.  Only the merge list (bounded by ``merges``) reaches the
driver.  Segmentation applies the merges in place, once per distinct word in a task; only texts that
share a key are joined with a table of their words.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "</w>"


def learn_bpe(vocab: DataFrame, word: str = "word", count: str = "count", merges: int = 50,
              checkpoint_every: int = 10) -> list[tuple[str, str]]:
    """Learn up to ``merges`` BPE merges from (word, count); ties by pair text."""
    from tessera.session import cut_lineage

    w = vocab.select(F.col(count).alias("cnt"),
                     F.concat(F.lit(" "), F.array_join(F.split(F.col(word), ""), " "), F.lit(f" {END} ")).alias("s"))
    w = cut_lineage(w)
    out: list[tuple[str, str]] = []
    for i in range(merges):
        syms = F.filter(F.split(F.trim("s"), " "), lambda x: x != "")
        pairs = w.select("cnt", syms.alias("sy")).select(
            "cnt", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("sy") - 1, F.lit(1))),
                                         lambda k: F.struct(F.element_at("sy", k).alias("a"),
                                                            F.try_element_at("sy", k + 1).alias("b")))).alias("p"))
        best = (pairs.where(F.col("p.b").isNotNull()).groupBy("p.a", "p.b").agg(F.sum("cnt").alias("n"))
                .orderBy(F.desc("n"), "a", "b").limit(1).collect())
        if not best or best[0]["n"] < 2:
            break
        a, b = best[0]["a"], best[0]["b"]
        out.append((a, b))
        pat = f"(?<= ){re.escape(a)} {re.escape(b)}(?= )"
        w = w.withColumn("s", F.regexp_replace("s", pat, (a + b).replace("\\", "\\\\").replace("$", "\\$")))
        if (i + 1) % checkpoint_every == 0:
            w = cut_lineage(w)
    return out


def _segment(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    syms = list(word) + [END]
    while len(syms) > 1:
        best = None
        for j in range(len(syms) - 1):
            r = ranks.get((syms[j], syms[j + 1]))
            if r is not None and (best is None or r < best[0]):
                best = (r, j)
        if best is None:
            break
        j = best[1]
        syms = syms[:j] + [syms[j] + syms[j + 1]] + syms[j + 2:]
    return syms


def segment_vocabulary(vocab: DataFrame, merges: list[tuple[str, str]], word: str = "word") -> DataFrame:
    """(word, pieces): apply the merges in rank order once per distinct word (pandas UDF)."""
    ranks = {pair: i for i, pair in enumerate(merges)}

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def seg(words: pd.Series) -> pd.Series:
        return words.map(lambda x: _segment(x, ranks))

    return vocab.select(word).distinct().withColumn("pieces", seg(F.col(word)))


def subword_tokens(df: DataFrame, key: str, text_col: str, merges: list[tuple[str, str]], max_len: int | None = None) -> DataFrame:
    """Token pieces of each text in order, whole unless ``max_len`` asks for a cut."""
    from tessera.functions import text as Tx
    from tessera.operators.text import pieces_by_row

    words = df.select(key, Tx.tokenize_words(F.lower(F.coalesce(F.col(text_col), F.lit("")))).alias("__words"))
    ranks = {pair: i for i, pair in enumerate(merges)}
    out = pieces_by_row(words, key, "__words", lambda w: _segment(w, ranks), lambda found: segment_vocabulary(found, merges))
    return out if max_len is None else out.select(key, F.slice("pieces", 1, max_len).alias("pieces"))
