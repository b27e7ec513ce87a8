"""Words of like use, learned from the corpus (G08, G09): windowed co-occurrence, positive
pointwise mutual information, nearest words by cosine.

The words looked for are a stated set; each is held against every word of the corpus, in blocks of
these and groups of those whose products stay in a task: only the best of a block are shuffled.  No pairs among all words
of the corpus are formed.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import dictionaries as D
from tessera.functions import text as T
from tessera.session import cut_lineage, release


#: Cells of the vectors of a block of words, and of a group of words looked for.
WORD_CELLS, ASKED_CELLS = 1 << 21, 1 << 21
#: Cells of a block, if there are no more blocks than cores.
LEAST_CELLS = 1 << 18
#: Cells of a row that holds many.
ROW_CELLS = 1 << 16
#: Products of a step within a block, and cells of its sums.
STEP = 1 << 21


def content_words(text_col: str, stopwords: Iterable[str] = D.STOPWORDS_EN):
    """Lower-cased alphabetic words of a text that are no stop words, in order."""
    return T.remove_stopwords(T.alpha_lower(T.tokenize_words(F.col(text_col))), stopwords)


def _counted_once(df: DataFrame, text_col: str, window: int, stopwords: Iterable[str]) -> DataFrame:
    """(a, b, n): how often two words, a before b in their order, stand within ``window`` content words."""
    words = df.select(content_words(text_col, stopwords).alias("__w"))
    last = F.size("__w")

    def at(distance: int):
        places = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: i + distance <= last)
        return F.transform(places, lambda i: F.struct(F.element_at("__w", i).alias("a"), F.element_at("__w", i + distance).alias("b")))

    near = words.select(F.explode(F.concat(*[at(d) for d in range(1, window + 1)])).alias("p")).where("p.a <> p.b")
    return near.groupBy(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _both_ways(once: DataFrame, value: str) -> DataFrame:
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("context")), F.struct(F.col("b").alias("word"), F.col("a").alias("context")))
    return once.select(F.explode(both).alias("p"), value).select("p.word", "p.context", value)


def cooccurrences(df: DataFrame, text_col: str, window: int = 2, stopwords: Iterable[str] = D.STOPWORDS_EN) -> DataFrame:
    """(word, context, n): how often ``context`` stands within ``window`` content words of ``word``, on
    either side, in one text.  A word is no context of itself; null and empty texts have no words.

    Pairs of neighbours are counted in one direction; the other is added to the counts."""
    return _both_ways(_counted_once(df, text_col, window, stopwords), "n")


def _weighted(pairs: DataFrame, sums: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, weight) of the pairs (a, b, n) whose weight is above 0; ``sums`` holds each word's sum over all pairs."""
    total = sums.agg(F.sum("own").alias("total"))
    named = pairs.join(sums.withColumnRenamed("word", a), a).join(sums.withColumnsRenamed({"word": b, "own": "other"}), b)
    weight = F.ln(F.col("n").cast("double") * F.col("total") / (F.col("own").cast("double") * F.col("other")))
    return named.crossJoin(F.broadcast(total)).select(a, b, weight.alias("weight")).where("weight > 0")


def positive_pmi(pairs: DataFrame, least: int = 2) -> DataFrame:
    """(word, context, weight): ln(n N / (n_word n_context)) where that is above 0 and n at least
    ``least``; the sums are over all pairs."""
    return _weighted(pairs.where(F.col("n") >= least), pairs.groupBy("word").agg(F.sum("n").alias("own")), "word", "context")


def nearest_words(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(word, synonym, rank, cosine): for each word of ``queries`` (column ``word``) the ``k`` other words with
    the highest cosine above 0, from 1; equal cosines (9 decimals) by the word.

    A query without vector has no row; repeated and null queries count once and not at all.

    The words looked for go in groups of up to about ``ASKED_CELLS`` cells, one after the other, to all
    blocks of words, so that what lies on disk at a time grows with the vectors and not with their square."""
    spark = vectors.sparkSession
    norms = vectors.groupBy("word").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    # words by number, in their order
    named = cut_lineage(norms.orderBy("word").select("word", "norm", F.monotonically_increasing_id().alias("id")))
    unit = vectors.join(named, "word").select(F.col("id").alias("w"), "context", (F.col("weight") / F.col("norm")).alias("x"))
    contexts = cut_lineage(vectors.select("context").distinct().select("context", F.monotonically_increasing_id().alias("c")))
    unit = cut_lineage(unit.join(contexts, "context").select("w", "c", "x"))
    ids = cut_lineage(named.join(queries.select("word").distinct(), "word", "left_semi").select(F.col("id").alias("w")))
    asked = cut_lineage(unit.join(ids, "w", "left_semi"))
    cells = unit.count()
    blocks = max(-(-cells // WORD_CELLS), min(-(-cells // LEAST_CELLS), spark.sparkContext.defaultParallelism), 1)
    groups = max(-(-asked.count() // ASKED_CELLS), 1)
    left, right = _in_rows(unit, "block", blocks), _in_rows(asked, "grp", groups)
    release(contexts, unit, ids, asked)
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    found: list[DataFrame] = []
    for g in range(groups):
        sent = right.where(F.col("grp") == g).select(block, "w", "c", "x")
        met = left.groupBy("block").cogroup(sent.groupBy("block")).applyInPandas(_best_of_block(k), "q long, w long, cosine double")
        found.append(cut_lineage(met) if g < groups - 1 else met)
    # at most k rows for a block and word looked for
    met = functools.reduce(DataFrame.unionByName, found)
    met = met.join(named.select(F.col("id").alias("q"), F.col("word").alias("asked")), "q").join(named.select(F.col("id").alias("w"), "word"), "w")
    met = met.select(F.col("asked").alias("q"), "word", F.round("cosine", 9).alias("cosine"))
    best = Window.partitionBy("q").orderBy(F.desc("cosine"), "word")
    ranked = met.where("cosine > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("word"), F.col("word").alias("synonym"), "rank", "cosine")


def _in_rows(cells: DataFrame, name: str, parts: int) -> DataFrame:
    """The cells (w, c, x) dealt by w into ``parts`` parts numbered ``name``, many in a row as bytes; written."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("w", kind="stable")
        number, rows = int(part[name].iloc[0]), range(0, len(part), ROW_CELLS)
        return pd.DataFrame({name: [number] * len(rows)} | {c: [part[c].to_numpy()[i : i + ROW_CELLS].tobytes() for i in rows] for c in ("w", "c", "x")})

    dealt = cells.select(F.pmod(F.xxhash64("w"), F.lit(parts)).cast("int").alias(name), "w", "c", "x")
    return cut_lineage(dealt.groupBy(name).applyInPandas(pack, f"{name} int, w binary, c binary, x binary"))


def _best_of_block(k: int):
    """A function of the vectors of a block of words and of a group of words looked for, each as rows of many
    cells (w, c, x): for each of the latter the ``k`` other words with the highest sum of products above 0."""

    def read(rows: pd.DataFrame, name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(rows[name]), kind)

    def run(words: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names, q = np.unique(read(asked, "w", np.int64), return_inverse=True)
        c = read(asked, "c", np.int64)
        at = np.argsort(c, kind="stable")
        contexts, first, many = np.unique(c[at], return_index=True, return_counts=True)
        q, y = q[at], read(asked, "x", np.float64)[at]
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # q, w, cosine
        least = np.zeros(len(names))
        # cells come by w; those whose context no word looked for has take no part
        c = read(words, "c", np.int64)
        place = np.searchsorted(contexts, c)
        in_both = contexts[np.minimum(place, len(contexts) - 1)] == c if len(names) else np.zeros(len(c), bool)
        place = place[in_both]
        x = read(words, "x", np.float64)[in_both]
        ids, w = np.unique(read(words, "w", np.int64)[in_both], return_inverse=True)
        starts = np.searchsorted(w, np.arange(len(ids) + 1))
        done = np.concatenate([[0], np.cumsum(many[place])]) if len(names) else np.zeros(len(w) + 1)
        lo = 0
        while len(names) and lo < len(ids):
            hi = min(lo + max(STEP // len(names), 1), len(ids))
            sums = np.zeros((hi - lo) * len(names))
            at = starts[lo]
            while at < starts[hi]:
                to = min(max(int(np.searchsorted(done, done[at] + STEP, side="right")) - 1, at + 1), starts[hi])
                n = many[place[at:to]]
                cell = np.repeat(np.arange(at, to), n)
                other = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n) + first[place[cell]]
                sums += np.bincount((w[cell] - lo) * len(names) + q[other], weights=x[cell] * y[other], minlength=len(sums))
                at = to
            sums = np.round(sums.reshape(hi - lo, len(names)), 9)
            i, j = np.nonzero((sums > 0) & (sums >= least) & (ids[lo:hi, None] != names[None, :]))
            held = tuple(np.concatenate(p) for p in zip(held, (j, ids[lo + i], sums[i, j])))
            order = np.lexsort((held[1], -held[2], held[0]))
            held = tuple(p[order] for p in held)
            rank = np.arange(len(order)) - np.searchsorted(held[0], held[0])
            least[held[0][rank == k - 1]] = held[2][rank == k - 1]
            held = tuple(p[rank < k] for p in held)
            lo = hi
        return pd.DataFrame({"q": names[held[0]], "w": held[1], "cosine": held[2]})

    return run


def synonym_candidates(df: DataFrame, text_col: str, queries: DataFrame, window: int = 2, least: int = 2, k: int = 5,
                       stopwords: Iterable[str] = D.STOPWORDS_EN) -> DataFrame:
    """(word, synonym, rank, cosine): ``nearest_words`` over the corpus ``df``.  Of the pair counts only
    those of ``least`` or more are written, with each word's sum over all."""
    once = _counted_once(df, text_col, window, stopwords)
    own = once.select(F.explode(F.array("a", "b")).alias("a"), F.lit(None).cast("string").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n"))
    # both branches read the same shuffled counts
    counted = cut_lineage(once.where(F.col("n") >= least).unionByName(own))
    sums = counted.where("b IS NULL").select(F.col("a").alias("word"), F.col("n").alias("own"))
    vectors = cut_lineage(_both_ways(_weighted(counted.where("b IS NOT NULL"), sums, "a", "b"), "weight"))
    release(counted)
    found = nearest_words(vectors, queries, k)
    release(vectors)
    return found
