"""Ranked lexical search with document FP-trees and branch and bound.

A document is reduced to its terms that some item holds, in descending order of document
frequency.  A task sorts a shard of such vectors into a trie, in which documents share the paths
of their commonest terms; each node knows the greatest tf of every term among the documents below
it and their least m.  For an item these bound every score below a node, so a depth-first search
that takes the children of the highest bound first leaves out what cannot reach the item's present
k-th score, which goes on from shard to shard of a task.  Items come in blocks of a bounded number
of distinct terms; a block is one pass over the reduced vectors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import release, write_cut

#: Terms: what is no ASCII punctuation, white space or control character.
TERM = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Documents of one trie, and of a node that is not parted further.
SHARD, LEAF = 8192, 32
#: Larger leaves where nodes times terms would pass four times this power of two.
NODE_CELLS = 22
#: Distinct terms of a block of items (one item may have more).
BLOCK_TERMS = 8192
#: Parts by which an item's candidates are ranked before they meet.
SALT = 64

VECTORS = "id long, n long, terms array<int>, tfs array<int>"


def item_terms(text: str | None) -> list[str]:
    return re.findall(TERM, (text or "").translate(LOWER))


def score_parts(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What terms add to a score, in 64-bit integers; ``m`` is the document's length part."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class DocumentTree:
    """FP-tree over documents given by term codes in ascending order (code 0: the commonest)."""

    def __init__(self, lengths: np.ndarray, codes: np.ndarray, tfs: np.ndarray, m: np.ndarray, ids: np.ndarray, n_codes: int, leaf: int = LEAF):
        leaf = max(leaf, len(ids) * n_codes >> NODE_CELLS)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        wide = codes.astype(">u4")
        keys = [wide[a:b].tobytes() for a, b in zip(starts, starts[1:])]
        order = sorted(range(len(lengths)), key=keys.__getitem__)  # trie order
        self.lengths = lengths[order]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        at = np.arange(self.starts[-1]) + np.repeat(starts[:-1][order] - self.starts[:-1], self.lengths)
        self.codes, self.tfs = codes[at], tfs[at].astype(np.int64)
        self.m, self.ids = m[order], ids[order]
        self.owner = np.repeat(np.arange(len(order)), self.lengths)
        self._part(leaf)
        self._bounds(n_codes)

    def _part(self, leaf: int) -> None:
        """Nodes as ranges of documents; the children of a node are consecutive nodes."""
        self.low, self.high, self.first, self.last = [0], [len(self.ids)], [0], [0]
        open_nodes = [(0, 0)]
        while open_nodes:
            node, depth = open_nodes.pop()
            a, b = self.low[node], self.high[node]
            if b - a <= leaf:
                continue
            while True:  # a path that all documents share is one node
                here = np.where(self.lengths[a:b] > depth, self.codes[np.minimum(self.starts[a:b] + depth, len(self.codes) - 1)], -1)
                cuts = np.flatnonzero(here[1:] != here[:-1]) + 1
                depth += 1
                if len(cuts) or here[0] < 0:
                    break
            if len(cuts):
                edges = (np.concatenate([[0], cuts, [b - a]]) + a).tolist()
            else:  # all have the same terms
                edges = list(range(a, b, leaf)) + [b]
            runs: list[tuple[int, int, bool]] = []
            for x, y in zip(edges, edges[1:]):
                if runs and not runs[-1][2] and y - runs[-1][0] <= leaf:  # small siblings share a node
                    runs[-1] = (runs[-1][0], y, False)
                else:
                    runs.append((x, y, y - x > leaf))
            self.first[node], self.last[node] = len(self.low), len(self.low) + len(runs)
            for x, y, deep in runs:
                if deep:
                    open_nodes.append((len(self.low), depth))
                self.low.append(x)
                self.high.append(y)
                self.first.append(0)
                self.last.append(0)

    def _bounds(self, n_codes: int) -> None:
        """Greatest tf of every code, and least m, below each node; children come after parents."""
        self.tf_max = np.zeros((len(self.low), n_codes), dtype=np.int32)
        self.m_min = np.zeros(len(self.low), dtype=np.int64)
        for node in range(len(self.low) - 1, -1, -1):
            a, b = self.first[node], self.last[node]
            if a < b:
                self.tf_max[node] = self.tf_max[a:b].max(axis=0)
                self.m_min[node] = self.m_min[a:b].min()
            else:
                x, y = self.low[node], self.high[node]
                span = slice(self.starts[x], self.starts[y])
                np.maximum.at(self.tf_max[node], self.codes[span], self.tfs[span])
                self.m_min[node] = self.m[x:y].min() if x < y else 0

    def search(self, terms: np.ndarray, weights: np.ndarray, by_code: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best (-score, id) of ``best`` and this tree's documents with a score above 0.
        ``by_code`` holds the weights by code, 0 for codes that are not in the item."""
        stack = [(1 << 62, 0)]
        while stack:
            bound, node = stack.pop()
            floor = -best[-1][0] if len(best) == k else 1
            if bound < floor:
                continue
            a, b = self.first[node], self.last[node]
            if a < b:
                tops = score_parts(weights, self.tf_max[a:b][:, terms].astype(np.int64), self.m_min[a:b, None]).sum(axis=1)
                for c in np.argsort(tops, kind="stable").tolist():  # the highest is popped first
                    if tops[c] >= floor:
                        stack.append((int(tops[c]), a + c))
                continue
            x, y = self.low[node], self.high[node]
            span = slice(self.starts[x], self.starts[y])
            w = by_code[self.codes[span]]
            held = np.flatnonzero(w)
            owner = self.owner[span][held]
            scores = np.zeros(y - x, dtype=np.int64)
            np.add.at(scores, owner - x, score_parts(w[held], self.tfs[span][held], self.m[owner]))
            found = np.flatnonzero(scores >= floor)
            if len(found):
                best = sorted(best + list(zip((-scores[found]).tolist(), self.ids[x:y][found].tolist())))[:k]
        return best


def _reduced(vocabulary: dict[str, int]):
    """A map from documents to their vectors over the vocabulary; ``n`` counts all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TERM).findall
        code_of = vocabulary.get
        for batch in batches:
            sizes, terms, tfs, offsets = [], [], [], [0]
            for text in batch["text"]:
                counts = Counter(find((text.as_py() or "").translate(LOWER)))
                sizes.append(counts.total())
                for term, tf in counts.items():
                    code = code_of(term)
                    if code is not None:
                        terms.append(code)
                        tfs.append(tf)
                offsets.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(sizes, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])

    return run


def _searched(items: list[tuple[int, np.ndarray, np.ndarray]], place: np.ndarray, n_docs: int, n_terms: int, k: int, shard: int):
    """A map from vectors to each item's k best documents in a task.  ``items`` are (number, codes,
    weights), ``place`` the order of a code by document frequency."""
    no_id = np.iinfo(np.int64).max  # a null id comes last among equal scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {number: [] for number, _, _ in items}
        by_code = np.zeros(len(place), np.int64)

        def search(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts).combine_chunks()
            lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table["terms"], table["tfs"])]
            lists = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in lists]
            offsets = lists[0].offsets.to_numpy()
            lengths = np.diff(offsets).astype(np.int64)
            codes = place[lists[0].flatten().to_numpy()]
            tfs = lists[1].flatten().to_numpy()
            owner = np.repeat(np.arange(len(lengths)), lengths)
            order = np.lexsort((codes, owner))
            n = table["n"].to_numpy()
            m = 75 + (25 * n * n_docs) // n_terms
            ids = table["id"].combine_chunks().fill_null(no_id).to_numpy(zero_copy_only=False)
            tree = DocumentTree(lengths, codes[order], tfs[order], m, ids, len(place))
            for number, terms, weights in items:
                by_code[terms] = weights
                best[number] = tree.search(terms, weights, by_code, k, best[number])
                by_code[terms] = 0

        held, rows = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, shard):
                part = batch.slice(a, shard)
                if held and rows + part.num_rows > shard:
                    search(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            search(held)
        out = [(number, i, -s) for number, found in best.items() for s, i in found]
        columns = list(zip(*out)) or [[], [], []]
        docs = [None if i == no_id else i for i in columns[1]]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(docs, pa.int64()), pa.array(columns[2], pa.int64())], names=["number", "doc", "score"])

    return run


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int | None, list[str]]]]:
    """Items with terms, in blocks of a bounded number of distinct terms, one block at a time."""
    block: list[tuple[int | None, list[str]]] = []
    seen: set[str] = set()
    for row in items.toLocalIterator():
        terms = item_terms(row["text"])
        if block and len(seen.union(terms)) > most:
            yield block
            block, seen = [], set()
        if terms:
            block.append((row["id"], terms))
            seen.update(terms)
    if block:
        yield block


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard: int = SHARD, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Each item's k documents of the highest scores above 0, equal ones by ascending id: ``item_col``,
    ``rank`` (int, from 1), ``id_col`` and ``score`` (long).

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a document's m is 75 + 25 n N div L,
    and a term adds its weight times (10^9 tf div (1000 tf + 12 m)) for each occurrence in the
    item; N counts the documents with a term, L all their terms, n one document's.

    Null, empty and termless texts take no part, as documents or items.  Every row is a document
    by itself: repeated rows count and are ranked each; among equal scores a null id comes last.
    Every row of ``items`` is ranked by itself too, so a repeated or null item id repeats its
    rows.  Empty tables give an empty result; other columns are ignored.  Long texts are counted
    whole.  Nothing meets by key but counts and the k best of each task, first in salted parts.
    Items are read by the driver a block at a time; a task holds one block's terms and one trie.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    schema = f"`{item_col}` long, rank int, `{id_col}` long, score long"
    results = []
    for block in _blocks(asked, block_terms):
        vocabulary = {t: c for c, t in enumerate(dict.fromkeys(t for _, terms in block for t in terms))}
        vectors = write_cut(rows.mapInArrow(_reduced(vocabulary), VECTORS), "vectors")
        total = vectors.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not total["docs"]:
            release(vectors)
            continue
        # one row for each term of the block
        df = np.zeros(len(vocabulary), np.int64)
        for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[r["t"]] = r["count"]
        place = np.empty(len(df), np.int64)
        place[np.argsort(-df, kind="stable")] = np.arange(len(df))
        weight = [math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * d + 1))) for d in df.tolist()]
        coded = []
        for number, (_, terms) in enumerate(block):
            counts = Counter(vocabulary[t] for t in terms)
            codes = np.array(list(counts), np.int64)
            coded.append((number, place[codes], np.array([weight[c] * times for c, times in counts.items()], np.int64)))
        best = vectors.where("size(terms) > 0").mapInArrow(_searched(coded, place, total["docs"], total["terms"], k, shard), "number int, doc long, score long")
        best = best.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(SALT)))
        order = [F.desc("score"), F.asc_nulls_last("doc")]
        for keys in (["number", "part"], ["number"]):
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        # the block's own ids, one row for each item
        names = spark.createDataFrame([(number, i) for number, (i, _) in enumerate(block)], "number int, item long")
        ranked = best.join(F.broadcast(names), "number").select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score")
        results.append(write_cut(ranked, "ranked"))
        release(vectors)
    if not results:
        return spark.createDataFrame([], schema)
    out = results[0]
    for r in results[1:]:
        out = out.unionAll(r)
    return out
