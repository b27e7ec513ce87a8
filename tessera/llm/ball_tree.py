"""Exact top-k by inner product: a ball tree for each shard, searched by branch and bound.

A shard's vectors are packed, with their tree, into one row of bounded size; so are blocks of
queries.  A node with centre c and radius r can give a query q no more than q.c + |q| r.  Nodes
are visited by falling bound, with the queries that may still gain there, until no bound reaches
a query's present k-th score.  The first shard's k-th scores are handed to all other shards as
their starting bounds, and these return only what reaches them.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import write_cut

#: Vectors in a shard, queries in a block, vectors in a leaf.
SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 16_384, 1_024, 128
NONE = np.iinfo(np.int64).min


def small(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type."""
    most = np.abs(values).max(initial=0)
    return values.astype(next((t for t in (np.int8, np.int16, np.int32) if most <= np.iinfo(t).max), np.int64))


def build(ids: np.ndarray, vectors: np.ndarray) -> dict:
    """Ball tree: vectors in leaf order, and for each node its centre, radius, range and children."""
    order = np.arange(len(ids))
    x = vectors.astype(np.float64)
    nodes: list[list] = []
    todo = [(0, len(ids), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        me = len(nodes)
        rows = x[order[a:b]]
        centre = rows.mean(axis=0)
        far = np.sqrt(((rows - centre) ** 2).sum(axis=1))
        nodes.append([centre, float(far.max(initial=0.0)), a, b, -1, -1])
        if parent >= 0:
            nodes[parent][4 + side] = me
        if b - a > LEAF_ROWS and far.max() > 0:
            # part along the line between a far point and the point farthest from it
            one = rows[far.argmax()]
            two = rows[((rows - one) ** 2).sum(axis=1).argmax()]
            along = rows @ (two - one)
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(along, half)]
            todo += [(a, a + half, me, 0), (a + half, b, me, 1)]
    return {"ids": ids[order], "x": small(vectors[order]), "centre": np.array([n[0] for n in nodes]), "radius": np.array([n[1] for n in nodes]), "range": np.array([n[2:4] for n in nodes]), "child": np.array([n[4:6] for n in nodes])}


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact whole-number inner products: in doubles where none can pass 2^53."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x.astype(np.int64)).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def search(tree: dict, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (rows by falling score, then id) of each query's k best in the tree among
    those that reach ``floor``; NONE where there are fewer.  A query's own id is left out."""
    n = len(ids)
    best = np.full((n, k), NONE, dtype=np.int64)
    best_id = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)
    norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    qf = q.astype(np.float64)

    def bound(node: int, who: np.ndarray) -> np.ndarray:
        b = qf[who] @ tree["centre"][node] + norm[who] * tree["radius"][node]
        return b + 1e-9 * (1 + np.abs(b))  # rounding must not prune

    def need(who: np.ndarray) -> np.ndarray:
        return np.maximum(best[who, k - 1], floor[who])

    everyone = np.arange(n)
    ub = bound(0, everyone)
    queue = [(-ub.max(initial=-np.inf), 0, everyone, ub)]
    while queue:
        _, node, who, ub = heapq.heappop(queue)
        open_ = ub >= need(who)  # equal scores may still have smaller ids
        who = who[open_]
        if not len(who):
            continue
        left, right = tree["child"][node]
        if left >= 0:
            for child in (left, right):
                ub = bound(child, who)
                some = ub >= need(who)
                if some.any():
                    heapq.heappush(queue, (-ub[some].max(), child, who[some], ub[some]))
            continue
        a, b = tree["range"][node]
        for at in range(a, b, 4096):  # a leaf of equal vectors may be large
            upto = min(b, at + 4096)
            scores, names = products(q[who], tree["x"][at:upto]), tree["ids"][at:upto]
            scores[ids[who][:, None] == names[None, :]] = NONE
            gain = scores.max(axis=1) >= need(who)
            if not gain.any():
                continue
            w = who[gain]
            s = np.hstack([best[w], scores[gain]])
            i = np.hstack([best_id[w], np.broadcast_to(names, (len(w), len(names)))])
            s[s < floor[w][:, None]] = NONE
            i[s == NONE] = np.iinfo(np.int64).max
            order = np.lexsort((i, ~s), axis=-1)[:, :k]  # ~s falls as s rises, for NONE too
            best[w], best_id[w] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
    return best, best_id


def _pairs(blocks: DataFrame, shards: DataFrame, k: int, n: int) -> DataFrame:
    """Each block searched in each shard it is joined to: (query_id, vec_id, score)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, tree in zip(batch["block"], batch["tree"], strict=True):
                ids, q, floor = pickle.loads(block)
                best, names = search(pickle.loads(tree), ids, q, floor, k)
                found = best != NONE
                yield pd.DataFrame({"query_id": np.repeat(ids, found.sum(axis=1)), "vec_id": names[found], "score": best[found]})

    joined = blocks.join(shards, ["dim", "shard"]).select("b", "shard", "block", "tree").repartition(n, "b", "shard")
    return joined.select("block", "tree").mapInPandas(run, "query_id long, vec_id long, score long")


def top_k(df: DataFrame, k: int = 20, scale: int = 64, query_every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` largest whole-number inner products of each query with all other rows:
    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    A component x counts as floor(scale * x).  Queries are the rows whose id is divisible by
    ``query_every``; equal scores rank by id.  Rows with a null id or vector, or a null or
    non-finite component, take no part.  Of rows that repeat an id, the one with the least vector
    counts.  Vectors are compared with those of their own dimension.  A query with fewer other
    rows gets them all; an empty table, or one without queries, gives an empty result.  Shards
    are dealt by a hash of the id, so equal vectors and hot labels spread evenly.
    """
    v = F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    odd = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~odd).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))
    rows = write_cut(rows.withColumn("dim", F.size("v")), "vectors")
    sizes = {r["dim"]: (r["n"], r["q"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("id") % query_every == 0).alias("q")).collect()}  # a row for each dimension
    shards_of, blocks_of = ({d: -(-c[j] // size) for d, c in sizes.items()} for j, size in ((0, SHARD_ROWS), (1, BLOCK_ROWS)))
    table = lambda of: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for d in of for x in (d, max(1, of[d]))]), F.col("dim")), F.lit(1)) if of else F.lit(1)

    def pack_tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        tree = build(pdf["id"].to_numpy(np.int64), np.array(pdf["v"].tolist(), dtype=np.int64).reshape(len(pdf), -1))
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1].to_numpy(), "shard": pdf["part"].iloc[:1].to_numpy(), "tree": [pickle.dumps(tree)]})

    def pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        q = small(np.array(pdf["v"].tolist(), dtype=np.int64).reshape(len(pdf), -1))
        floor = pdf["floor"].fillna(NONE).to_numpy(np.int64) if "floor" in pdf else np.full(len(pdf), NONE)
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1].to_numpy(), "b": pdf["part"].iloc[:1].to_numpy(), "block": [pickle.dumps((pdf["id"].to_numpy(np.int64), q, floor))]})

    part = lambda of: F.pmod(F.xxhash64("id"), table(of)).cast("int").alias("part")
    trees = write_cut(rows.select("id", "v", "dim", part(shards_of)).groupBy("dim", "part").applyInPandas(pack_tree, "dim int, shard int, tree binary"), "trees")
    queries = rows.where(F.col("id") % query_every == 0).select("id", "v", "dim", part(blocks_of))
    pack = "dim int, b int, block binary"
    n_first = max(1, sum(blocks_of.values()))
    first = write_cut(_pairs(queries.groupBy("dim", "part").applyInPandas(pack_block, pack).withColumn("shard", F.lit(0)), trees, k, n_first), "first")
    # a query's k-th score in the first shard, where it has so many, is a floor for all others
    floors = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == k).select(F.col("query_id").alias("id"), "floor")
    blocks = queries.join(floors, "id", "left").groupBy("dim", "part").applyInPandas(pack_block, pack)
    others = F.explode(F.expr("sequence(1, n_shards - 1)")).alias("shard")
    spread = blocks.withColumn("n_shards", table(shards_of)).where("n_shards > 1").select("dim", "b", "block", others)
    pairs = max(1, sum(blocks_of[d] * (shards_of[d] - 1) for d in sizes))
    found = first.unionAll(_pairs(spread, trees, k, min(pairs, 20_000)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
