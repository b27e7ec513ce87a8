"""Exact nearest neighbours and closest pairs without joining on the class alone.

Rows that share a vector are one point.  Some points of each class, about the square root of their
number, are pivots; every point belongs to the cell of its nearest one.  A point first looks
for neighbours in its own cell, which bounds how far they can be, and is then sent only to the
cells that the triangle inequality does not rule out:

    d(q, s) >= d(q, p) - r        for every s in the cell of p with radius r
    d(q, s) >= (d(q, p)^2 - d(q, p0)^2) / 2 d(p, p0)   where p0 is the pivot nearest to q, the
                                  distance of q from the plane between the two cells

Cells near each other share a shelf of a bounded number of points, larger cells are cut into
several; a query is sent once to a shelf, with the numbers of its cells, and queries stream past it,
so no task holds a class or a cell.  Inside, matrix products give squared distances up to rounding;
what they do not rule out is measured row by row.  In many dimensions with no structure few cells
can be ruled out; the result stays exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

#: Points of a cell that are compared at once.
PART = 2048
#: Points that one task holds at once.
SHELF = 16_384
#: Queries that meet them at once.
QUERIES = 1024
#: Points compared with all pivots at once.
STEP = 64
#: Bytes of pivots that may be sent to all tasks.
PIVOT_BYTES = 256 << 20
#: Bounds are widened by this share, so that rounding rules nothing out.
SLACK = 1e-9
#: Rounding of a squared distance by a matrix product, as a share of the squared lengths for each dimension.
ROUNDING = 1e-15
TINY = 1e-300

_FOUND = "q long, distance double, id long"


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of a and b, row by row."""
    d = a - b
    return np.sqrt((d * d).sum(axis=1))


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all rows of a and b from one matrix product, and the most by which rounding
    may have changed them."""
    aa, bb = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)[None, :]
    return aa + bb - 2 * (a @ b.T), ROUNDING * (a.shape[1] + 10) * (aa + bb)


def _matrix(packed) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=np.float64).reshape(len(packed), -1)


def _points(df: DataFrame, key: str, label: str, vec: str, keep: int) -> tuple[DataFrame, DataFrame]:
    """Distinct (id, label, vec, first) with the ``keep`` smallest keys of each, and (key, id) of all
    rows.  Rows without label, vector or key take no part, nor do vectors with a NULL or NaN."""
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vec).cast("array<double>").alias("vec"))
    rows = rows.where("key IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL AND NOT exists(vec, x -> x IS NULL OR isnan(x))")
    rows = cut_lineage(rows.withColumn("h", F.xxhash64("vec")))
    # the smallest keys of a point, in salted parts first
    first = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(64)))
    for by in (["label", "h", "vec", "salt"], ["label", "h", "vec"]):
        first = first.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).where(F.col("n") <= keep)
    points = first.groupBy("label", "h", "vec").agg(F.sort_array(F.collect_list("key")).alias("first"))
    # ids in order of the smallest key, so that equal distances by id are equal distances by key
    points = cut_lineage(points.orderBy(F.element_at("first", 1)).withColumn("id", F.monotonically_increasing_id()))
    return points, rows.join(points.select("label", "h", "vec", "id"), ["label", "h", "vec"]).select("key", "id")


def _pivots(points: DataFrame) -> dict:
    """Per class the vectors of its pivots (points chosen by hash)."""
    sizes = {r["label"]: r["n"] for r in points.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    dims = points.select(F.max(F.size("vec"))).first()[0] or 0
    wanted = sum(2 * math.ceil(math.sqrt(n)) for n in sizes.values())
    if wanted * dims * 8 > PIVOT_BYTES:
        raise ValueError(f"{wanted} pivots of {dims} dimensions are too many to send to all tasks")
    shares = points.sparkSession.createDataFrame([(c, 1 / math.sqrt(n)) for c, n in sizes.items()], points.select("label", F.lit(0.0).alias("share")).schema) if sizes else None
    if shares is None:
        return {}
    u = F.pmod(F.xxhash64("id", "h"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    least = points.groupBy("label").agg(F.min("id").alias("id"))
    chosen = points.join(F.broadcast(shares), "label").where(u < F.col("share")).select("id", "label", "vec")
    chosen = chosen.unionByName(points.join(F.broadcast(least), ["label", "id"], "left_semi").select("id", "label", "vec")).distinct()
    found: dict = {}
    for r in chosen.orderBy("id").collect():  # about the root of each class
        found.setdefault(r["label"], []).append(r["vec"])
    return {c: np.array(v) for c, v in found.items()}


def _assigned(pivots: dict, k: int):
    """A map from points to their cell, their distance to its pivot and a first bound on the distance
    of the k-th neighbour: pivots are points themselves.  Vectors are packed as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for label, part in b.groupby("label", sort=False):
                p = pivots[label]
                x = np.stack(part["vec"].tolist()).astype(np.float64)
                cell, dist, bound = [], [], []
                for a in range(0, len(x), STEP):
                    d, off = _squares(x[a : a + STEP], p)
                    own = d.argmin(axis=1)
                    cell += own.tolist()
                    dist += _distances(x[a : a + STEP], p[own]).tolist()
                    bound += (np.sqrt(np.partition(np.maximum(d + off, 0), k, axis=1)[:, k]) if d.shape[1] > k else np.full(len(d), np.inf)).tolist()
                yield part.assign(cell=cell, dist=dist, bound=bound, vec=[v.tobytes() for v in x])[["id", "label", "vec", "cell", "dist", "bound"]]

    return run


def _sent(pivots: dict, radii: dict, shelves: dict | None = None):
    """A map from points with a bound to the other cells that may hold a nearer one; with ``shelves``
    (of each class the first shelf and the number of shelves by cell) one row for each shelf, with
    its cells packed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for label, part in b.groupby("label", sort=False):
                p = pivots[label]
                r = np.array([radii.get((label, c), -np.inf) for c in range(len(p))])
                most = (p * p).sum(axis=1).max()
                for a in range(0, len(part), STEP):
                    rows = part.iloc[a : a + STEP]
                    x, own = _matrix(rows["vec"].tolist()), rows["cell"].to_numpy()
                    bound, dist = rows["bound"].to_numpy()[:, None], rows["dist"].to_numpy()[:, None]
                    d, off = _squares(x, p)
                    between, wide = _squares(p[own], p)
                    # rounding where a point within the bound was given its cell, too
                    off = off + ROUNDING * (x.shape[1] + 10) * (2 * most + 2 * (np.sqrt((x * x).sum(axis=1))[:, None] + bound) ** 2)
                    ring = np.sqrt(np.maximum(d - off, 0)) - r[None, :]
                    side = (d - dist * dist - 2 * off) / (2 * np.sqrt(np.maximum(between, 0) + wide) + TINY)
                    go = ~(np.fmax(ring, side) > bound * (1 + SLACK) + SLACK * dist) & np.isin(np.arange(len(p)), np.flatnonzero(r != -np.inf))[None, :]
                    go[np.arange(len(rows)), own] = False
                    at, cell = np.nonzero(go)
                    if not len(at):
                        continue
                    q, vec, cell = rows["id"].to_numpy(), rows["vec"].to_numpy(), cell.astype("int32")
                    if shelves is None:
                        yield pd.DataFrame({"q": q[at], "label": label, "cell": cell, "vec": vec[at]})
                        continue
                    first, parts = shelves[label]
                    n = parts[cell]
                    shelf = np.repeat(first[cell], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    at, cell = np.repeat(at, n), np.repeat(cell, n)
                    order = np.lexsort((cell, shelf, at))
                    at, cell, shelf = at[order], cell[order], shelf[order]
                    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (shelf[1:] != shelf[:-1])]))
                    ends = np.append(cut[1:], len(at))
                    yield pd.DataFrame({"q": q[at[cut]], "shelf": shelf[cut], "cells": [cell[i:j].tobytes() for i, j in zip(cut, ends)], "vec": vec[at[cut]], "bound": rows["bound"].to_numpy()[at[cut]]})

    return run


def _shelved(pivots: dict, sizes: dict) -> dict:
    """Of each class the first shelf and the number of shelves by cell.  Cells near each other share a
    shelf of up to SHELF points; a larger cell has shelves of its own."""
    found, shelf = {}, 0
    for label, p in pivots.items():
        n = np.array([sizes.get((label, c), 0) for c in range(len(p))])
        parts = np.maximum(1, -(-n // SHELF))
        heads = p[: max(1, -(-int(n.sum()) // SHELF))]
        by = np.concatenate([_squares(p[a : a + STEP], heads)[0].argmin(axis=1) for a in range(0, len(p), STEP)])
        first, held = np.zeros(len(p), dtype=np.int64), 0
        for c in np.lexsort((np.arange(len(p)), by)):
            if parts[c] > 1 or held + n[c] > SHELF:
                shelf, held = shelf + (held > 0), 0
            first[c] = shelf
            if parts[c] > 1:
                shelf += int(parts[c])
            else:
                held += n[c]
        shelf += held > 0
        found[label] = (first, parts)
    return found


def _visited(k: int):
    """A map over rows sorted by shelf, its points before its queries: each query's k + 1 nearest
    within its bound, of the cells that it asks for."""

    def best(rows: pd.DataFrame, ids: np.ndarray, y: np.ndarray, span: dict) -> pd.DataFrame:
        x, q = _matrix(rows["vec"].tolist()), rows["q"].to_numpy()
        wanted = [np.array([c], dtype=np.int32) if some is None else np.frombuffer(some, dtype=np.int32) for c, some in zip(rows["cell"].tolist(), rows["cells"].tolist())]
        cells, who = np.concatenate(wanted), np.repeat(np.arange(len(rows)), [len(w) for w in wanted])
        order = np.argsort(cells, kind="stable")
        cells, who = cells[order], who[order]
        limit = rows["bound"].to_numpy() ** 2 * (1 + 4 * SLACK)
        cuts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])).tolist() + [len(cells)]
        at, to = [], []
        for lo, hi in zip(cuts, cuts[1:]):
            start, end = span.get(int(cells[lo]), (0, 0))
            for a in range(start, end, PART):
                z, some = y[a : min(end, a + PART)], who[lo:hi]
                d, off = _squares(x[some], z)
                near = ~(d > limit[some][:, None] + off)
                if len(z) > k + 1 and near.sum() > 4 * (k + 1) * len(some):
                    limit[some] = np.fmin(limit[some], np.partition(d + off, k, axis=1)[:, k])
                    near = ~(d > limit[some][:, None] + off)
                i, j = np.nonzero(near)
                at.append(some[i])
                to.append(j + a)
        at, to = np.concatenate(at or [np.zeros(0, np.int64)]), np.concatenate(to or [np.zeros(0, np.int64)])
        dist = np.concatenate([_distances(x[at[a : a + 65536]], y[to[a : a + 65536]]) for a in range(0, len(at), 65536)] or [np.zeros(0)])
        order = np.lexsort((ids[to], dist, at))
        at, to, dist = at[order], to[order], dist[order]
        n = np.arange(len(at)) - np.searchsorted(at, at)
        few = n <= k
        return pd.DataFrame({"q": q[at[few]], "distance": dist[few], "id": ids[to[few]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, kept = None, None, []
        for b in batches:
            shelf, query = b["shelf"].to_numpy(), b["query"].to_numpy()
            cuts = [0, *(np.flatnonzero((shelf[1:] != shelf[:-1]) | (query[1:] != query[:-1])) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if shelf[lo] != now:
                    now, held, kept = shelf[lo], None, []
                if not query[lo]:
                    kept.append((b["q"].to_numpy()[lo:hi], b["cell"].to_numpy()[lo:hi].astype(np.int64), _matrix(b["vec"].tolist()[lo:hi])))
                    continue
                if not kept:
                    continue
                if held is None:
                    ids, cells, x = (np.concatenate([part[i] for part in kept]) for i in range(3))
                    order = np.lexsort((ids, cells))
                    cells = cells[order]
                    kinds, first = np.unique(cells, return_index=True)
                    held = ids[order], x[order], dict(zip(kinds.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(cells)])))
                for a in range(lo, hi, QUERIES):
                    yield best(b.iloc[a : min(hi, a + QUERIES)], *held)

    return run


def _visit(queries: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """(q, distance, id): of each shelf, the k + 1 nearest points in each query's cells."""
    points = held.select("shelf", F.lit(False).alias("query"), F.col("id").alias("q"), "cell", F.lit(None).cast("binary").alias("cells"), "vec", F.lit(0.0).alias("bound"))
    asked = queries.select("shelf", F.lit(True).alias("query"), "q", "cell", "cells", "vec", "bound")
    both = points.unionByName(asked).repartition("shelf").sortWithinPartitions("shelf", "query")
    return both.mapInPandas(_visited(k), _FOUND)


def nearest(df: DataFrame, key: str, label: str, vec: str, k: int = 5) -> DataFrame:
    """(key, neighbour, rank, distance): the exact k nearest other rows (Euclidean) of the same class,
    equal distances by neighbour key; all others where a class has fewer.

    Rows with a NULL key, label or vector, or a NULL or NaN in it, take no part; keys are unique;
    vectors of one class have one length.  Rows with one vector are one point, so a vector that
    very many rows share costs no pairs.  An empty table gives an empty result.
    """
    return _nearest(df, key, label, vec, k)


def _nearest(df: DataFrame, key: str, label: str, vec: str, k: int, closest: bool = False) -> DataFrame:
    """``nearest``; with ``closest`` only neighbours no farther than the closest pair that a cell of
    the class holds: all that can be the closest pair."""
    points, rows = _points(df, key, label, vec, k + 1)
    pivots = _pivots(points)
    kind = points.schema["label"].dataType.simpleString()
    cells = cut_lineage(points.select("id", "label", "vec").mapInPandas(_assigned(pivots, k), f"id long, label {kind}, vec binary, cell int, dist double, bound double"))
    # one row for each pivot
    sizes = {(r["label"], r["cell"]): (r["n"], r["radius"]) for r in cells.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius")).collect()}
    shelves = _shelved(pivots, {c: n for c, (n, _) in sizes.items()})
    placed = [(label, c, int(shelves[label][0][c]), int(shelves[label][1][c])) for label, c in sizes]
    places = df.sparkSession.createDataFrame(placed, f"label {kind}, cell int, first long, parts long")
    cells = cut_lineage(cells.join(F.broadcast(places), ["label", "cell"]).withColumn("shelf", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))))
    at_home = cells.select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("shelf"), F.col("id").alias("q"), "cell", F.lit(None).cast("binary").alias("cells"), "vec", "bound")
    home = cut_lineage(_visit(at_home, cells, k))
    if closest:
        # rows that share a vector are a pair as well; a key that comes twice may have no neighbour but itself
        twice = points.where("element_at(first, 1) <> element_at(first, -1)").select("label", F.lit(0.0).alias("least"))
        again = rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "key", "left_semi").select(F.col("id").alias("q")).distinct()
        least = home.where("q <> id").join(again, "q", "left_anti").join(cells.select(F.col("id").alias("q"), "label"), "q").select("label", F.col("distance").alias("least"))
        least = cut_lineage(least.unionByName(twice).groupBy("label").agg(F.min("least").alias("least")))
        limits = cells.select("id", "label").join(F.broadcast(least), "label").select(F.col("id").alias("q"), "least")
        home = home.join(limits, "q").where("distance <= least").drop("least")
        bounded = cells.join(F.broadcast(least), "label", "left").withColumn("bound", F.least("bound", "least")).drop("least")
    else:
        near = home.groupBy("q").agg(F.slice(F.array_sort(F.collect_list("distance")), k + 1, 1).alias("d"))
        known = near.where(F.size("d") > 0).select(F.col("q").alias("id"), F.element_at("d", 1).alias("known"))
        bounded = cells.join(known, "id", "left").withColumn("bound", F.least("bound", "known"))
    bounded = bounded.select("id", "label", "vec", "cell", "dist", "bound")
    sent = bounded.mapInPandas(_sent(pivots, {c: radius for c, (_, radius) in sizes.items()}, shelves), "q long, shelf long, cells binary, vec binary, bound double")
    away = _visit(sent.withColumn("cell", F.lit(None).cast("int")), cells, k)
    lists = home.unionByName(away)
    best = Window.partitionBy("q").orderBy("distance", "id")
    lists = lists.withColumn("n", F.dense_rank().over(best)).where(F.col("n") <= k + 1)  # a point: its distance and id
    # points to keys: k + 1 of each are enough, one of which may be the row itself
    named = lists.distinct().join(points.select("id", "first"), "id").select("q", "distance", F.explode("first").alias("neighbour"))
    few = Window.partitionBy("q").orderBy("distance", "neighbour")
    named = named.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
    named = named.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))).alias("near"))
    mine = rows.join(named, F.col("id") == F.col("q")).select("key", F.expr(f"slice(filter(near, x -> x.neighbour <> key), 1, {k})").alias("near"))
    return mine.select("key", F.posexplode("near").alias("at", "x")).select("key", F.col("x.neighbour").alias("neighbour"), (F.col("at") + 1).alias("rank"), F.col("x.distance").alias("distance"))


def _unit(df: DataFrame, key: str, vec: str, group: str | None) -> DataFrame:
    v = F.col(vec).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    rows = df.select(F.col(key).alias("key"), (F.col(group) if group else F.lit(0)).alias("grp"), v.alias("v"), norm.alias("norm"))
    # the norm is bound to a name, or it would be computed again for each component
    unit = F.transform(F.array("norm"), lambda n: F.transform("v", lambda x: x / F.nullif(n, F.lit(0.0))))
    return rows.where("norm > 0").select("key", "grp", unit[0].alias("u"))


def mean_similarity(df: DataFrame, key: str, vec: str, group: str | None = None) -> DataFrame:
    """(group, rows, mean_similarity): the mean cosine similarity of all pairs, from the sum of the unit
    vectors: (|sum|^2 - n) / (n (n - 1)).  No pair is formed.  Vectors of zeros, which have no
    direction, are left out; NULL for fewer than two rows."""
    unit = _unit(df, key, vec, group)
    n = F.col("n").cast("double")
    sums = unit.select("grp", F.posexplode("u").alias("i", "x")).groupBy("grp", "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    out = sums.groupBy("grp").agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"))
    out = out.select(F.col("grp").alias(group or "grp"), F.col("n").alias("rows"), F.when(n > 1, (F.col("ss") - n) / (n * (n - 1))).alias("mean_similarity"))
    return out if group else out.drop("grp")


def most_similar_pair(df: DataFrame, key: str, vec: str, group: str | None = None) -> DataFrame:
    """(group, a, b, similarity), a < b: the pair of rows with the greatest cosine similarity, of all rows
    or of each group; equal ones by the smallest keys.  It is the closest pair of unit vectors: the
    closest one inside a cell bounds it, and only cells that may hold a closer one are visited."""
    unit = _unit(df, key, vec, group)
    pairs = _nearest(unit, "key", "grp", "u", 1, closest=True).select(F.least("key", "neighbour").alias("a"), F.greatest("key", "neighbour").alias("b"), "distance")
    with_group = pairs.join(unit.select(F.col("key").alias("a"), "grp"), "a")
    best = with_group.groupBy("grp").agg(F.min(F.struct("distance", "a", "b")).alias("p"))
    out = best.select(F.col("grp").alias(group or "grp"), "p.a", "p.b", (1 - F.col("p.distance") * F.col("p.distance") / 2).alias("similarity"))
    return out if group else out.drop("grp")
