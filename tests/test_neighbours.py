"""Exact neighbours and closest pairs against brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import neighbours as N

SCHEMA = "k string, c string, v array<double>, id string, `rank` string"


def brute(rows, k):
    out = []
    for key, label, v in rows:
        near = sorted((math.dist(v, w), other) for other, c, w in rows if c == label and other != key)
        out += [(key, other, i, round(d, 9)) for i, (d, other) in enumerate(near[:k], 1)]
    return sorted(out)


def found(df):
    return sorted((r["key"], r["neighbour"], r["rank"], round(r["distance"], 9)) for r in df.collect())


def test_against_brute_force(spark):
    """A grid with many ties, a hot vector, a class of its own size, a class of one row."""
    r = random.Random(3)
    rows = [("a%03d" % i, "grid", [float(r.randrange(9)), float(r.randrange(9))]) for i in range(260)]
    rows += [("h%03d" % i, "grid", [4.0, 4.0]) for i in range(120)]
    rows += [("b%d" % i, "few", [float(i), 0.5]) for i in range(4)] + [("one", "single", [1.0, 1.0])]
    rows += [("g%d" % i, "wide", [r.gauss(0, 1) for _ in range(12)]) for i in range(80)]
    r.shuffle(rows)
    odd = [(None, "grid", [1.0, 1.0]), ("n1", None, [1.0, 1.0]), ("n2", "grid", None), ("n3", "grid", [float("nan"), 1.0]), ("n4", "grid", [None, 1.0])]
    df = spark.createDataFrame([(*x, "i", "r") for x in rows + odd], SCHEMA).repartition(3)
    for k in (1, 5):
        assert found(N.nearest(df, "k", "c", "v", k)) == brute(rows, k)
    assert N.nearest(df.limit(0), "k", "c", "v", 3).count() == 0


def test_few_cells_are_visited(spark):
    """Of points in a plane, a query is sent to a few cells only, and their share falls with size."""
    shares = []
    for n in (400, 2000):
        rng = np.random.default_rng(n)
        pdf = pd.DataFrame({"id": range(n), "label": 1, "h": range(n), "vec": rng.random((n, 2)).tolist()})
        points = spark.createDataFrame(pdf, "id long, label long, h long, vec array<double>")
        pivots = N._pivots(points)
        cells = next(N._assigned(pivots, 5)(iter([pdf])))
        radii = cells.groupby(["label", "cell"])["dist"].max().to_dict()
        sizes = cells.groupby("cell").size()
        sent = pd.concat(N._sent(pivots, radii)(iter([cells])))
        pairs = sizes.loc[sent["cell"]].sum() + (sizes * sizes).sum()
        shares.append(pairs)
        assert pairs < 0.6 * n * n
    assert shares[1] < 17 * shares[0]  # all pairs grow 25 times


def test_similarity(spark):
    r = random.Random(4)
    rows = [(i, i % 3, [r.gauss(0, 1) for _ in range(5)]) for i in range(60)] + [(100, 0, [0.0] * 5), (101, 7, [1.0] * 5)]
    df = spark.createDataFrame(rows, "k long, g long, v array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)
    pairs = [(cos(v, w), a, b, g == h) for a, g, v in rows for b, h, w in rows if a < b and any(v) and any(w)]
    got = N.mean_similarity(df, "k", "v").first()
    assert got["rows"] == 61 and got["mean_similarity"] == pytest.approx(sum(p[0] for p in pairs) / len(pairs))
    best = N.most_similar_pair(df, "k", "v").first()
    assert (best["a"], best["b"]) == max(pairs)[1:3] and best["similarity"] == pytest.approx(max(pairs)[0])
    groups = {r["g"]: r["mean_similarity"] for r in N.mean_similarity(df, "k", "v", "g").collect()}
    same = [p for p in pairs if p[3] and p[1] % 3 == 1 and p[1] < 100]
    assert groups[7] is None and groups[1] == pytest.approx(sum(p[0] for p in same) / len(same))
    assert N.most_similar_pair(df, "k", "v", "g").where(F.col("g") == 7).count() == 0


def test_a_query_is_sent_once_to_a_shelf(spark):
    """Without structure most cells are asked for, but their vectors go to a few shelves only."""
    n = 1500
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": range(n), "label": 1, "h": range(n), "vec": rng.normal(size=(n, 16)).tolist()})
    pivots = N._pivots(spark.createDataFrame(pdf, "id long, label long, h long, vec array<double>"))
    cells = next(N._assigned(pivots, 5)(iter([pdf])))
    radii = cells.groupby(["label", "cell"])["dist"].max().to_dict()
    shelves = N._shelved(pivots, cells.groupby(["label", "cell"]).size().to_dict())
    sent = pd.concat(N._sent(pivots, radii, shelves)(iter([cells])))
    assert len(sent) <= n and set(sent["shelf"]) == {0}  # 1,500 points are one shelf
    asked = {(q, int(c)) for q, some in zip(sent["q"], sent["cells"]) for c in np.frombuffer(some, np.int32)}
    each = pd.concat(N._sent(pivots, radii)(iter([cells])))
    assert asked == set(zip(each["q"], each["cell"])) and len(asked) > 5 * n
    # the closest pair needs no cell that cannot hold one
    bound = cells.assign(bound=0.01)
    assert sum(map(len, N._sent(pivots, radii, shelves)(iter([bound])))) < n / 20


def test_many_shelves(spark, monkeypatch):
    """Shelves smaller than cells and classes, a class of copies, tied closest pairs."""
    monkeypatch.setattr(N, "SHELF", 16)
    r = random.Random(5)
    rows = [("a%03d" % i, "grid", [float(r.randrange(1, 30)), float(r.randrange(1, 30))]) for i in range(200)]
    rows += [("g%03d" % i, "wide", [r.gauss(0, 1) for _ in range(12)]) for i in range(150)]
    rows += [("h%03d" % i, "tight", [1e6 + r.randrange(40), 1e6]) for i in range(30)] + [("p", "two", [0.0, 1.0]), ("q", "two", [1.0, 0.0])]
    df = spark.createDataFrame([(*x, "i", "r") for x in rows], SCHEMA).repartition(3)
    assert found(N.nearest(df, "k", "c", "v", 3)) == brute(rows, 3)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)
    got = {x["c"]: x for x in N.most_similar_pair(df.where("c <> 'grid'"), "k", "v", "c").collect()}
    for label in ("wide", "two", "tight"):
        mine = [(k, v) for k, c, v in rows if c == label]
        best = max(cos(v, w) for k, v in mine for m, w in mine if k < m)
        assert got[label]["similarity"] == pytest.approx(best)
    assert (got["two"]["a"], got["two"]["b"]) == ("p", "q")
    # equal distances: the smallest keys
    ties = spark.createDataFrame([(i, [float(x == i % 8) for x in range(8)]) for i in range(8)], "k long, v array<double>")
    assert N.most_similar_pair(ties, "k", "v").first()[:2] == (0, 1)
    # a key that comes twice is no pair with itself, at the same place or near by
    odd = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.01, 1.0]), (3, [0.9, 0.5]), (4, [0.6, 0.8]), (5, [-1.0, 0.1])]
    assert N.most_similar_pair(spark.createDataFrame(odd, "k long, v array<double>"), "k", "v").first()[:2] == (3, 4)
