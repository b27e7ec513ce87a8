"""Ranked lexical search against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm.fp_tree import DocumentTree, item_terms, ranked_search, score_parts

from .helpers import frame, odd_rows


def brute(docs, items, k):
    counted = [(i, Counter(item_terms(t))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in item_terms(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k], 1)]
    return out


def rows(df, item="item_id"):
    return sorted((str(r[item]), r["rank"], str(r["doc_id"]), r["score"]) for r in df.collect())


def texts(n, seed, vocabulary=60):
    r = random.Random(seed)
    base = [" ".join("w%d" % min(r.randrange(vocabulary), r.randrange(vocabulary)) for _ in range(r.randint(0, 25))) for _ in range(n // 2)]
    return [(i, t) for i, t in enumerate(base + [r.choice(base) for _ in range(n - len(base))])]


def test_terms():
    assert item_terms("Don't ÀB_c x1-Y\x7f中 文\x85z") == ["don", "t", "Àb", "c", "x1", "y", "中", "文\x85z"] and item_terms(None) == []


@pytest.mark.parametrize("shard,block", [(8192, 8192), (40, 8192), (64, 20)])
def test_against_brute_force(spark, shard, block):
    docs, items = texts(400, 1), texts(30, 2)
    got = ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k=7, shard=shard, block_terms=block)
    want = brute(docs, items, 7)
    assert len(want) > 100 and rows(got) == sorted((str(a), b, str(c), d) for a, b, c, d in want)


def test_tree_bounds_hold_and_prune():
    """No score passes its nodes' bounds, and a search visits a part of the leaves."""
    r = np.random.default_rng(3)
    lengths = r.integers(0, 12, 3000)
    codes = np.concatenate([np.sort(r.choice(80, n, replace=False)) for n in lengths]).astype(np.int64)
    tfs, m = r.integers(1, 6, len(codes)), r.integers(75, 300, 3000)
    tree = DocumentTree(lengths, codes, tfs, m, np.arange(3000), 80, leaf=16)
    terms, weights = np.array([3, 40, 70, 79]), np.array([100, 3000, 5000, 9000])
    full = np.zeros(80, np.int64)
    full[terms] = weights
    scores = np.zeros(3000, np.int64)
    np.add.at(scores, tree.owner, score_parts(full[tree.codes], tree.tfs, tree.m[tree.owner]))
    for node in range(len(tree.low)):
        top = score_parts(weights, tree.tf_max[node][terms].astype(np.int64), tree.m_min[node]).sum()
        assert top >= scores[tree.low[node] : tree.high[node]].max()
    assert sorted((-int(s), int(i)) for s, i in zip(scores, tree.ids) if s > 0)[:9] == tree.search(terms, weights, full, 9, [])
    leaves = sum(a == b for a, b in zip(tree.first, tree.last))
    assert leaves > 100 and len(tree.low) < 4 * 3000 / 16
    assert sum(b - a for a, b, x, y in zip(tree.low, tree.high, tree.first, tree.last) if x == y) == 3000


def test_rows(spark):
    docs = odd_rows()
    items = [(1, "one THE w5 w17 w5"), (1, "one THE w5 w17 w5"), (None, "naïve two"), (2, None), (3, ""), (4, "-- !"), (5, "absent")]
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    got = ranked_search(frame(spark, docs), asked, k=4)
    assert rows(got) == sorted((str(a), b, str(c), d) for a, b, c, d in brute(docs, items, 4))
    empty = frame(spark, docs).limit(0)
    assert ranked_search(empty, asked).count() == 0 and ranked_search(frame(spark, docs), asked.limit(0)).count() == 0
    assert ranked_search(frame(spark, [(1, None), (2, " ")]), asked).count() == 0
