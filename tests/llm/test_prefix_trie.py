"""Prefix trie and tree contraction against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm.common import table
from tessera.llm.contraction import subtree_totals
from tessera.llm.prefix_trie import conversation_trie
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows, rebuilt=True):
    """``rows``: (conv, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(x[2], x[4]) for x in sorted(turns)] for c, turns in own.items()}
    if rebuilt:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        own = {c: own.get(c - c % 100, [])[: h[c]] + turns[h[c] :] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in sorted(own.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op11_prefix_trie"](spark, SF)) == brute(rows)


SCHEMA = "conv_id long, turn long, role string, text string, depth string, id string, `range` string, n_convs string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


@pytest.mark.parametrize("rebuilt", [True, False])
def test_odd_rows(spark, rebuilt):
    r = random.Random(4)
    rows = [(c, t, r.choice(("user", "bot", None)), r.choice(("a", "b", "é中", None, ""))) for c in [*range(0, 40), *range(100, 130), 205, 1200, 1201] for t in range(r.randint(1, 7))]
    rows += [(7, None, "user", "x"), (7, None, "bot", "y"), (8, 1, "user", "x"), (8, 1, "user", "x"), (None, 1, "user", "a"), (None, None, None, None), (-5, 3, "user", "long " * 9000), (300, None, None, None)]
    rows += [(1300, t, "user", "ab"[t % 2]) for t in range(150)] + [(c, 0, "user", "same") for c in range(2000, 2300)]
    r.shuffle(rows)
    df = conversations(spark, rows).repartition(5)
    if rebuilt:  # remainders of negative numbers differ between languages
        rows, df = [x for x in rows if x[0] is None or x[0] >= 0], df.where("conv_id IS NULL OR conv_id >= 0")
    assert result(conversation_trie(df, rebuilt=rebuilt)) == brute(rows, rebuilt)


def test_empty(spark):
    assert conversation_trie(conversations(spark, []), rebuilt=True).count() == 0
    assert conversation_trie(conversations(spark, [(None, 1, "a", "b")])).count() == 0


def test_contraction(spark):
    """Random forests, a long chain, a star and a comb."""
    r = random.Random(8)
    parent = {0: None, 1: None}
    for k in range(2, 300):
        parent[k] = r.randrange(max(0, k - r.choice((1, 1, 3, 200))), k)
    parent |= {1000 + k: 999 + k if k else 0 for k in range(260)}  # chain
    parent |= {2000 + k: 5 for k in range(200)}  # star
    for k in range(60):  # comb
        parent[3000 + k] = 2999 + k if k else 7
        parent[4000 + k] = 3000 + k
    rows = [(i, p, i % 7, 1) for i, p in parent.items()]
    want = {i: [0, 0] for i in parent}
    for i, _, v, one in rows:
        at = i
        while at is not None:
            want[at][0] += v
            want[at][1] += one
            at = parent[at]
    got = subtree_totals(spark.createDataFrame(rows, "id long, parent long, v long, one long"), ["v", "one"]).collect()
    assert len(got) == len(want) and {r["id"]: [r["v"], r["one"]] for r in got} == want
    assert subtree_totals(spark.createDataFrame([], "id long, parent long, v long"), ["v"]).count() == 0
    with pytest.raises(ValueError):
        subtree_totals(spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "id long, parent long, v long"), ["v"])
