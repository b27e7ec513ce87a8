"""What grows with the input: rows held by Python, shuffles that lie on disk together, copies of a table."""

from __future__ import annotations

import os
import re

from pyspark.sql import functions as F

import numpy as np
import pytest

from tessera import core, session
from tessera.operators import ml
from tessera.operators import synonyms as S
from tessera.operators import text as X


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_term_counts_stay_in_the_jvm(spark):
    """a batch of texts, thousands of rows, was held with all its terms by a Python worker."""
    rows = [(1, ["b", "a", "b", "a a"]), (2, []), (3, None), (4, ["z"]), (None, ["a", "a", None, None])]
    d = spark.createDataFrame(rows, "k long, terms array<string>")
    got = X.row_term_counts(d, "terms", "k")
    assert not re.search("Python|Pandas", plan(got)) and got.schema["tf"].dataType.simpleString() == "bigint"
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "a", 1), (1, "a a", 1), (1, "b", 2), (4, "z", 1), (None, None, 2), (None, "a", 2)], key=str)


def test_terms_of_a_text_are_made_once(spark):
    """A test of the counted array that Spark adds would make it anew for each of its elements."""
    d = spark.createDataFrame([(1, "ab cd ab")], "k long, text string")
    got = X.row_term_counts(d.select("k", F.split("text", " ").alias("t")), "t", "k")
    assert {tuple(r) for r in got.collect()} == {(1, "ab", 2), (1, "cd", 1)}
    assert plan(got).count("sort_array") == 1


def test_tfidf_has_one_shuffle_of_counts_at_a_time(spark, monkeypatch):
    """F8: all n-grams' counts lay on disk by term, and again by text."""
    cut = []
    monkeypatch.setattr(X, "cut_lineage", lambda df: cut.append(plan(df)) or session.cut_lineage(df))
    d = spark.createDataFrame([(i, f"ab cd ef{i % 2} gh") for i in range(6)], "doc_id long, text string")
    got = X.tfidf_long(d, "doc_id", "text", (1, 2), 2, 1.0)
    assert len(cut) == 2 and not any("hashpartitioning(doc_id" in p for p in cut)
    assert "hashpartitioning(term" not in plan(got) and plan(got).count("Exchange hashpartitioning(doc_id") == 1
    assert {r["term"] for r in got.collect()} == {"ab", "cd", "ef0", "ef1", "gh", "ab cd", "cd ef0", "cd ef1", "ef0 gh", "ef1 gh"}


def test_a_written_table_leaves_no_shuffle(spark):
    """Shuffles of steps that had been written stayed until the driver collected garbage."""
    before = spark.conf.get(session.CLEANUP, None)
    t = session.cut_lineage(spark.range(1000).repartition(7, "id"))
    assert spark.conf.get(session.CLEANUP, None) == before and t.count() == 1000
    path = re.sub("^file:", "", t.cut_path)
    assert os.path.isdir(path)
    session.release(t)
    assert not os.path.exists(path)


def test_words_looked_for_are_sent_group_by_group(spark, monkeypatch):
    """each block of words had all vectors looked for at once, a cell a row, so shuffles grew with the square."""
    cut = []
    monkeypatch.setattr(S, "cut_lineage", lambda df: cut.append((plan(df), t := session.cut_lineage(df))) or t)
    docs = spark.createDataFrame([(" ".join("abcdefg"[i % n] * 3 for n in (7, 5, 3)),) for i in range(60)], "text string")
    asked = spark.createDataFrame([(x * 3,) for x in "abcdefg"], "word string")
    whole = sorted(map(tuple, S.synonym_candidates(docs, "text", asked).collect()))
    assert whole and not [p for p, _ in cut if "FlatMapCoGroupsInPandas" in p]
    cut.clear()
    monkeypatch.setattr(S, "ASKED_CELLS", 8)
    got = S.synonym_candidates(docs, "text", asked)
    assert len([p for p, _ in cut if "FlatMapCoGroupsInPandas" in p]) > 1  # written before the next is sent
    assert sorted(map(tuple, got.collect())) == whole


def test_rare_pairs_are_not_written(spark, monkeypatch):
    """all pair counts were written, in both directions."""
    first = []
    monkeypatch.setattr(S, "cut_lineage", lambda df: (t := session.cut_lineage(df), first or first.extend(t.collect()))[0])
    docs = spark.createDataFrame([("ape bear cow",), ("ape bear",), ("dog elk",)], "text string")
    S.synonym_candidates(docs, "text", docs.select(F.explode(F.split("text", " ")).alias("word")))
    assert {tuple(r) for r in first} == {("ape", "bear", 2), ("ape", None, 3), ("bear", None, 3), ("cow", None, 2), ("dog", None, 1), ("elk", None, 1)}


@pytest.mark.parametrize("cells", [1 << 21, 20])
def test_nmf_shuffles_no_cells_in_its_rounds(spark, monkeypatch, cells):
    """each update shuffled all cells of V; null keys, repeated cells and null values as before."""
    monkeypatch.setattr(ml, "NMF_CELLS", cells)
    cut = []
    monkeypatch.setattr(session, "cut_lineage", lambda df, f=session.cut_lineage: cut.append(plan(df)) or f(df))
    rows = [(d, f"t{(7 * d + j * j) % 30}", 1.0 + (d * j) % 5) for d in range(25) for j in range(8)]
    rows += [(None, "t1", 2.0), (None, "only", 1.0), (3, None, 1.0), (99, None, 2.0), (4, "t2", None)]
    v = spark.createDataFrame(rows, "d long, term string, tfidf double")
    k, iters = 3, 4
    got = {(r["topic"], r["term"]): r["weight"] for r in ml.topic_nmf(v, "d", k=k, iters=iters, words=100).collect()}
    u = lambda name, salt: {r[0]: np.array(r[1]) for r in v.select(name).distinct().select(
        name, F.array(*[core.hash_uniform(F.concat_ws(":", F.col(name).cast("string"), F.lit(str(t))), F.lit(salt)) + 0.01 for t in range(k)])).collect()}
    W, H = u("d", "nmf-w:42"), u("term", "nmf-h:42")

    def update(M, other, at):
        num = {n: np.zeros(k) for n in M}
        for r in rows:
            if r[at] is not None and r[1 - at] is not None:
                num[r[at]] += other[r[1 - at]] * (r[2] or 0.0)
        g = sum(np.outer(x, x) for n, x in other.items() if n is not None)
        return {n: x * num[n] / (g @ x + 1e-9) for n, x in M.items()}

    for _ in range(iters):
        H = update(H, W, 1)
        W = update(W, H, 0)
    want = {(t, n): x[t] for n, x in H.items() for t in range(k)}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 * max(1, want[x]) for x in got)
    rounds = cut[5:]  # what comes after the tables, documents, terms, blocks and the blocks' terms
    assert len(rounds) == 2 * iters + 1 and not any(re.search(r"Join.*\[(d|term)#", p) for p in rounds)
    assert all("InMemoryTableScan" in p for p in rounds[::2])


def test_lda_sums_a_matrix_for_each_core_at_most(spark, monkeypatch):
    """an iteration summed a matrix of all terms for each part of the input."""
    from pyspark.ml.clustering import LDA

    seen = []
    monkeypatch.setattr(LDA, "fit", lambda self, df, f=LDA.fit: seen.append((df.rdd.getNumPartitions(), df.count())) or f(self, df))
    d = spark.createDataFrame([(f"apple banana apple w{i % 3}",) for i in range(40)], "text string").repartition(23)
    assert len(ml.topic_lda(d, "text", k=2, words=3, max_iter=2).collect()) == 4
    assert seen[0][0] <= spark.sparkContext.defaultParallelism and seen[0][1] == 40
