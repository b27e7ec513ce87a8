"""Learned synonyms (G08) against a plain loop over all words, and on odd rows."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.operators import augment as G
from tessera.operators import synonyms as S

TEXTS = ["The red cat drinks milk daily", "a red dog drinks milk daily", "red cat chases mice", "red dog chases mice",
         "Blue ships sail far seas", "blue boats sail far seas", "Cat cat cat", "", None, "  ", "42 !!", "milk", "red cat drinks milk daily"]


def brute(texts, window, least, k):
    n = Counter()
    for t in texts:
        w = [x.lower() for x in re.findall(r"\w+(?:'\w+)?|[^\w\s]", t or "") if re.fullmatch(r"[^\W\d_]+", x)]
        w = [x for x in w if x not in set(S.D.STOPWORDS_EN)]
        for i in range(len(w)):
            for j in range(max(0, i - window), min(len(w), i + window + 1)):
                if w[i] != w[j]:
                    n[w[i], w[j]] += 1
    own = Counter()
    for (a, _), c in n.items():
        own[a] += c
    total = sum(own.values())
    vec = defaultdict(dict)
    for (a, b), c in n.items():
        if c >= least and (x := math.log(c * total / (own[a] * own[b]))) > 0:
            vec[a][b] = x
    out = {}
    for a in vec:
        def cos(b):
            return round(sum(x * vec[b].get(c, 0) for c, x in vec[a].items())
                         / math.hypot(*vec[a].values()) / math.hypot(*vec[b].values()), 9)
        best = sorted(((-cos(b), b) for b in vec if b != a and cos(b) > 0))[:k]
        out[a] = [(b, -c) for c, b in best]
    return {a: b for a, b in out.items() if b}


def _docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("word", F.lit("clash"))


def test_candidates_equal_brute_force(spark):
    docs = _docs(spark, TEXTS * 2)
    asked = S.cooccurrences(docs, "text").select("word").unionByName(spark.createDataFrame([("nowhere",), (None,)], "word string"))
    for window, least in ((2, 2), (3, 1)):
        got = defaultdict(list)
        for r in S.synonym_candidates(docs, "text", asked, window, least, 3).orderBy("word", "rank").collect():
            got[r["word"]].append((r["synonym"], r["cosine"]))
        want = brute(TEXTS * 2, window, least, 3)
        assert got.keys() == want.keys()
        for word, best in want.items():
            assert [s for s, _ in got[word]] == [s for s, _ in best]
            assert all(abs(a - b) < 1e-8 for (_, a), (_, b) in zip(got[word], best, strict=True))
        assert {got["cat"][0][0], got["ships"][0][0]} == {"dog", "boats"}


def test_empty_corpus(spark):
    docs = _docs(spark, ["", None, "the"])
    assert S.synonym_candidates(docs, "text", docs.select("word")).count() == 0
    assert S.synonym_candidates(docs.where("false"), "text", docs.select("word")).count() == 0


def test_table_gives_what_a_mapping_gives(spark):
    docs = _docs(spark, TEXTS)
    mapping = {"cat": ["dog", "cat", "fox"], "milk": ["cream"], "sail": ["sail"]}
    rows = [(w, s, i + 1) for w, many in mapping.items() for i, s in enumerate(many)]
    learned = spark.createDataFrame(rows, "word string, synonym string, rank int")
    a, b = (G.synonym_replace(docs, "doc_id", "text", 0.9, s).orderBy("doc_id").collect() for s in (mapping, learned))
    assert a == b and any("dog" in r["text_augmented"] or "cream" in r["text_augmented"] for r in a)
    none = G.synonym_replace(docs, "doc_id", "text", 1.0, learned.where("false")).select("text_augmented")
    assert none.count() == len(TEXTS)


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    """Words and words looked for in many blocks, with steps of few products; no pair of them is shuffled."""
    vectors = spark.createDataFrame([(f"w{i}", f"c{(i * j) % 13}", 1.0 + (i + j) % 4) for i in range(40) for j in range(1, 6)], "word string, context string, weight double").dropDuplicates(["word", "context"])
    asked = vectors.select("word").where("word < 'w2'")
    rows = vectors.collect()
    vec = defaultdict(dict)
    for r in rows:
        vec[r["word"]][r["context"]] = r["weight"]
    want = set()
    for a in {r["word"] for r in asked.collect()}:
        cos = {b: round(sum(x * vec[b].get(c, 0) for c, x in vec[a].items()) / math.hypot(*vec[a].values()) / math.hypot(*vec[b].values()), 9) for b in vec if b != a}
        want |= {(a, b, n + 1) for n, (c, b) in enumerate(sorted((-c, b) for b, c in cos.items() if c > 0)[:4])}
    for cells, step in ((1 << 20, 1 << 21), (30, 7)):
        monkeypatch.setattr(S, "WORD_CELLS", cells)
        monkeypatch.setattr(S, "ASKED_CELLS", cells)
        monkeypatch.setattr(S, "STEP", step)
        got = S.nearest_words(vectors, asked, 4)
        assert {(r["word"], r["synonym"], r["rank"]) for r in got.collect()} == want
    assert "FlatMapCoGroupsInPandas" in got._jdf.queryExecution().executedPlan().toString()
