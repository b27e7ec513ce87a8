"""Steps that stay with the row they are about, and those that shuffle once."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import augment as G
from tessera.operators import language as L
from tessera.operators import subword, wordpiece
from tessera.operators import text as X

TEXTS = {1: "Unaffable AB! ab", 2: None, 3: "", 4: "ab " * 30 + "zz", 5: "Été à la mer, l'été", None: "ab ab"}
PIECES = ["un", "##aff", "##able", "ab", "##b", "a", "!"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark, twice: bool = False):
    rows = [*TEXTS.items(), *([(1, "ab zz"), (5, "mer")] if twice else [])]
    return spark.createDataFrame(rows, "doc_id long, text string")


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


@pytest.mark.parametrize("twice", [False, True])
def test_wordpiece_in_place_equals_the_join(spark, monkeypatch, twice):
    pieces, d = spark.createDataFrame([(p,) for p in PIECES], "piece string"), docs(spark, twice)

    def counted():
        return {r["doc_id"]: sorted(r["pieces"]) for r in wordpiece.wordpiece_tokens(d, "doc_id", "text", pieces).collect()}

    def stats():
        return rows(X.tokenization_stats(d, "text", "doc_id", pieces), "method", "min_tokens", "max_tokens", "total_tokens")

    near, near_stats = counted(), stats()
    if not twice:
        assert "Exchange" not in plan(wordpiece.wordpiece_tokens(d, "doc_id", "text", pieces))
    monkeypatch.setattr(wordpiece, "MAX_SENT", 0)
    assert near == counted() and near_stats == stats()
    assert near[1][-1] == "un" and near[None] == near[3] == []


@pytest.mark.parametrize("twice", [False, True])
def test_bpe_in_place_equals_the_join(spark, twice):
    d, merges = docs(spark, twice), [("a", "b"), ("ab", subword.END), ("z", "z")]
    got = subword.subword_tokens(d, "doc_id", "text", merges)
    words = d.select("doc_id", X.T.tokenize_words(F.lower(F.coalesce("text", F.lit("")))).alias("w"))
    joined = X.values_by_word(words, "doc_id", "w", subword.segment_vocabulary(words.select(F.explode("w").alias("word")), merges), "pieces")
    want = joined.select("doc_id", F.sort_array(F.flatten("pieces")).alias("pieces"))
    assert rows(got.select("doc_id", F.sort_array("pieces").alias("pieces")), "doc_id", "pieces") == rows(want, "doc_id", "pieces")
    if not twice:
        assert "Exchange" not in plan(got) and "BroadcastExchange" not in plan(joined)


@pytest.mark.parametrize("twice", [False, True])
def test_own_ngrams_equal_the_ranked_ones(spark, twice):
    d = docs(spark, twice).withColumn("lang", F.lit("x"))
    profiles = L.learn_profiles(d.where("doc_id <> 4"), "lang", "text", top=40)
    got = L.detect_by_profiles(d, "doc_id", "text", profiles, top=5)
    own = L.ranked_ngrams(d, "doc_id", "text", top=5)
    most = own.groupBy("doc_id").agg((F.count("*") * 5).alias("most"))
    saved = own.join(profiles.withColumnRenamed("rank", "r"), "gram").groupBy("doc_id").agg(F.sum(5 - F.abs(F.col("rank") - F.col("r"))).alias("s"))
    want = d.join(saved.join(most, "doc_id"), "doc_id", "left").select("doc_id", (F.col("most") - F.col("s")).alias("out_of_place"))
    assert rows(got, "doc_id", "out_of_place") == rows(want, "doc_id", "out_of_place")
    if not twice:  # only sums of a text and language are shuffled, and the rows
        assert not re.search(r"Exchange hashpartitioning\(doc_id[^,]*, (w|gram)#", plan(got))


def test_masked_words_are_found_once_a_row(spark):
    d = spark.createDataFrame([(i, f"the {w} cat sat on a mat .") for i, w in enumerate(["red", "red", "big", "big"])], "k long, text string")
    got = G.masked_word_replace(d, "k", "text", 5)
    assert len({r["text_augmented"] for r in got.collect()}) >= 2
    assert not [x for x in plan(got).splitlines() if "Filter" in x and "regexp_extract_all" in x]


def test_contexts_are_shuffled_once(spark):
    d = spark.createDataFrame([("a b c",), ("a b c",), ("a d c",), ("a 1 c",), (None,)], "text string")
    got = G.context_candidates(d, "text", 1)
    assert plan(got).count("Exchange hashpartitioning") == 1
    assert got.columns == ["left", "right", "word", "count", "rank"] and [tuple(r) for r in got.collect()] == [("a", "c", "b", 2, 1)]


@pytest.mark.parametrize("most", [None, 4])
@pytest.mark.parametrize("twice", [False, True])
def test_tfidf_counts_in_place(spark, most, twice):
    d = docs(spark, twice).unionByName(spark.createDataFrame([(7, "ab ab mer zz"), (None, "ab zz zz")], "doc_id long, text string"))
    got = X.tfidf_long(d, "doc_id", "text", (1, 2), 2, 1.0, most)
    # the same by one row a term: rows that share a key, null too, are one text
    toks = F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?U)\w\w+"), 0), lambda t: ~t.isin(*X.D.STOPWORDS_EN))
    base = d.select("doc_id", toks.alias("t")).select("doc_id", F.explode(F.concat("t", X.T.safe_ngrams("t", 2))).alias("term"))
    tf = base.groupBy("doc_id", "term").count().collect()
    df, cf = {}, {}
    for r in tf:
        df[r["term"]], cf[r["term"]] = df.get(r["term"], 0) + 1, cf.get(r["term"], 0) + r["count"]
    n = d.count()
    kept = sorted((t for t in df if 2 <= df[t] <= n), key=lambda t: (-cf[t], t))[:most]
    w = {(r["doc_id"], r["term"]): r["count"] * (math.log((n + 1) / (df[r["term"]] + 1)) + 1) for r in tf if r["term"] in kept}
    norm = {k: math.sqrt(sum(x * x for (j, _), x in w.items() if j == k)) for k, _ in w}
    assert {(r["doc_id"], r["term"]): round(r["tfidf"], 9) for r in got.collect()} == {k: round(x / norm[k[0]], 9) for k, x in w.items()}
    if not twice and most:  # sums of a term and the kept cells, not a row for each text and term
        own = plan(X.tfidf_long(docs(spark).where("doc_id IS NOT NULL"), "doc_id", "text", (1, 2), 2, 1.0, most))
        assert not re.search(r"Exchange hashpartitioning\(doc_id#\d+L, term#", own)
