"""WordPiece segmentation (X05) against a plain greedy loop, and words joined back to their rows."""

from __future__ import annotations

import base64

import pytest
from pyspark.sql import functions as F

from tessera.operators import wordpiece
from tessera.operators.text import values_by_word
from tessera.operators.wordpiece import UNKNOWN, pieces_of_ranks, segment_words, wordpiece_tokens

PIECES = ["un", "##aff", "##able", "##a", "##b", "a", "ab", "##abc", "##f", "é", "##é", "日", "##本", "##😀", "!", "x"]
WORDS = ["unaffable", "ababc", "abcab", "zz", "éé", "日本", "a😀", "!", "x" * 101, "ab" * 50, "", "unq"]


def greedy(word: str, pieces: set[str], max_chars: int = 100) -> list[str]:
    if len(word) > max_chars:
        return [UNKNOWN]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in pieces:
                break
        else:
            return [UNKNOWN]
        out.append(piece)
        at = end
    return out


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_longest_match_first(spark, monkeypatch, sent):
    monkeypatch.setattr(wordpiece, "MAX_SENT", sent)
    pieces = spark.createDataFrame([(p,) for p in [*PIECES, "a", "", None]], "piece string")
    words = spark.createDataFrame([(w,) for w in [*WORDS, "ab", "ab", None]], "word string")
    got = {r["word"]: r["pieces"] for r in segment_words(words, pieces).collect()}
    assert got == {w: greedy(w, set(PIECES)) for w in [*WORDS, "ab"]}


def test_empty_tables(spark):
    none, words = spark.createDataFrame([], "piece string"), spark.createDataFrame([("ab",), ("",)], "word string")
    assert {r["word"]: r["pieces"] for r in segment_words(words, none).collect()} == {"ab": [UNKNOWN], "": []}
    assert segment_words(words.where("false"), none).count() == 0


def test_texts_keep_order_and_rows(spark):
    pieces = spark.createDataFrame([(p,) for p in PIECES], "piece string")
    texts = {1: "Unaffable AB! ab", 2: None, 3: "", 4: " \n ", 5: "ab " * 3000 + "zz", 6: "ab"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("pieces", F.lit(1))
    got = {r["doc_id"]: r["pieces"] for r in wordpiece_tokens(docs, "doc_id", "text", pieces).collect()}
    assert got[1] == ["un", "##aff", "##able", "ab", "!", "ab"]
    assert got[2] == got[3] == got[4] == []
    assert got[5] == ["ab"] * 3000 + [UNKNOWN] and got[6] == ["ab"]


def test_pieces_of_ranks(spark, tmp_path):
    tokens = [b" un", b"aff", b" ", b"\xff", b" a b", b"\n", "é".encode(), b" aff"]
    path = tmp_path / "v.ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    assert {r["piece"] for r in pieces_of_ranks(spark, str(path)).collect()} == {"un", "##aff", "##é", "aff"}


@pytest.mark.parametrize("hot", [False, True])
def test_values_by_word(spark, hot):
    rows = [(i, ["w"] * 5 if hot else [f"w{i}", "q", f"w{i}"]) for i in range(200)] + [(200, []), (201, None)]
    df = spark.createDataFrame(rows, "k long, ws array<string>")
    values = spark.createDataFrame([("w", 7), *[(f"w{i}", i) for i in range(200)]], "word string, v int")
    got = {r["k"]: r["v"] for r in values_by_word(df, "k", "ws", values, "v").collect()}
    assert got == {i: ([7] * 5 if hot else [i, None, i]) for i in range(200)} | {200: [], 201: []}
