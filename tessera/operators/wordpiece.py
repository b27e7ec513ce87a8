"""WordPiece segmentation with a given vocabulary.

A vocabulary is a table of pieces: as they stand at the start of a word, with ``##`` before them
inside one.  Nothing is trained here.  For a table of words each distinct word is segmented once, longest match first:
its substrings are joined with the pieces, the longest piece at each place is kept, and the word
is walked from its start.  A word that cannot be covered, or of more than ``max_chars``
characters, is one unknown piece, as published for the method.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import core
from tessera.operators.text import pieces_by_row, pieces_of_words, values_by_word
from tessera.session import cut_lineage

UNKNOWN = "[UNK]"
#: Most bytes of a vocabulary file, which is read on the driver.
MAX_FILE = 64 << 20
#: Most bytes of pieces that are sent to all tasks; a larger vocabulary is shuffled.
MAX_SENT = 8 << 20
#: Runs of letters, marks and digits; any other character that is no white space by itself.
WORD_RE = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s\p{Z}]"


def pieces_of_ranks(spark: SparkSession, path: str) -> DataFrame:
    """Pieces from a file of ``base64 rank`` lines whose tokens carry a space where a word starts:
    `` ab`` gives ``ab``, ``ab`` gives ``##ab``.  Tokens that are no UTF-8, or hold more white space, are no pieces.
    Raises on a file of more than ``MAX_FILE`` bytes."""
    if os.path.getsize(path) > MAX_FILE:
        raise ValueError(f"vocabulary of more than {MAX_FILE} bytes: {path}")
    found = []
    with open(path, "rb") as lines:
        for line in lines:
            try:
                token = base64.b64decode(line.split()[0]).decode("utf-8")
            except (UnicodeDecodeError, IndexError):
                continue
            bare = token[1:] if token.startswith(" ") else token
            if bare and not any(c.isspace() for c in bare):
                found.append(bare if bare is not token else "##" + bare)
    return spark.createDataFrame(pd.DataFrame({"piece": sorted(set(found))}), "piece string")


def wordpiece_words(text: str | Column) -> Column:
    """Lower-cased words and single marks of a text, in order; null and empty texts have none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD_RE), 0)


def segment_words(words: DataFrame, pieces: DataFrame, word: str = "word", max_chars: int = 100) -> DataFrame:
    """(word, pieces): distinct non-null words with their pieces, longest match first.

    Repeated pieces count once; null or empty ones are left out; an empty vocabulary makes each word unknown.  The
    empty word has no pieces."""
    # written once, as two steps read them; a small table of words still makes many substrings
    own = core.spread(cut_lineage(words.select(F.col(word).alias("word")).where("word IS NOT NULL").distinct()))
    vocab = pieces.select("piece").where("piece IS NOT NULL AND piece <> ''").distinct()
    size = vocab.agg(F.coalesce(F.max(F.length("piece")), F.lit(0)).alias("m"), F.coalesce(F.sum(F.octet_length("piece")), F.lit(0)).alias("b")).first()
    longest = size["m"]
    # the substrings are many times the words that Spark sees in its estimates: never the side that is broadcast
    vocab = F.broadcast(vocab) if size["b"] <= MAX_SENT else vocab.hint("shuffle_hash")
    n = F.length("word")
    starts = own.where(n <= max_chars).select("word", F.explode(F.sequence(F.lit(1), n)).alias("s")).where("word <> ''")
    reach = F.least(n - F.col("s") + 1, F.lit(max(longest, 1)))
    spans = starts.select("word", "s", F.explode(F.sequence(F.lit(1), reach)).alias("len"))
    inside = F.when(F.col("s") > 1, F.lit("##")).otherwise(F.lit(""))
    spans = spans.withColumn("piece", F.concat(inside, F.substring("word", F.col("s"), F.col("len"))))
    # dealt by word, so that both groupings below need no other shuffle
    best = spans.join(vocab, "piece").select("word", "s", "len").repartition("word").groupBy("word", "s").agg(F.max("len").alias("len"))
    held = best.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("s", "len"))).alias("held"))

    def step(state: Column, at: Column) -> Column:
        here = F.element_at("held", at)
        piece = F.concat(F.when(at > 1, F.lit("##")).otherwise(F.lit("")), F.substring("word", at, here))
        # a place without a match leaves ``next`` there, so nothing after it is reached
        hit = (state["next"] == at) & here.isNotNull()
        return F.struct(F.when(hit, at + here).otherwise(state["next"]).alias("next"),
                        F.when(hit, F.concat(state["out"], F.array(piece))).otherwise(state["out"]).alias("out"))

    first = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("out"))
    walk = F.aggregate(F.sequence(F.lit(1), n), first, step)
    done = own.join(held, "word", "left").withColumn("walk", F.when(F.col("held").isNotNull(), walk))
    whole = F.coalesce(F.col("walk.next") == n + 1, F.lit(False))
    unknown = F.when(F.col("word") == "", F.array().cast("array<string>")).otherwise(F.array(F.lit(UNKNOWN)))
    return done.select("word", F.when(whole, F.col("walk.out")).otherwise(unknown).alias("pieces"))


def _sent(pieces: DataFrame) -> frozenset[str] | None:
    """The pieces, if they are few enough to send to all tasks."""
    vocab = pieces.select("piece").where("piece IS NOT NULL AND piece <> ''").distinct()
    size = vocab.agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0)).alias("b")).first()["b"]
    return frozenset(r["piece"] for r in vocab.collect()) if size <= MAX_SENT else None


def _longest_first(held: frozenset[str], max_chars: int) -> Callable[[str], list[str]]:
    reach = max(map(len, held), default=0)

    def of_word(word: str) -> list[str]:
        if len(word) > max_chars:
            return [UNKNOWN]
        out, at = [], 0
        while at < len(word):
            inside = "##" if at else ""
            end = next((e for e in range(min(len(word), at + reach), at, -1) if inside + word[at:e] in held), None)
            if end is None:
                return [UNKNOWN]
            out.append(inside + word[at:end])
            at = end
        return out

    return of_word


def wordpiece_in_place(text_col: str, pieces: DataFrame, max_chars: int = 100) -> Column | None:
    """The pieces of a text, without a join; None if they are too many to send to all tasks."""
    held = _sent(pieces)
    return None if held is None else pieces_of_words(wordpiece_words(text_col), _longest_first(held, max_chars))


def wordpiece_tokens(df: DataFrame, key: str, text_col: str, pieces: DataFrame, max_chars: int = 100) -> DataFrame:
    """(key, pieces) of each text in order, whole; ``key`` names a row.  Null and empty texts have
    an empty array.

    Up to ``MAX_SENT`` bytes of pieces are sent to all tasks, which segment the words of a text in
    place.  A larger vocabulary, and texts that share a key, take the joins: words are segmented
    once, then joined to the texts that hold them."""
    words = df.select(key, wordpiece_words(text_col).alias("__words"))

    def table(found: DataFrame) -> DataFrame:
        return segment_words(found, pieces, max_chars=max_chars)

    held = _sent(pieces)
    if held is not None:
        return pieces_by_row(words, key, "__words", _longest_first(held, max_chars), table)
    found = values_by_word(words, key, "__words", table(words.select(F.explode("__words").alias("word"))), "pieces")
    return found.select(key, F.flatten("pieces").alias("pieces"))
