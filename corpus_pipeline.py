"""Pipeline from raw documents to token ids.

Quality classifier, near-duplicate join, removal of repeated byte strings, benchmark
decontamination, byte-level BPE.  Each stage works on all that the one before it kept, is
written as Parquet in the shared folder and read again by the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import bpe_encode
from tessera.llm.common import table, write_cut
from tessera.llm.decontaminate import find_contamination
from tessera.llm.jaccard_join import keep_one
from tessera.llm.quality import fit_quality, score_quality
from tessera.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes when benchmark windows cover more than this share of its words.
MAX_COVERAGE = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects (score under 0.3) go."""
    machine = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, machine, keep=COLUMNS).where("score >= 0.3").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, linked by a Jaccard similarity of 0.8 of 5-word shingles."""
    return keep_one(docs.select(*COLUMNS), percent=80, size=5)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that also start elsewhere are cut out of all documents; a document of
    which nothing is left goes."""
    done = remove_repeats(docs, length=400, keep=("lang", "source")).where("n_removed = 0 OR kept_text <> ''")
    return done.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is little else goes."""
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), cleaned=True, keep=("lang", "source"))
    n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + (s["end"] - s["start"]))
    kept = found.where(n_hit <= F.lit(MAX_COVERAGE) * F.col("n_words"))
    return kept.select("doc_id", F.col("cleaned").alias("text"), "lang", "source", F.char_length("cleaned").cast("long").alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (binary, little-endian unsigned 32-bit integers), with digests of ids and decoded bytes."""
    ids = bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return ids.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("decontaminated", decontaminated), ("tokens", tokens)]

#: Neither the classifier nor the tokenizer can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_cut(stage(spark, docs, sf_dir), name)
    return docs
