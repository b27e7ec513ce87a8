"""Queries ``opN_<name>``: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.ball_tree import top_k
from tessera.llm.bpe import bpe_encode
from tessera.llm.chaining import shared_passages
from tessera.llm.common import table
from tessera.llm.decontaminate import find_contamination
from tessera.llm.fp_tree import ranked_search
from tessera.llm.html_text import extract_text
from tessera.llm.jaccard_join import jaccard_components
from tessera.llm.labelled import fold
from tessera.llm.pieces import piece_encode
from tessera.llm.prefix_trie import conversation_trie
from tessera.llm.quality import fit_quality, score_quality
from tessera.llm.shard import shard_by_size
from tessera.llm.suffix_dedup import remove_repeats
from tessera.llm.toxicity import fit_toxicity, score_toxicity


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op4_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=20, scale=64, query_every=20)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"), length=400)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("repeated"))


def op6_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_size(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op8_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shared_passages(table(spark, sf_dir, "documents"), least=50)
    return found.withColumn("n_passages", F.size("passages").cast("long")).drop("passages")


def op9_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "severity", "grade", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), percent=90, size=3)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), rebuilt=True)


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = piece_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return ids.select("doc_id", "n_tokens", F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_fp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


QUERIES = {
    "op1_quality_fm": op1_quality_fm,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_decontaminate": op3_decontaminate,
    "op4_ball_tree": op4_ball_tree,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_shard_bytes": op6_shard_bytes,
    "op7_html_text": op7_html_text,
    "op8_collinear_chains": op8_collinear_chains,
    "op9_toxicity_ordinal": op9_toxicity_ordinal,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_sentence_pieces": op12_sentence_pieces,
    "op13_fp_tree": op13_fp_tree,
}

ORACLES: dict[str, str] = {
    "op4_ball_tree": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op11_prefix_trie": """
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 100 AS base,
         xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 6 AS h
  FROM (SELECT DISTINCT c FROM own)),
rebuilt AS (
  SELECT k.c, 0 AS part, o.p, o.role, o.text FROM convs k JOIN own o ON o.c = k.base AND o.p <= k.h
  UNION ALL
  SELECT k.c, 1, o.p, o.role, o.text FROM convs k JOIN own o ON o.c = k.c AND o.p > k.h),
prefixes AS (
  SELECT c, length(text) AS size, count(*) OVER w AS depth, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS prefix, count(*) OVER (PARTITION BY c) AS n
  FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, p ROWS UNBOUNDED PRECEDING)),
members AS (
  SELECT c, size, depth, prefix, depth = n AS last FROM prefixes
  UNION ALL
  SELECT c, 0, 0, '', c NOT IN (SELECT c FROM rebuilt) FROM convs),
nodes AS (
  SELECT prefix, min(c) AS conv_id, min(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * min(size) AS saved,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256
  FROM members GROUP BY prefix),
kids AS (SELECT left(prefix, 32 * (depth - 1)) AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
ways AS (SELECT left(prefix, 32 * d) AS top, prefix, saved FROM (SELECT *, unnest(range(depth + 1)) AS d FROM nodes)),
totals AS (
  SELECT top AS prefix, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE prefix NOT IN (SELECT prefix FROM kids)) AS n_leaves
  FROM ways GROUP BY top)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
FROM nodes n JOIN totals t ON t.prefix = n.prefix LEFT JOIN kids k ON k.prefix = n.prefix
LEFT JOIN nodes u ON n.depth > 0 AND u.prefix = left(n.prefix, 32 * (n.depth - 1))
""",
    "op13_fp_tree": r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM documents),
asked AS (
  SELECT item_id, t, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
  GROUP BY item_id, t),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
tfs AS (SELECT doc_id, t, count(*) AS tf FROM words WHERE t IN (SELECT t FROM asked) GROUP BY doc_id, t),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, whole GROUP BY t, docs),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM tfs JOIN asked USING (t) JOIN weights USING (t) JOIN sizes USING (doc_id), whole
  GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
""",
}
