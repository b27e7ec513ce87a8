"""Trie of the prefixes that conversations share, with totals of every subtree.

A conversation's turns are numbered, and each prefix gets a 128-bit key, the sum of a digest of
each turn and its place.  Both are running sums over ranges of rows, with an offset for each range,
so one conversation may hold most of all turns.  Rows with one key are a node.  Keys are verified:
all members of a node must have one parent key and one last turn, from which follows, depth by
depth, that they have one prefix; if any differ, all keys are made anew with another salt.
Totals of subtrees come from tree contraction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import release, write_cut
from tessera.llm.contraction import join_hot, subtree_totals

#: Conversation ids that travel together to be hashed.
CHUNK_IDS = 512


def running_sums(rows: DataFrame, key: str, order: list[str], sums: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with the sum of each expression over the key's earlier rows (the row itself not
    included) and a column ``range``.  A written table, which the caller releases; no task sees more
    than a range of rows, and a key has one row for each range that it lies in."""
    parts = [F.coalesce(expr, F.lit(0)).cast("long").alias(f"_{n}") for n, expr in sums.items()]
    dealt = write_cut(rows.select("*", *parts).repartitionByRange(key, *order).withColumn("range", F.spark_partition_id()), f"{name}-dealt")
    totals = dealt.groupBy(key, "range").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums])
    earlier = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "range", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}_before") for n in sums])
    inside = Window.partitionBy(key, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.join(offsets, [key, "range"]).select(*rows.columns, "range", *[(F.col(f"_{n}_before") + F.sum(f"_{n}").over(inside) - F.col(f"_{n}")).alias(n) for n in sums])
    out = write_cut(summed, name)
    release(dealt)
    return out


def numbered_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, digest, size, range): each conversation's turns in order, from 0, with a digest of
    role and text and the text's code points.  Null turns come first, equal turns in order of
    role and digest; null role and text are empty; rows without a conversation are left out."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"),
        F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.char_length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("place"),
    )
    turns = running_sums(rows, "conv", ["turn", "role", "digest", "place"], {"pos": F.lit(1)}, "turns")
    out = turns.select("conv", "pos", "digest", "size", "range")
    out.cut_path = turns.cut_path
    return out


def rebuilt_turns(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their ``every`` does: of conversation c, the first
    h = crc32(c) % ``most`` turns come from conversation c - c % ``every`` (all if it has fewer,
    none if there is none), then come c's own after its first h.  ``turns`` as ``numbered_turns``
    gives them.  Returns (conv, pos, digest, size, last) and (conv, n_turns) of all conversations.
    """
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    heads = turns.where((F.col("conv") % every == 0) & (F.col("pos") < most - 1)).groupBy(F.col("conv").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "size"))).alias("head"))  # fewer than ``most``
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    begun = sizes.withColumn("h", h.cast("int")).withColumn("base", F.col("conv") - F.col("conv") % every).join(heads, "base", "left")
    begun = begun.withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h"))).withColumn("b", F.size("head"))
    begun = write_cut(begun.select("conv", "h", "head", "b", (F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")), "begun")
    given = begun.select("conv", "n_turns", F.explode("head").alias("t")).select("conv", F.col("t.pos").alias("pos"), "t.digest", "t.size", "n_turns")
    # by conversation and range, as one conversation may have most turns
    spans = turns.groupBy("conv", "range").agg(F.lit(1)).join(begun.select("conv", "h", "b", "n_turns"), "conv").select("conv", "range", "h", "b", "n_turns")
    own = turns.join(spans, ["conv", "range"]).where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("b")).alias("pos"), "digest", "size", "n_turns")
    rows = given.unionByName(own).select("conv", "pos", "digest", "size", (F.col("pos") == F.col("n_turns") - 1).alias("last"))
    return rows, begun.select("conv", "n_turns")


def _key(sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", *sums).cast("binary")))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and conversation to chunks: (key, first id, the ids comma-joined)."""
    key, first, ids = None, None, []
    for batch in batches:
        out = []
        for k, c in zip(batch["key"].to_pylist(), batch["conv"].to_pylist()):
            if ids and (k != key or len(ids) == CHUNK_IDS):
                out.append((key, first, ",".join(ids)))
                ids = []
            if not ids:
                key, first = k, c
            ids.append(str(c))
        yield _chunk_rows(out)
    if ids:
        yield _chunk_rows([(key, first, ",".join(ids))])


def _chunk_rows(rows: list[tuple]) -> pa.RecordBatch:
    keys, firsts, chunks = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(firsts, pa.int64()), pa.array(chunks, pa.string())], names=["key", "first", "chunk"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by key and first id to the digest of all of a key's ids, as a stream."""
    key, state = None, None
    for batch in batches:
        out = []
        for k, chunk in zip(batch["key"].to_pylist(), batch["chunk"].to_pylist()):
            if state is None or k != key:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(chunk.encode())
            else:
                state.update(b"," + chunk.encode())
        yield _digest_rows(out)
    if state is not None:
        yield _digest_rows([(key, state.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    keys, digests = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "ends_sha256"])


def ids_digest(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256) of rows (key, conv): SHA-256 of each key's ids, ascending, comma-joined.
    Ids are joined to chunks within ranges of rows; a digest is one chain by its nature, so the
    chunks of a key, one row for 512 ids, pass through one task as a stream."""
    chunks = rows.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(_joined_ids, "key binary, first long, chunk string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of all prefixes.  ``turns`` holds conv, pos (from 0, gapless), digest, size
    and last, ``convs`` all conversations as conv and n_turns (0 for one without turns).

    Returns conv_id (the node's smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.  Conversations that repeat another are
    members of the same nodes.  Hot turns, prefixes and long conversations are split by ranges of
    rows or summed before shuffles.  An empty table gives an empty result.
    """
    root = _key([F.lit("0")] * 4)
    for salt in count():
        mixed = F.sha2(F.concat_ws(":", F.lit(str(salt)), "pos", "digest"), 256)
        parts = {f"s{i}": F.conv(F.substring(mixed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)}
        summed = running_sums(turns, "conv", ["pos"], parts, "sums")
        members = summed.select("conv", (F.col("pos") + 1).alias("depth"), "digest", "size", "last", _key([F.col(n) for n in parts]).alias("up"), _key([F.col(n) + p for n, p in parts.items()]).alias("key"))
        one = F.struct("up", "digest")
        grouped = members.groupBy("key").agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.min("size").alias("size"), F.min(one).alias("least"), F.max(one).alias("most"))
        top = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
        top = top.select(root.alias("key"), F.lit(None).cast("binary").alias("up"), "n_convs", "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("size"), F.lit(True).alias("sound"))
        nodes = grouped.select("key", F.col("least.up").alias("up"), "n_convs", "conv_id", "depth", "size", (F.col("least") == F.col("most")).alias("sound"))
        nodes = write_cut(nodes.unionByName(top), "nodes")
        if nodes.where("NOT sound").first() is None:
            break
        release(summed, nodes)
    ends = write_cut(ids_digest(members.where("last").select("key", "conv").unionAll(convs.where("n_turns = 0").select(root, "conv"))), "ends")
    kids = nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n_children"))
    numbered = nodes.join(kids, "key", "left").join(ends, "key", "left").select(
        F.monotonically_increasing_id().alias("id"), "key", "up", "conv_id", "depth", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
    numbered = write_cut(numbered, "numbered")
    release(summed, nodes, ends)
    above = numbered.select(F.col("key").alias("up"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    placed = join_hot(numbered.where("up IS NOT NULL"), above, "up").drop("up", "key")
    placed = write_cut(placed.unionByName(numbered.where("up IS NULL").drop("up", "key").withColumns({"parent": F.lit(None).cast("long"), "parent_conv_id": F.lit(None).cast("long")})), "placed")
    release(numbered)
    leaves = (F.col("n_children") == 0).cast("long").alias("n_leaves")
    totals = subtree_totals(placed.select("id", "parent", leaves, "saved_tokens"), ["n_leaves", "saved_tokens"])
    return placed.drop("saved_tokens").join(totals, "id").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rebuilt: bool = False) -> DataFrame:
    """The trie of the conversations of ``df``, or, with ``rebuilt``, of those that ``rebuilt_turns``
    makes of them; columns as ``prefix_trie`` gives them.

    Null turns come first and equal turns in order of role and text digest; null role and text are
    empty; rows without a conversation are left out; repeated rows are turns of their own; very
    long texts only meet a digest; an empty table gives an empty result; other columns are ignored.
    """
    turns = numbered_turns(df, conv_col, turn_col, role_col, text_col)
    if rebuilt:
        return prefix_trie(*rebuilt_turns(turns))
    convs = turns.groupBy("conv").agg(F.count("*").alias("n_turns"))
    # by conversation and range, as one conversation may have most turns
    spans = turns.groupBy("conv", "range").agg(F.lit(1)).join(convs, "conv").select("conv", "range", "n_turns")
    rows = turns.join(spans, ["conv", "range"]).select("conv", "pos", "digest", "size", (F.col("pos") == F.col("n_turns") - 1).alias("last"))
    return prefix_trie(rows, convs)
