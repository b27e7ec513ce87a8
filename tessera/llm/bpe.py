"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Merges of one pre-token are driven by a queue with one bucket per merge rank.  A bucket holds
positions of the pre-token's linked list; a bitmap of three levels says which buckets have
entries, and find-first-set on its words gives the lowest rank in a constant number of steps.
Entries are never deleted when a neighbour's merge makes them out of date; they are skipped when
popped.  A pre-token of n bytes so costs O(n log n) at most (the log only orders positions of
equal rank), where the usual scan for the lowest pair costs O(n^2): long runs without white
space stay cheap.  Short pre-tokens that a worker has not seen yet share one queue, with array
operations on a whole bucket.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.llm.common import id_text

#: Pre-tokens and chunks whose ids a worker keeps; beyond that it begins anew.
CACHE_ENTRIES = 200_000
#: Longer pre-tokens go through a queue of their own and are not kept.
LONG_BYTES = 256
#: Characters that a worker encodes at once.
RUN_CHARS = 2_000_000

_ENCODERS: dict[tuple, "Encoder"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Bucket queue over ranks 0..n-1 with a three-level bitmap of 64-bit words."""

    def __init__(self, n: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((n >> 6) + 1)
        self.mid = [0] * ((n >> 12) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        else:
            heappush(bucket, position)

    def push_all(self, rank: int, positions: np.ndarray) -> None:
        """As ``push`` for many positions, to be taken out with ``pop_all``."""
        if rank in self.buckets:
            self.buckets[rank].append(positions)
        else:
            self.push(rank, positions)

    def _lowest(self) -> int:
        """The lowest rank that has entries, by find-first-set on each level; -1 if none has."""
        top = self.top
        if not top:
            return -1
        a = (top & -top).bit_length() - 1
        word = self.mid[a]
        b = (a << 6) + (word & -word).bit_length() - 1
        word = self.low[b]
        return (b << 6) + (word & -word).bit_length() - 1

    def _clear(self, rank: int) -> None:
        del self.buckets[rank]
        b, a = rank >> 6, rank >> 12
        self.low[b] ^= 1 << (rank & 63)
        if not self.low[b]:
            self.mid[a] ^= 1 << (b & 63)
            if not self.mid[a]:
                self.top ^= 1 << a

    def pop(self) -> tuple[int, int] | None:
        """The leftmost position of the lowest rank, or None."""
        rank = self._lowest()
        if rank < 0:
            return None
        position = heappop(bucket := self.buckets[rank])
        if not bucket:
            self._clear(rank)
        return rank, position

    def pop_all(self) -> tuple[int, np.ndarray] | None:
        """All positions of the lowest rank, or None."""
        rank = self._lowest()
        if rank < 0:
            return None
        positions = np.concatenate(self.buckets[rank])
        self._clear(rank)
        return rank, positions


class Encoder:
    """Encodes texts; pre-tokens and chunks seen before are looked up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        size = max(ranks.values(), default=-1) + 1
        self.queue = RankQueue(size)
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        # every way in which two tokens make a third: sorted (left, right) keys and the third's rank
        keys, made = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    made.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys = np.append(np.array(keys, dtype=np.int64)[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array(made, dtype=np.int64)[order], -1)
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair of ids makes, or -1; the id -1 stands for an end."""
        keys = (left << 32) | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token; made for long ones."""
        n, rank_of, push, pop = len(raw), self.ranks.get, self.queue.push, self.queue.pop
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1] * n
        for i in range(n - 1):
            r = rank_of(raw[i : i + 2])
            if r is not None:
                pair[i] = r
                push(r, i)
        while (found := pop()) is not None:
            rank, i = found
            if pair[i] != rank:  # out of date
                continue
            gone = after[i]
            j = after[i] = after[gone]
            pair[gone] = pair[i] = -1
            if j < n:
                before[j] = i
                r = rank_of(raw[i : after[j]])
                if r is not None:
                    pair[i] = r
                    push(r, i)
            h = before[i]
            if h >= 0:
                r = rank_of(raw[h:j])
                pair[h] = -1 if r is None else r
                if r is not None:
                    push(r, h)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[raw[i : after[i]]])
            i = after[i]
        return ids

    def merge_many(self, raws: list[bytes]) -> list[bytes]:
        """Ids (as bytes) of many short pre-tokens through one queue.  Their lists lie side by side
        in one array, with an end mark after each.  A rank is popped with its whole bucket, and in
        each pre-token only the leftmost position merges at once, so each sees its own pairs in the
        order in which it would see them alone."""
        size = np.array([len(r) for r in raws], dtype=np.int64)
        start = np.concatenate([[1], 1 + np.cumsum(size + 1)])  # slot 0 and each slot before a start: an end mark
        token = np.full(start[-1], -1, dtype=np.int64)
        owner = np.repeat(np.arange(len(raws) + 1), np.concatenate([[1], size + 1]))
        inner = np.ones(start[-1], dtype=bool)
        inner[start - 1] = False
        token[inner] = self.byte_ids[np.frombuffer(b"".join(raws), dtype=np.uint8)]
        after, before = np.arange(1, len(token) + 1), np.arange(-1, len(token) - 1)
        after[-1] = len(token) - 1
        before[0] = 0
        pair = np.full(len(token), -1, dtype=np.int64)
        pair[:-1] = self._ranks_of(token[:-1], token[1:])
        gone_slots = np.zeros(len(token), dtype=bool)
        queue = self.queue

        def push(slots: np.ndarray) -> None:
            ranks = pair[slots]
            slots, ranks = slots[ranks >= 0], ranks[ranks >= 0]
            if len(slots):
                order = np.argsort(ranks, kind="stable")
                slots, ranks = slots[order], ranks[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                for rank, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(slots, cuts), strict=True):
                    queue.push_all(rank, part)

        push(np.flatnonzero(pair >= 0))
        while (found := queue.pop_all()) is not None:
            rank, at = found
            at = np.sort(at[pair[at] == rank])  # out-of-date entries go
            if len(at) > 1:
                mine = owner[at]
                first = np.concatenate([[True], mine[1:] != mine[:-1]])
                if not first.all():
                    again = at[~first]
                    again = again[np.concatenate([[True], again[1:] != again[:-1]])]
                    at = at[first]
                    queue.push_all(rank, again)
            if not len(at):
                continue
            gone = after[at]
            right = after[gone]
            after[at] = right
            before[right] = at
            gone_slots[gone] = True
            pair[gone] = -1
            token[at] = rank
            left = before[at]
            pair[at] = self._ranks_of(token[at], token[right])
            pair[left] = self._ranks_of(token[left], token[at])
            push(np.concatenate([at, left]))
        keep = inner & ~gone_slots
        ids = token[keep].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(owner[keep], minlength=len(raws) + 1)[1:]).tolist()
        return [ids[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]

    def _learn(self, pieces: set[str]) -> None:
        raws, names = [], []
        for piece in pieces:
            raw = piece.encode("utf-8")
            rank = self.ranks.get(raw)
            if rank is not None:
                self.pieces[piece] = rank.to_bytes(4, "little")
            elif len(raw) > LONG_BYTES:
                self.pieces[piece] = np.array(self.merge(raw), dtype="<u4").tobytes()
            else:
                raws.append(raw)
                names.append(piece)
        if raws:
            self.pieces.update(zip(names, self.merge_many(raws), strict=True))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text.  Where no two white-space characters meet, a pre-token begins at each
        space: such a text is cut there and whole chunks are looked up; the pattern is applied to
        each chunk that is new, and to the whole of other texts."""
        if len(self.chunks) > CACHE_ENTRIES:
            self.chunks = {}
        if len(self.pieces) > CACHE_ENTRIES:
            self.pieces = {}
        plans = [tuple((cut := text.split(" "))[:1]) + (cut[1:],) for text in texts]
        new: set[str] = set()
        for _, rest in plans:
            new.update(rest)
        new.difference_update(self.chunks)
        odd = {chunk for chunk in new if not chunk or chunk[0].isspace() or chunk[-1].isspace()}
        new -= odd
        whole = [rest and (first[-1:].isspace() or not odd.isdisjoint(rest)) for first, rest in plans]
        plans = [(self.split(text), []) if w else (self.split(first), rest) for text, w, (first, rest) in zip(texts, whole, plans, strict=True)]
        parts = {chunk: self.split(" " + chunk) for chunk in new}
        wanted = {p for first, _ in plans for p in first}
        wanted.update(p for split in parts.values() for p in split)
        wanted.difference_update(self.pieces)
        self._learn(wanted)
        piece, chunk = self.pieces.__getitem__, self.chunks.__getitem__
        for name, split in parts.items():
            self.chunks[name] = b"".join(map(piece, split))
        out = [b"".join(map(piece, first)) + b"".join(map(chunk, rest)) for first, rest in plans]
        for name in wanted:  # long ones are not kept
            if len(name) > LONG_BYTES:
                del self.pieces[name]
        for name in new:
            if len(name) > LONG_BYTES:
                del self.chunks[name]
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """As ``encode_all``, in runs of a bounded number of characters."""
        out: list[bytes] = []
        run: list[str] = []
        size = 0
        for text in texts:
            run.append(text)
            size += len(text)
            if size >= RUN_CHARS:
                out += self.encode_all(run)
                run, size = [], 0
        return out + self.encode_all(run)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _encoder(key: tuple, ranks: dict[bytes, int], pattern: str) -> Encoder:
    """One encoder for each rank file and pattern in a worker, kept over its tasks."""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Encode every whole text; each match of ``pattern`` is merged by itself, with no special
    tokens.  Returns ``id_col``, ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit
    integers) and, with ``decoded``, ``decoded`` (binary, from the ids alone).

    The rank file has a fixed size (50,000 short tokens) and is broadcast.  Rows pass through one
    map without a shuffle, so hot sources or copies cost nothing extra.  Null and empty texts
    give no ids; each row is answered by itself, so repeated rows and ids give repeated results;
    an empty table gives an empty result; other columns are ignored.
    """
    sent = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    key = (ranks_path, pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(key, sent.value, pattern)
        for batch in batches:
            ids = enc.encode_batch(batch["text"].tolist())
            out = {id_col: batch["id"], "n_tokens": [len(x) >> 2 for x in ids], "ids": ids}
            if decoded:
                out["decoded"] = [enc.decode(x) for x in ids]
            yield pd.DataFrame(out)

    schema = f"`{id_col}` long, n_tokens long, ids binary" + ", decoded binary" * decoded
    return id_text(df, id_col, text_col).mapInPandas(run, schema)


def bpe_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of each row's ids (binary as ``bpe_encode`` gives; null: none)."""
    from pyspark.sql import functions as F

    sent = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    key = (ranks_path, pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(key, sent.value, pattern)
        for batch in batches:
            yield pd.DataFrame({id_col: batch["id"], "decoded": [enc.decode(x) for x in batch["ids"]]})

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))
    return rows.mapInPandas(run, f"`{id_col}` long, decoded binary")
