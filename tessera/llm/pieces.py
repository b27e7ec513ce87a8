"""SentencePiece (BPE) encoding and decoding with a table of distinct chunks.

White space becomes a marker, and a chunk is a run of markers with the characters up to the next
one.  Where no piece of the model has a marker behind another character, no merge can cross from
one chunk into the next, so a chunk's ids are the same wherever it stands.  A task takes its
documents in blocks and keeps a table of the distinct chunks that it has met; a block's new chunks
are segmented together, each once, with array operations, and each document's ids are then put
together from the table by the places of its chunks.

The table is a task's own, not one for the whole input: to bring ids from a table of all chunks
back to all places takes a shuffle of the places (see README for its figures), whereas here nothing
is shuffled and a frequent chunk costs a look-up.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_text

MARK = "▁"
#: Characters of a block of documents; a longer text is a block by itself.
BLOCK_CHARS = 2_000_000
#: Chunks in a task's table, after which it begins anew.
TABLE_CHUNKS = 400_000
#: Longer chunks are segmented one by one, and are not kept.
LONG_CHUNK = 64

codecs.register_error("piece_bytes", lambda e: ("�" * (e.end - e.start), e.end))


class PieceModel:
    """What encoding and decoding need of a model file, in a form that can be sent to tasks."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        if sp.normalize("  ﬁ  a ") != MARK * 3 + "ﬁ" + MARK * 2 + "a" + MARK:
            raise ValueError("only models without character normalisation, with a leading marker, are supported")
        special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("only models with byte fallback are supported")
        names = [sp.id_to_piece(i) for i in ids]
        self.pieces = {names[i]: (-sp.get_score(i), i) for i in ids if i not in special and not sp.is_byte(i)}
        # what an id stands for in a decoded text
        self.surface = [b"" if i in special else names[i].replace(MARK, " ").encode() for i in ids]
        for value, i in self.bytes.items():
            self.surface[i] = bytes([value])
        for i in special:
            if sp.is_unknown(i):
                self.surface[i] = " ⁇ ".encode()
        self.marked = [names[i].startswith(MARK) for i in ids]
        self.silent = [sp.is_control(i) for i in ids]
        # every way in which two pieces or characters make a third: sorted (left, right) keys, the
        # third's order of merging (scores descending; equal ones are told apart by place) and id
        self.n_ids = len(names)
        self.char_ids: dict[str, int] = {}
        for p in self.pieces:
            for c in p:
                self.char_ids.setdefault(c, self.pieces[c][1] if c in self.pieces else self.n_ids + 1 + len(self.char_ids))
        levels = {s: k for k, s in enumerate(sorted({s for s, _ in self.pieces.values()}))}
        id_of = lambda x: self.pieces[x][1] if x in self.pieces else self.char_ids[x] if len(x) == 1 else None
        made = []
        for p, (score, i) in self.pieces.items():
            for cut in range(1, len(p)):
                left, right = id_of(p[:cut]), id_of(p[cut:])
                if left is not None and right is not None:
                    made.append((left << 32 | right, levels[score], i))
        made.sort()
        ends = (np.iinfo(np.int64).max, 0, 0)
        self.pair_keys, self.pair_levels, self.pair_ids = (np.array(x, np.int64) for x in zip(*made, ends))
        crosses = any(a != MARK == b for p in self.pieces for a, b in zip(p, p[1:]))
        self.whole = crosses
        self.pattern = "(?s).+" if crosses else f"{MARK}+[^{MARK}]*"

    def mark(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def segment(self, chunk: str) -> list[int]:
        """Ids of a marked chunk: the adjacent pair that makes the piece of the highest score is
        merged first, of equal ones the leftmost; what is no piece becomes bytes."""
        n, find = len(chunk), self.pieces.get
        size, before, after = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(found[0], i, 2) for i in range(n - 1) if (found := find(chunk[i : i + 2]))]
        heapify(queue)
        while queue:
            _, i, length = heappop(queue)
            j = after[i] if size[i] else n
            if j >= n or size[i] + size[j] != length:  # out of date
                continue
            size[i], size[j] = length, 0
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := find(chunk[i : i + length + size[k]]):
                    heappush(queue, (found[0], i, length + size[k]))
            h = before[i]
            if h >= 0 and (found := find(chunk[h : i + length])):
                heappush(queue, (found[0], h, size[h] + length))
        ids: list[int] = []
        i = 0
        while i < n:
            piece = chunk[i : i + size[i]]
            found = find(piece)
            if found:
                ids.append(found[1])
            else:
                ids += [self.bytes[b] for b in piece.encode()]
            i = after[i]
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes are put together, and the leading marker goes."""
        first = next((k for k, i in enumerate(ids) if not self.silent[i]), None)
        raw = b"".join(map(self.surface.__getitem__, ids))
        return raw[first is not None and self.marked[ids[first]] :].decode("utf-8", "piece_bytes")


class ChunkTable:
    """Ids of the distinct chunks met so far.  A chunk's name is the chunk without its first marker."""

    def __init__(self, model: PieceModel):
        self.model, self.find = model, re.compile(model.pattern).findall
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def names(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.model.whole and "  " not in text and MARK not in text and text[0] != " ":
            return text.split(" ")
        return [c[1:] for c in self.find(self.model.mark(text))]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of merging and id of what each pair makes; order -1 where it makes no piece."""
        model = self.model
        keys = left << 32 | right
        at = np.searchsorted(model.pair_keys, keys)
        return np.where(model.pair_keys[at] == keys, model.pair_levels[at], -1), model.pair_ids[at]

    def _segmented(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of many short chunks.  All step at once: in each, the pair that is first in
        the order of merging, of equal ones the leftmost, becomes one symbol, until none is left."""
        model, none = self.model, np.iinfo(np.int64).max
        text = "".join(chunks)
        unknown = model.n_ids  # stands for characters that are in no piece
        token = np.fromiter((model.char_ids.get(c, unknown) for c in text), np.int64, len(text))
        length = np.fromiter(map(len, chunks), np.int64, len(chunks))
        owner = np.repeat(np.arange(len(chunks)), length)
        place = np.arange(len(text))
        level, makes = np.full(len(text), none), np.zeros(len(text), np.int64)

        def look(left: np.ndarray) -> None:
            """Look up the pairs that begin at these symbols."""
            left = left[left + 1 < len(token)]
            level[left] = none
            left = left[owner[left] == owner[left + 1]]
            order, ids = self._pairs(token[left], token[left + 1])
            level[left], makes[left] = np.where(order < 0, none, order), ids

        look(np.arange(len(token)))
        done = []
        while len(token):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.repeat(np.minimum.reduceat(level, first), np.diff(np.append(first, len(owner))))
            open_ = least < none
            done.append((owner[~open_], place[~open_], token[~open_]))
            owner, place, token, level, makes, least = (x[open_] for x in (owner, place, token, level, makes, least))
            at = np.flatnonzero(level == least)
            at = at[np.concatenate([[True], owner[at][1:] != owner[at][:-1]])] if len(at) else at
            token[at] = makes[at]
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            owner, place, token, level, makes = (x[keep] for x in (owner, place, token, level, makes))
            level[at] = none
            before = at[at > 0] - 1
            look(np.concatenate([at, before[owner[before] == owner[before + 1]]]) if len(at) else at)
        owner, place, token = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place)
        owner, place, token = owner[order], place[order], token[order]
        odd = np.flatnonzero(token >= model.n_ids)  # no pieces: bytes instead
        if len(odd):
            raw = [[model.bytes[b] for b in text[p].encode()] for p in place[odd].tolist()]
            times = np.ones(len(token), np.int64)
            times[odd] = [len(r) for r in raw]
            starts = np.cumsum(times) - times
            owner, token = np.repeat(owner, times), np.repeat(token, times)
            for p, r in zip(starts[odd].tolist(), raw):
                token[p : p + len(r)] = r
        return np.bincount(owner, minlength=len(chunks)), token.astype(np.int32)

    def _learn(self, names: list[str]) -> None:
        size, ids = self._segmented([MARK + n for n in names]) if names else (self.size[:0], self.ids[:0])
        for name in names:
            self.at[name] = len(self.at)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the cuts between texts."""
        if len(self.at) > TABLE_CHUNKS:
            self._clear()
        named = [self.names(t) for t in texts]
        new = dict.fromkeys(n for names in named for n in names if n not in self.at)
        long = [n for n in new if len(n) > LONG_CHUNK]
        self._learn([n for n in new if len(n) <= LONG_CHUNK])
        kept = (len(self.at), len(self.ids))
        if long:
            found = [self.model.segment(MARK + n) for n in long]
            self.at.update(zip(long, range(len(self.at), len(self.at) + len(long))))
            size = np.array([len(f) for f in found], np.int64)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, *(np.array(f, np.int32) for f in found)])
        at = self.at.__getitem__
        counts = np.array([len(names) for names in named], np.int64)
        places = np.fromiter((at(n) for names in named for n in names), np.int64, counts.sum())
        sizes = self.size[places]
        ends = np.cumsum(sizes)
        # the k-th id of a chunk stands k after its start
        ids = self.ids[np.repeat(self.start[places] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        for n in long:
            del self.at[n]
        self.start, self.size, self.ids = self.start[: kept[0]], self.size[: kept[0]], self.ids[: kept[1]]
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]


def _blocks(batches: Iterator[pa.RecordBatch], block_chars: int) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts of consecutive documents, of a bounded number of characters."""
    ids: list[int | None] = []
    texts: list[str] = []
    chars = 0
    for batch in batches:
        for i, text in zip(batch["id"].to_pylist(), batch["text"]):
            text = text.as_py()
            if ids and chars + len(text) > block_chars:
                yield ids, texts
                ids, texts, chars = [], [], 0
            ids.append(i)
            texts.append(text)
            chars += len(text)
    if ids:
        yield ids, texts


def piece_encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Encode every whole text as the sentencepiece library does, without begin and end ids.

    Returns ``id_col``, ``n_tokens`` (long), ``ids`` (array of int) and, with ``decoded``,
    ``decoded`` (the text decoded from the ids).  Supported are BPE models with byte fallback,
    a leading marker and no character normalisation; others raise.  The model has a fixed size
    and is sent with the tasks.  Where its pieces can cross markers, a chunk is a whole text.

    Null and empty texts have no ids.  Rows are answered one by one, so repeated rows and ids
    give repeated results, and a null id stays.  White space, markers within a text and control
    characters are kept as the library keeps them (a marker decodes to a space).  A very long text
    has a block of its own; a very long chunk costs n log n.  An empty table gives an empty
    result; other columns are ignored.
    """
    model = PieceModel(model_path)
    names = [id_col, "n_tokens", "ids"] + ["decoded"] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        for doc_ids, texts in _blocks(batches, block_chars):
            ids, cuts = table.encode(texts)
            out = [pa.array(doc_ids, pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))]
            if decoded:
                out.append(pa.array([model.decode(ids[a:b].tolist()) for a, b in zip(cuts, cuts[1:])], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"`{id_col}` long, n_tokens long, ids array<int>" + ", decoded string" * decoded
    return id_text(df, id_col, text_col).mapInArrow(run, schema)


def piece_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of each row's ids (array of int; null or empty: an empty text; null ids in it are
    left out), as ``id_col`` and ``decoded``.  Rows are answered one by one; ids that the model
    does not have raise an IndexError; an empty table gives an empty result."""
    model = PieceModel(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.decode([i for i in ids or [] if i is not None]) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(texts, pa.string())], names=[id_col, "decoded"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"`{id_col}` long, decoded string")
