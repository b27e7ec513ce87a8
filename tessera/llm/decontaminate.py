"""Benchmark decontamination with a generalised suffix automaton over item words.

All items' word sequences go into one automaton.  A document's words are streamed through it;
the automaton's state and the length of the longest match that ends at the present word say
whether a window (``window`` consecutive item words, or a whole shorter item) ends there, so one
pass finds every occurrence of every window of every item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that belong to words, with A-Z in lower case; all others part words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of item texts in one automaton; more items make more automata, each with a pass of its own.
BLOCK_BYTES = 16_000_000


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(WORD_BYTES).split()


class ItemAutomaton:
    """Generalised suffix automaton of word sequences, with what each state says of windows."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        spelled = []
        for item, words in items:
            if words:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
                spelled.append((item, ids))
                self._add(ids)
        self.shortest = min((min(len(ids), window) for _, ids in spelled), default=0)
        n = len(self.next)
        #: For a match of at least ``window`` words, the state of its last ``window`` words.
        self.tail = [0] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            if self.length[v] >= window:
                self.tail[v] = v if self.length[self.link[v]] < window else self.tail[self.link[v]]
        #: Items that hold the window of a state; whole short items that end in a state, by length.
        self.holders: dict[int, set[int]] = {}
        self.shorts: dict[int, dict[int, set[int]]] = {}
        for item, ids in spelled:
            state = 0
            for k, c in enumerate(ids):
                state = self.next[state][c]
                if k + 1 >= window:
                    # the whole prefix is matched, so the state's tail is the window that ends here
                    self.holders.setdefault(self.tail[state], set()).add(item)
            if len(ids) < window:
                while self.length[self.link[state]] >= len(ids):
                    state = self.link[state]
                self.shorts.setdefault(state, {}).setdefault(len(ids), set()).add(item)
        #: The nearest state on the way of suffix links, itself included, where a short item ends.
        self.short_at = [-1] * n
        for v in sorted(range(n), key=self.length.__getitem__):
            self.short_at[v] = v if v in self.shorts else self.short_at[self.link[v]] if v else -1

    def _add(self, ids: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length

        def split(p: int, c: int, q: int) -> int:
            """A state of its own for q's strings that p and c spell."""
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            link[q] = clone
            return clone

        last = 0
        for c in ids:
            q = nxt[last].get(c)
            if q is not None:  # another item has spelled this
                last = q if length[q] == length[last] + 1 else split(last, c, q)
                continue
            new, p = len(nxt), last
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else split(p, c, q)
            last = new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal runs [from, to) of words that windows cover, and the items found."""
        ids = list(map(self.vocabulary.get, words))
        n, runs, found = len(ids), [], set()
        nxt, link, length, window, tail, short_at = self.next, self.link, self.length, self.window, self.tail, self.short_at
        least = self.shortest
        if not least:
            return runs, found
        at = 0
        while at < n:
            if ids[at] is None:
                try:
                    # a word that no item has ends every match: on to the next run of known words
                    while ids[at] is None:
                        at += 1
                except IndexError:
                    break
            end = at
            while end < n and ids[end] is not None:
                end += 1
            if end - at >= least:
                state = matched = 0
                for i in range(at, end):
                    c = ids[i]
                    step = nxt[state].get(c)
                    while step is None and state:
                        state = link[state]
                        matched = length[state]
                        step = nxt[state].get(c)
                    if step is None:
                        continue
                    state, matched = step, matched + 1
                    covered = 0
                    if matched >= window:
                        covered = window
                        found |= self.holders.get(tail[state], ())
                    v = short_at[state]
                    while v >= 0:
                        for size, items in self.shorts[v].items():
                            if size <= matched:
                                covered = max(covered, size)
                                found |= items
                        v = short_at[link[v]] if v else -1
                    if covered:
                        start = i + 1 - covered
                        while runs and runs[-1][1] >= start:
                            start = min(start, runs.pop()[0])
                        runs.append((start, i + 1))
            at = end
        return runs, found


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of a bounded size; no more than one block is held at once."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row["id"], row["text"]))
        size += len(row["text"])
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", cleaned: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Spans of document words that item windows cover.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in
    lower case.  A window is ``window`` consecutive words of an item; an item of fewer words, but
    not none, is one window.  Returns ``id_col``, ``n_words``, ``spans`` (array of
    struct<start, end> over words, maximal, in order), ``items`` (ids of items with an occurring
    window, ascending), with ``cleaned`` also ``cleaned``, the text without the spans, and the
    columns in ``keep``.

    The automaton is broadcast; items beyond ``BLOCK_BYTES`` go into further automata, and their
    spans are joined per row in the same pass, so that no broadcast grows with the items.  The
    driver builds all automata and each worker holds them all: their memory grows with the items.
    Documents pass through one map without a shuffle.  Null and empty texts have no words; a row
    is answered by itself, so repeated rows and ids repeat results; items with a null id count as
    one more id (null is left out of ``items``); empty tables give no spans.
    """
    sc = docs.sparkSession.sparkContext
    sent = [sc.broadcast(ItemAutomaton([(i, words_of(t)) for i, t in block], window)) for block in _blocks(items, item_id_col, item_text_col)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automata = [s.value for s in sent]
        for batch in batches:
            counts, spans, held, texts = [], [], [], []
            for text in batch["text"]:
                words = words_of(text)
                counts.append(len(words))
                runs: list[tuple[int, int]] = []
                found: set[int] = set()
                for automaton in automata:
                    more, which = automaton.scan(words)
                    runs += more
                    found |= which
                runs = runs if len(automata) == 1 else merged(runs)
                spans.append([{"start": a, "end": b} for a, b in runs])
                if cleaned:
                    texts.append(cut_words(text, runs))
                held.append(sorted(found - {None}))
            out = batch.drop(columns=["text"]).assign(n_words=counts, spans=spans, items=held)
            yield out.assign(cleaned=texts) if cleaned else out

    extra = {f"k{k}": c for k, c in enumerate(keep)}
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(k) for k, c in extra.items()])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    schema = fields + ", n_words long, spans array<struct<start:int,end:int>>, items array<long>" + ", cleaned string" * cleaned
    return rows.mapInPandas(run, schema).select(F.col("id").alias(id_col), "n_words", "spans", "items", *["cleaned"] * cleaned, *[F.col(k).alias(c) for k, c in extra.items()])


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of intervals; those that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return text
    places = [m.span() for m in re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : places[a][0]])
        last = places[b - 1][1]
    return "".join(out) + text[last:]
