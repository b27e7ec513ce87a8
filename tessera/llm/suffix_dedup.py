"""Removal of byte strings that occur more than once, by hash-compared suffix sorts.

Every repeated string of ``length`` bytes holds an anchor: the ANCHOR bytes in it with the least
hash (content alone decides, so both places choose the same).  Only text around anchors that
occur more than once is looked at again, and only once for equal surroundings, so whole copies
and the unchanged parts of near copies cost no more than their anchors.  For each shared anchor
the suffixes that begin at it, and the reversed prefixes that end there, are sorted: prefix
polynomial hashes and a binary search give the common extension of two of them, so a comparison
in the mergesort takes a logarithmic number of steps.  Common extensions of neighbours are then
verified byte by byte.  From both orders follow, for each place, the leftmost and rightmost
strings of ``length`` bytes around the anchor that occur elsewhere; all bytes between are covered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import write_cut

ANCHOR = 128
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Contexts sorted together in a task.
RUN_ROWS = 4_000
#: An anchor with more contexts is parted: a string of the whole length has its end in one of PARTS
#: ranges, and those of one range agree on all bytes but the range's.  A part with still more
#: contexts than HOT_CONTEXTS goes by hashes of whole strings.
MANY_CONTEXTS, PARTS, HOT_CONTEXTS = 2_000, 4, 50_000
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            p = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS


def sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``w`` neighbours."""
    span = 1
    while span * 2 <= w:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (w - span)], x[w - span :]) if span < w else x


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all strings of ``length`` bytes."""
    n, w = len(raw), length - ANCHOR + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
    h = (sums[ANCHOR:] - sums[:-ANCHOR]) * up[: n - ANCHOR + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    least = np.zeros(n - length + 1 + 2 * (w - 1), dtype=np.uint64)
    least[w - 1 : w - 1 + n - length + 1] = sliding(h, w, np.minimum)
    at = np.flatnonzero(sliding(least, w, np.maximum) == h)
    return at, h[at]


class Sorted:
    """Strings sorted within groups.  ``rows``: bytes padded to one width; ``size``: their lengths;
    ``group``: group numbers, equal ones side by side."""

    def __init__(self, rows: np.ndarray, size: np.ndarray, group: np.ndarray):
        self.rows, self.size = rows, size
        n, width = rows.shape
        self.sums = np.zeros((n, width + 1), dtype=np.uint64)
        np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * powers(width + 1)[1][:width], axis=1, out=self.sums[:, 1:])
        self.steps = [1 << k for k in range(max(1, width).bit_length() - 1, -1, -1)]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        count = np.diff(np.append(first, n))
        self.order = np.arange(n)
        self._sort(np.repeat(first, count), np.repeat(count, count), int(count.max(initial=0)))
        self.lcp = np.full(n, -1, dtype=np.int64)  # with the one before, in order
        if n > 1:
            a, b = self.order[:-1], self.order[1:]
            same = group[a] == group[b]
            self.lcp[1:][same] = self.extension(a[same], b[same])
        self._verify()

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning, by a binary search over prefix hashes."""
        most, found = np.minimum(self.size[a], self.size[b]), np.zeros(len(a), dtype=np.int64)
        for step in self.steps:
            more = found + step
            fits = more <= most
            at = np.where(fits, more, 0)
            found = np.where(fits & (self.sums[a, at] == self.sums[b, at]), more, found)
        return found

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a comes before b; a beginning comes before what it begins."""
        e = self.extension(a, b)
        end_a, end_b = e == self.size[a], e == self.size[b]
        last = self.rows.shape[1] - 1
        less = self.rows[a, np.minimum(e, last)] < self.rows[b, np.minimum(e, last)]
        return np.where(end_a, ~end_b, ~end_b & less)

    def _sort(self, first: np.ndarray, count: np.ndarray, most: int) -> None:
        """Bottom-up mergesort of all groups at once: each string looks up its place in the
        neighbouring run by binary search."""
        place = np.arange(len(first)) - first
        run = 1
        while run < most:
            block = place // run
            other = (block ^ 1) * run
            who = np.flatnonzero((count > run) & (other < count))
            low = first[who] + other[who]
            high = np.minimum(low + run, first[who] + count[who])
            start, me = low.copy(), self.order[who]
            left = (block[who] & 1) == 0
            while (open_ := low < high).any():
                mid = (low + high) // 2
                it = self.order[np.minimum(mid, len(self.order) - 1)]
                # strings of the left run come first among equals
                ahead = np.where(left, self.before(it, me), ~self.before(me, it))
                low, high = np.where(open_ & ahead, mid + 1, low), np.where(open_ & ~ahead, mid, high)
            to = first[who] + np.minimum(block[who], block[who] ^ 1) * run + (place[who] - block[who] * run) + (low - start)
            self.order[to] = me
            run *= 2

    def _verify(self) -> None:
        """Hash collisions would show as a common extension whose bytes differ."""
        pairs = np.flatnonzero(self.lcp > 0)
        width = np.arange(self.rows.shape[1])
        for at in range(0, len(pairs), 4096):
            k = pairs[at : at + 4096]
            inside = width[None, :] < self.lcp[k][:, None]
            if ((self.rows[self.order[k - 1]] != self.rows[self.order[k]]) & inside).any():
                raise ArithmeticError("hash collision in a suffix sort; choose another BASE")


def padded(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in strings], dtype=np.int64)
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width), size


def extents(group: np.ndarray, texts: list[bytes], at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For contexts with their anchors at ``at``: how many bytes before and after the anchor the
    leftmost and rightmost strings of ``length`` bytes reach that another context of the group
    holds too; -1 where there is none."""
    spare, n = length - ANCHOR, len(texts)
    right = Sorted(*padded([t[a : a + length] for t, a in zip(texts, at, strict=True)], length), group)
    left = Sorted(*padded([t[a - spare if a > spare else 0 : a][::-1] for t, a in zip(texts, at, strict=True)], spare), group)

    def nearest(s: Sorted) -> np.ndarray:
        best = np.zeros(n, dtype=np.int64)
        best[s.order] = np.maximum(s.lcp, np.append(s.lcp[1:], -1))
        return best

    # only these can share a string of the whole length
    may = np.flatnonzero((nearest(right) >= ANCHOR) & (nearest(left) + nearest(right) >= length))
    reach_left, reach_right = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    if not len(may):
        return reach_left, reach_right
    rank_r, rank_l = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    rank_r[right.order], rank_l[left.order] = np.arange(n), np.arange(n)

    def shared(t: int) -> np.ndarray:
        """Those of ``may`` whose string with t bytes after the anchor another one has."""
        key = np.cumsum(right.lcp < ANCHOR + t)[rank_r[may]] * (n + 1) + np.cumsum(left.lcp < spare - t)[rank_l[may]]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        out = np.zeros(len(may), dtype=bool)
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
        return out

    fits_right = np.array([len(texts[i]) - at[i] - ANCHOR for i in may])
    fits_left = np.asarray(at)[may]
    for reach, todo in ((reach_right, range(spare, -1, -1)), (reach_left, range(spare + 1))):
        open_ = np.ones(len(may), dtype=bool)
        for t in todo:
            found = shared(t) & open_ & (fits_right >= t) & (fits_left >= spare - t)
            reach[may[found]] = t if reach is reach_right else spare - t
            open_ &= ~found
            if not open_.any():
                break
            if reach is reach_left:
                open_ &= reach_right[may] >= 0  # without a rightmost there is no leftmost
    return reach_left, reach_right


def _extents_of_runs(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by part: whole parts are gathered and handled together."""
        held: list[pd.DataFrame] = []
        rows = 0

        def flush(pdf: pd.DataFrame) -> pd.DataFrame:
            left, right = extents(pdf["part"].to_numpy(), pdf["bytes"].tolist(), pdf["at"].to_numpy(), length)
            some = (left >= 0) & (pdf["n"].to_numpy() == 1)
            out = pdf.loc[some, ["id", "t1"]]
            place = pdf.loc[some, "pos"].to_numpy()
            return out.assign(lo=place - left[some], hi=place + ANCHOR + right[some])

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= RUN_ROWS:
                pdf = pd.concat(held, ignore_index=True)
                open_ = (pdf["part"] == pdf["part"].iloc[-1]).to_numpy()
                if not open_.all():
                    yield flush(pdf[~open_].reset_index(drop=True))
                    pdf = pdf[open_]
                held, rows = [pdf], len(pdf)
        if rows:
            yield flush(pd.concat(held, ignore_index=True))

    return run


def _cores(length: int):
    spare = length - ANCHOR
    cuts = [spare * k // PARTS for k in range(PARTS)] + [spare + 1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each range [t, u) of bytes after the anchor, a hash of what all strings of the range
        have in common, where the context holds one of them."""
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("id", "t1", "pos", "part")}
            for i, t1, pos, at, raw in zip(batch["id"], batch["t1"], batch["pos"], batch["at"], batch["bytes"], strict=True):
                least, most = max(0, spare - at), min(spare, len(raw) - at - ANCHOR)
                for k in range(PARTS):
                    t, u = cuts[k], cuts[k + 1] - 1
                    if t <= most and u >= least:
                        core = raw[max(0, at - spare + u) : at + ANCHOR + t]
                        for c, v in (("id", i), ("t1", t1), ("pos", pos), ("part", xxhash.xxh3_64_intdigest(core, seed=k + 1))):
                            out[c].append(v)
            out["part"] = np.array(out["part"], np.uint64).view(np.int64)
            yield pd.DataFrame(out)

    return run


def _strings(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A digest of each string of the whole length that holds the anchor."""
        spare = length - ANCHOR
        for batch in batches:
            for r in batch.itertuples(index=False):
                ts = [t for t in range(spare + 1) if r.at >= spare - t and len(r.bytes) - r.at - ANCHOR >= t]
                yield pd.DataFrame({"part": r.part, "id": r.id, "t1": r.t1, "pos": r.pos, "n": r.n, "t": ts, "digest": [xxhash.xxh3_128_digest(r.bytes[r.at - spare + t : r.at + ANCHOR + t]) for t in ts]})

    return run


def repeated_spans(rows: DataFrame, length: int = 400) -> DataFrame:
    """From (id, t1, raw), t1 a hash of raw: (id, t1, spans), spans being intervals [lo, hi) of the
    bytes that strings occurring more than once cover; only rows that have some."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reach = length - ANCHOR
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("id", "t1", "pos", "lo", "hi", "anchor", "ctx")}
            for i, t1, raw in zip(batch["id"], batch["t1"], batch["raw"], strict=True):
                at, h = anchors(raw, length)
                if len(at):
                    lo, hi = np.maximum(at - reach, 0), np.minimum(at + ANCHOR + reach, len(raw))
                    # where the anchor stands in its context is part of what must agree
                    ctx = [xxhash.xxh3_64_intdigest(raw[a:b], seed=p - a) for a, b, p in zip(lo.tolist(), hi.tolist(), at.tolist(), strict=True)]
                    for c, v in (("id", [i] * len(at)), ("t1", [t1] * len(at)), ("pos", at), ("lo", lo), ("hi", hi), ("anchor", h.view(np.int64)), ("ctx", np.array(ctx, np.uint64).view(np.int64))):
                        out[c].append(v)
            yield pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()})

    long_enough = rows.where(F.length("raw") >= length)
    placed = long_enough.select("id", "t1", "raw").mapInPandas(find, "id long, t1 long, pos int, lo int, hi int, anchor long, ctx long")
    mine, same = Window.partitionBy("anchor"), Window.partitionBy("anchor", "ctx")
    shared = placed.withColumn("total", F.count("*").over(mine)).where("total > 1").drop("total")
    shared = shared.withColumn("n", F.count("*").over(same)).withColumn("r", F.row_number().over(same.orderBy("id", "t1", "pos")))
    shared = write_cut(shared.withColumn("kinds", F.sum((F.col("r") == 1).cast("long")).over(mine)), "anchors")

    # a context that occurs twice is repeated as a whole; others are compared within their anchor
    whole = shared.where("n > 1").select("id", "t1", "lo", "hi")
    wanted = shared.where("r = 1 AND kinds > 1").groupBy("id", "t1").agg(F.collect_list(F.struct("pos", "lo", "hi", "anchor", "n", "kinds")).alias("places"))

    one_text = long_enough.join(wanted, ["id", "t1"]).dropDuplicates(["id", "t1"])
    cut = one_text.select("id", "t1", "raw", F.explode("places").alias("p")).select("id", "t1", "p.anchor", "p.pos", "p.n", "p.kinds", (F.col("p.pos") - F.col("p.lo")).alias("at"), F.expr("substring(raw, p.lo + 1, p.hi - p.lo)").alias("bytes"))
    contexts = write_cut(cut, "contexts")
    few = contexts.where(F.col("kinds") <= MANY_CONTEXTS).withColumn("part", F.col("anchor"))
    many = contexts.where(F.col("kinds") > MANY_CONTEXTS)
    part = Window.partitionBy("part")
    cores = many.select("id", "t1", "pos", "at", "bytes").mapInPandas(_cores(length), "id long, t1 long, pos int, part long")
    cores = cores.withColumn("kinds", F.count("*").over(part)).where("kinds > 1")
    parted = write_cut(many.drop("kinds").join(cores, ["id", "t1", "pos"]), "parted")
    sort = few.unionByName(parted.where(F.col("kinds") <= HOT_CONTEXTS)).drop("kinds", "anchor").repartition("part").sortWithinPartitions("part")
    parts = sort.mapInPandas(_extents_of_runs(length), "id long, t1 long, lo int, hi int")

    hot = parted.where(F.col("kinds") > HOT_CONTEXTS).drop("kinds", "anchor")
    strings = hot.mapInPandas(_strings(length), "part long, id long, t1 long, pos int, n long, t int, digest binary")
    twice = strings.groupBy("part", "t", "digest").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    spare = length - ANCHOR
    by_hash = strings.where("n = 1").join(twice, ["part", "t", "digest"]).groupBy("id", "t1", "pos").agg(F.min("t").alias("t0"), F.max("t").alias("t9")).select("id", "t1", (F.col("pos") - spare + F.col("t0")).alias("lo"), (F.col("pos") + ANCHOR + F.col("t9")).alias("hi"))
    return whole.unionAll(parts).unionAll(by_hash).groupBy("id", "t1").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def merge_spans(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def remove_repeats(df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Remove every byte that a string of ``length`` bytes covers which also starts anywhere else.

    Returns ``id_col``, the columns in ``keep``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal
    removed runs), ``kept`` (binary: the other bytes, in order) and ``kept_text`` (those as text,
    without characters that were cut in two).  Strings never cross rows and
    are judged on the input.  A null text is empty; shorter texts are kept whole; rows that
    repeat a text of at least ``length`` bytes lose all of it, also under one id; a null id is an
    id like others; an empty table gives an empty result.

    What is shuffled of unshared text is one small row for each anchor (about one in 140 bytes).
    Rows of a hot anchor are counted by windows that spill; an anchor with many different contexts
    is parted first by what strings have in common, and a part with more than ``HOT_CONTEXTS`` is
    not sorted in one task but counted by digests of whole strings.
    """
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    extra = {f"k{k}": c for k, c in enumerate(keep)}
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(raw).alias("t1"), raw.alias("raw"), *[F.col(c).alias(k) for k, c in extra.items()])
    spans = repeated_spans(rows.select("id", "t1", "raw"), length)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            for raw, some in zip(batch["raw"], batch["spans"], strict=True):
                gone = [] if some is None else merge_spans(some)
                last, kept = 0, []
                for lo, hi in gone:
                    kept.append(raw[last:lo])
                    last = hi
                kept = b"".join([*kept, raw[last:]])
                for c, v in (("n_bytes", len(raw)), ("n_removed", len(raw) - len(kept)), ("n_spans", len(gone)), ("kept", kept)):
                    out[c].append(v)
            out["kept_text"] = [k.decode("utf-8", "ignore") for k in out["kept"]]
            yield batch.drop(columns=["raw", "spans"]).assign(**out)

    joined = rows.join(spans, ["id", "t1"], "left").drop("t1")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("raw", "spans"))
    done = joined.mapInPandas(cut, fields + ", n_bytes long, n_removed long, n_spans long, kept binary, kept_text string")
    return done.select(F.when(F.col("id") != -(2**63), F.col("id")).alias(id_col), *[F.col(k).alias(c) for k, c in extra.items()], "n_bytes", "n_removed", "n_spans", "kept", "kept_text")


