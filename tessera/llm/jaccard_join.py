"""Exact Jaccard join of shingle sets by partitioning the universe.

Sets whose sizes lie in one band can only be similar if they differ in at most H elements, H
given by the band.  Shingles are hashed into SPARE * (H + 1) segments; two similar sets then
agree wholly on all segments but H.  So whichever H + 1 of its segments a set looks up in an
index of all sets' segment subsets, each similar set turns up; which ones is a matter of cost.
Each set takes those that fewest sets share (cost-based allocation), so boilerplate and the
unchanged parts of large families of copies are left aside.  Of a pair, the set with the lower
cost does the looking up.  Segments where a set has no element are left out of the index, except
in groups of bands in which some set has no H + 1 others.

Copies and near copies do not multiply: equal sets are linked by their digests; every set is
first compared with one pivot, then with one more in each round as long as that links components,
and pairs inside a component are never formed again.  Candidates must agree on
enough segments, and are then compared by their texts, shingle by shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import id_text, release, write_cut
from tessera.llm.components import connected_components

#: Segments for each unit that must be looked up.
SPARE = 2
#: Sizes at the top and bottom of a band, as a ratio in percent.
WIDTH = 140
#: Slots of a set's parities, a power of two.
SLOTS = 2048
#: Most rounds in which each set is compared with one more set, chosen by a hash, of another component.
STARS = 3


def shingles(text: str, size: int) -> set[tuple[bytes, ...]]:
    """Distinct runs of ``size`` words; the whole sequence where there are fewer words."""
    w = text.encode("utf-8").lower().split()
    if len(w) < size:
        return {tuple(w)} if w else set()
    return set(zip(*(w[k:] for k in range(size))))


def hashed_shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    w = text.encode("utf-8").lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    known = {x: xxhash.xxh3_64_intdigest(x) for x in set(w)}
    h = np.fromiter(map(known.__getitem__, w), dtype=np.uint64, count=len(w))
    n = max(1, len(w) - size + 1)
    mixed = np.full(n, min(len(w), size), dtype=np.uint64)
    for k in range(min(size, len(w))):
        mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def parity(h: np.ndarray) -> np.ndarray:
    """For each of SLOTS slots, whether an odd number of elements falls there: two sets differ in at
    least as many elements as their slots differ."""
    slot = ((h * np.uint64(0xA0761D6478BD642F)) >> np.uint64(65 - SLOTS.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=SLOTS) & 1).astype(np.uint8)).view(np.int64)


def apart(bits_a: str, bits_b: str):
    """In how many slots two sets' parities differ."""
    return F.aggregate(F.zip_with(bits_a, bits_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def folded(bits: str):
    """A quarter of the slots, each of which stands for four: they differ in no more elements."""
    return F.array(*[F.expr(" ^ ".join(f"{bits}[{k + j * SLOTS // 256}]" for j in range(4))) for k in range(SLOTS // 256)])


def sizes_allow(percent: int, na: str, nb: str):
    return F.lit(percent) * F.greatest(na, nb) <= F.lit(100) * F.least(na, nb)


def may_be_similar(percent: int, na: str, nb: str, bits_a: str, bits_b: str):
    """Whether sizes allow similarity, and slots no more differences than it does."""
    return sizes_allow(percent, na, nb) & (apart(bits_a, bits_b) <= F.expr(f"(({na} + {nb}) * {100 - percent}) DIV {100 + percent}"))


class Bands:
    """Size bands for a threshold of ``percent`` / 100, and what follows from them."""

    def __init__(self, percent: int, top: int = 1 << 40):
        self.percent = percent
        self.low = [1]
        while self.low[-1] <= top:
            # the largest partner of a band's largest set lies in the next band at most
            self.low.append(max(self.low[-1] + 1, self.low[-1] * max(WIDTH, 10_000 // percent + 1) // 100))

    def band(self, n: int) -> int:
        from bisect import bisect_right

        return bisect_right(self.low, n) - 1

    def differ(self, band: int) -> int:
        """Most elements in which a set of the band and a similar one, no smaller, can differ:
        (a + b) (100 - p) / (100 + p) with b <= 100 a / p is a (100 - p) / p."""
        return (self.low[band + 1] - 1) * (100 - self.percent) // self.percent


def segments(h: np.ndarray, group: int, count: int) -> np.ndarray:
    """A 32-bit hash of each segment's subset, 0 for the empty one alone; equal hashes of different
    subsets only make candidates, which are verified."""
    place = ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)) % np.uint64(count)
    spread = h * np.uint64(0xFF51AFD7ED558CCD)
    spread ^= spread >> np.uint64(32)
    total = np.zeros(count, dtype=np.uint64)
    np.add.at(total, place.astype(np.int64), spread * np.uint64(0xC4CEB9FE1A85EC53))
    own = (np.arange(count, dtype=np.uint64) + np.uint64(group << 32)) * np.uint64(0x9E3779B97F4A7C15)
    out = (total ^ own) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(31))).astype(np.uint32)
    return np.where(np.bincount(place.astype(np.int64), minlength=count) > 0, np.maximum(out, 1), 0).astype(np.uint32).view(np.int32)


def _index(docs: DataFrame, bands: Bands, size: int) -> DataFrame:
    """One row for each document: id, n, key of its set, the text's own hashes, and for each of the
    two groups it may pair in: number, H, segments with elements and subset hashes by segment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {"n": [], "key": [], "bits": [], "groups": []}
            for text in batch["text"]:
                h = hashed_shingles(text, size)
                n = len(h)
                out["n"].append(n)
                out["bits"].append(parity(h))
                out["key"].append(xxhash.xxh3_128_digest(h.tobytes()))
                groups = []
                if n:
                    b = bands.band(n)
                    for g in (b - 1, b):
                        # the lower band's sets reach n only if its largest does
                        if g >= 0 and (g == b or n * bands.percent <= 100 * (bands.low[b] - 1)) and (differ := bands.differ(g)) > 0:
                            # a similar set differs from this one in n (100 - p) / p elements at most
                            sigs = segments(h, g, SPARE * (differ + 1))
                            groups.append({"g": g, "h": n * (100 - bands.percent) // bands.percent, "k": int(np.count_nonzero(sigs)), "sigs": sigs})
                out["groups"].append(groups)
            yield pd.DataFrame({"id": batch["id"], "t1": batch["t1"], "t2": batch["t2"], **out})

    rows = docs.select("id", "text", F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2"))
    return rows.mapInPandas(run, "id long, t1 long, t2 long, n long, key binary, bits array<long>, groups array<struct<g:int,h:int,k:int,sigs:array<int>>>")


def _verified(pairs: DataFrame, index: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    """Those of the pairs (a, b, g) whose sets are similar: first by their slots and the segments on
    which they agree, then exactly, by the shingles of their texts."""
    # written, so that what is joined from the index is only what the pairs name
    pairs = write_cut(pairs, "pairs")
    named = pairs.select(F.col("a").alias("nid")).unionAll(pairs.select("b")).distinct()
    slim = write_cut(index.join(named, "nid", "left_semi").select("nid", "n", "key", "bits", F.struct("t1", "t2").alias("x")), "nodes")
    left, right = (slim.select(F.col("nid").alias(c), *[F.col(k).alias(k + c) for k in ("n", "key", "bits", "x")]) for c in "ab")
    few = pairs.join(left, "a").join(right, "b").where((F.col("keya") != F.col("keyb")) & may_be_similar(percent, "na", "nb", "bitsa", "bitsb"))
    few = write_cut(few.select("a", "b", "g", "na", "nb", "xa", "xb").dropDuplicates(["a", "b"]), "few")
    release(pairs, slim)
    # subset hashes only of the sets that are still in question
    asked = few.select(F.col("a").alias("nid"), "g").unionAll(few.select("b", "g")).distinct()
    sigs = index.select("nid", F.explode("groups").alias("gr")).select("nid", "gr.g", "gr.sigs").join(asked, ["nid", "g"])
    sigs = write_cut(sigs, "sigs")
    near = few.join(sigs.withColumnsRenamed({"nid": "a", "sigs": "sa"}), ["a", "g"]).join(sigs.withColumnsRenamed({"nid": "b", "sigs": "sb"}), ["b", "g"])
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    # an element in which they differ spoils one segment
    most = F.expr(f"((na + nb) * {100 - percent}) DIV {100 + percent}")
    close = write_cut(near.where(agree >= F.size("sa") - most).select("a", "b", "xa", "xb"), "close")
    release(few, sigs)
    who = close.select(F.col("a").alias("nid"), "xa.t1", "xa.t2").unionAll(close.select("b", "xb.t1", "xb.t2")).distinct()
    # rows that repeat a text have a node each; here each text is fetched once
    texts = docs.select(F.col("text"), F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2")).join(who.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    held = write_cut(who.join(texts, ["t1", "t2"]).select("nid", "text"), "held")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, one = None, set()
        for batch in batches:
            good = []
            for a, ta, tb in zip(batch["a"], batch["ta"], batch["tb"], strict=True):
                if a != last:
                    last, one = a, shingles(ta, size)
                two = shingles(tb, size)
                both = len(one & two)
                good.append(100 * both >= percent * (len(one) + len(two) - both))
            yield batch.loc[good, ["a", "b"]]

    both = close.select("a", "b").join(held.select(F.col("nid").alias("a"), F.col("text").alias("ta")), "a").join(held.select(F.col("nid").alias("b"), F.col("text").alias("tb")), "b")
    links = write_cut(both.select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long"), "links")
    release(close, held)
    return links


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots after more links: roots stand for all that they link, so only links between them are added."""
    stars = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    named = links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    return connected_components(stars.unionAll(named.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))))


def _mixed(live: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one component."""
    many = live.groupBy("sig").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("sig")
    return live.join(many, "sig")


def _chance_star(live: DataFrame, nodes: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b, g): each node of a bucket meets one node that a hash chooses, if that is of another
    component; of those it may be similar to a node takes the one with the nearest parities."""
    by = F.struct(F.xxhash64("root", F.lit(turn)).alias("x"), F.xxhash64("nid", F.lit(turn)).alias("y"), "nid")
    chosen = live.groupBy("sig").agg(F.min_by(F.struct("nid", "root", "n"), by).alias("p")).select("sig", F.col("p.nid").alias("pivot"), F.col("p.root").alias("proot"), F.col("p.n").alias("pn"))
    met = live.join(chosen, "sig").where((F.col("root") != F.col("proot")) & sizes_allow(percent, "n", "pn"))
    met = met.groupBy("nid", "pivot").agg(F.min("g").alias("g"), F.min("n").alias("n"), F.min("pn").alias("pn"))
    near = met.join(nodes.select("nid", "bits"), "nid").join(nodes.select(F.col("nid").alias("pivot"), F.col("bits").alias("pbits")), "pivot").where(may_be_similar(percent, "n", "pn", "bits", "pbits"))
    return near.groupBy("nid").agg(F.min_by(F.struct("pivot", "g"), F.struct(apart("bits", "pbits").alias("d"), "pivot")).alias("p")).select(F.col("nid").alias("a"), F.col("p.pivot").alias("b"), F.col("p.g").alias("g"))


def _named(df: DataFrame, percent: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, t1, t2, n, root): each row with its component's root node, null for an empty set."""
    bands = Bands(percent)
    docs = id_text(df, id_col, text_col)
    # every row is a node; its number is fixed once the table is written
    index = write_cut(_index(docs, bands, size).withColumn("nid", F.monotonically_increasing_id()), "index")
    sets = index.where("n > 0").select("nid", "key")
    equal = sets.join(sets.groupBy("key").agg(F.min("nid").alias("b")), "key").where("nid <> b").select(F.col("nid").alias("a"), "b")
    # a node in one of its two groups has one number, so that little is dealt of a segment
    parts = index.select("nid", "n", F.posexplode("groups").alias("i", "gr")).select((2 * F.col("nid") + F.col("i")).alias("ng"), "nid", "n", "gr.g", "gr.h", "gr.k", "gr.sigs")
    # groups, of which there are as many as bands, where some set can't do without empty segments
    crowded = [r["g"] for r in parts.where("k <= h").select("g").distinct().collect()]
    empties = F.col("g").isin(crowded) if crowded else F.lit(False)
    meta = parts.select("ng", "nid", "n", "g", "h", F.when(empties, F.size("sigs")).otherwise(F.col("k")).alias("m"))
    each = parts.select("ng", "g", F.posexplode("sigs").alias("pos", "hash")).where((F.col("hash") != 0) | empties)
    # group, segment and subset in one number
    each = each.select("ng", F.expr("shiftleft(CAST(xxhash64(g, pos) AS long), 32) | (CAST(hash AS long) & 4294967295L)").alias("sig"))
    bucket = Window.partitionBy("sig")
    shared = write_cut(each.withColumn("c", F.count("*").over(bucket)).where("c > 1"), "shared")

    # first each node with the pivot with which it shares most segments; a bucket's pivot is the
    # node that shares most in all, which of a family of copies is one with few changes
    spent = Window.partitionBy("ng")
    most = shared.withColumn("pivot", F.struct(F.sum("c").over(spent).alias("w"), "ng")).withColumn("pivot", F.max("pivot").over(bucket)["ng"]).where("ng <> pivot").groupBy("ng", "pivot").agg(F.count("*").alias("k"))
    most = most.groupBy("ng").agg(F.max_by(F.struct(F.shiftright("pivot", 1).alias("pivot"), "k"), F.struct("k", -F.col("pivot"))).alias("p"))
    most = most.select("ng", "p.*").join(meta.select("ng", "nid", "g"), "ng")
    star = most.groupBy("nid").agg(F.max_by(F.struct("pivot", "g"), F.struct("k", -F.col("pivot"))).alias("p")).select(F.col("nid").alias("a"), F.col("p.pivot").alias("b"), F.col("p.g").alias("g"))
    links = _verified(star, index, docs, percent, size).unionAll(equal)
    roots = connected_components(links)

    # each set's lookups: segments that it shares with nobody are free, then the rarest
    own = Window.partitionBy("ng").orderBy("c", "sig")
    # joined on ng first, so that the windows of a set need no shuffle of their own
    known = meta.join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    rooted = shared.join(known, "ng")
    rated = rooted.withColumn("free", F.col("m") - F.count("*").over(spent)).withColumn("r", F.row_number().over(own))
    rated = rated.withColumn("probe", F.col("r") <= F.col("h") + 1 - F.col("free")).withColumn("cost", F.coalesce(F.sum(F.when(F.col("probe"), F.col("c"))).over(spent), F.lit(0)))
    rated = rated.select("sig", "nid", "n", "g", "cost", "probe", "root")
    # only buckets in which a set that looks there meets one of no lower cost and another component
    live = rated.withColumn("least", F.min(F.when(F.col("probe"), F.col("cost"))).over(bucket)).where("cost >= least")
    live = live.withColumn("r0", F.min("root").over(bucket)).withColumn("r1", F.max("root").over(bucket)).where("r0 <> r1")
    live = write_cut(live.select("sig", "nid", "n", "g", "cost", "root", "probe"), "live")
    release(shared)
    nodes = write_cut(index.join(live.select("nid").distinct(), "nid", "left_semi"), "rest")
    # families of copies grow together by nodes chosen at random, before all pairs of components are formed
    for turn in range(STARS):
        found = _verified(_chance_star(live, nodes, turn, percent), nodes, docs, percent, size)
        if found.first() is None:
            break
        roots = _joined(roots, found)
        now = live.drop("root").join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
        last, live = live, write_cut(_mixed(now), "live")
        release(last, found)
    met = live.join(nodes.select("nid", folded("bits").alias("fold")), "nid")
    x, y = met.where("probe").alias("x"), met.alias("y")
    first = (F.col("x.cost") < F.col("y.cost")) | (F.col("x.cost") == F.col("y.cost")) & (F.col("x.nid") < F.col("y.nid"))
    # plain expressions, as it is asked of all that meet
    some = sum((F.bit_count(F.col("x.fold")[k].bitwiseXOR(F.col("y.fold")[k])) for k in range(SLOTS // 256)), F.lit(0))
    most = F.expr(f"((x.n + y.n) * {100 - percent}) DIV {100 + percent}")
    pairs = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.root") != F.col("y.root")) & first & sizes_allow(percent, "x.n", "y.n") & (some <= most)).select(F.col("x.nid").alias("a"), F.col("y.nid").alias("b"), F.col("x.g").alias("g")).distinct()
    more = _verified(pairs, nodes, docs, percent, size)
    roots = _joined(roots, more)
    named = index.select("id", "t1", "t2", "n", "nid").join(roots.withColumnRenamed("node", "nid"), "nid", "left")
    named = write_cut(named.select("id", "t1", "t2", "n", F.when(F.col("n") > 0, F.coalesce("root", "nid")).alias("root")), "named")
    release(live, nodes, index)
    return named


def jaccard_components(df: DataFrame, percent: int = 90, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``n_shingles`` and ``component_id``, the least id that links reach.

    Two rows link when 100 * |A and B| >= percent * |A or B| of their sets of ``size``-word
    shingles (A-Z in lower case; words are parted by ASCII white space).  A text of fewer words has
    its whole sequence as its one shingle; a null or empty text has none and links with nothing.
    Rows with equal sets are linked, also rows that repeat an id; a null id is never a component's
    name unless its whole component has no other; an empty table gives an empty result.
    """
    named = _named(df, percent, size, id_col, text_col)
    names = named.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("name"))
    out = named.join(names, "root", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("name")).alias("component_id"))


def keep_one(df: DataFrame, percent: int = 90, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all its columns, of which one stays for each component: the one
    with the least id (then the least text hash).  Rows without words all stay."""
    named = _named(df, percent, size, id_col, text_col)
    chosen = named.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("x"), "id", "t1", "t2")).alias("c")).select("c.id", "c.t1", "c.t2")
    chosen = chosen.select(F.coalesce("id", F.lit(-(2**63))).alias("__id"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2")).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), "__t1": F.xxhash64(text), "__t2": F.xxhash64(text, F.lit(1))})
    worded = F.length(F.regexp_replace(text, "[ \\t-\\r]", "")) > 0
    one = rows.where(worded).join(chosen, ["__id", "__t1", "__t2"]).dropDuplicates(["__id", "__t1", "__t2"])
    return one.select(*df.columns).unionAll(rows.where(~worded).select(*df.columns))
