"""Subtree totals of a forest by parallel tree contraction.

Each round rakes all leaves into their parents and compresses all chains of nodes with one child:
the chain's last child is hung on the node above the chain, and its edge carries what the chain
adds.  Chains are walked by pointer doubling, so a chain of any length takes rounds in the
logarithm of its length, and as a compressed forest has a leaf for every second node, there are
rounds in the logarithm of the number of nodes.  Contracted chains are then expanded again in
reverse order: a node's total is what the chain adds from it on, and the total of its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release, write_cut

#: A key with more than this share of all rows is hot, so there are fewer hot keys than its inverse.
HOT_SHARE = 0.001


def join_hot(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Inner join of (written) ``rows`` with ``side``, which holds a key once.  Keys with more than a
    thousandth of all rows, at most a thousand, come by broadcast, so none fills a task."""
    total = rows.count()
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_SHARE * total).select(key)
    few = side.join(F.broadcast(hot), key, "left_semi")
    rest = rows.join(F.broadcast(hot), key, "left_anti")
    return rows.join(F.broadcast(few), key).unionByName(rest.join(side, key))


def _empty(df: DataFrame) -> bool:
    return df.first() is None


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(id, *values): the sums of ``values`` (longs, not null) over each node's subtree, itself
    included.  ``nodes`` holds ``id`` (long, each once), ``parent`` (null for a root) and the values.

    Neither a node with many children nor a long chain fills a task: children's values are summed
    before the shuffle, and the end that many chain nodes share is joined as a hot key.  Several
    roots and nodes without any edge are allowed; an empty table gives an empty result; other
    columns are ignored.  A parent that is no node, or a cycle, raises.
    """
    written: list[DataFrame] = []

    def cut(df: DataFrame, name: str) -> DataFrame:
        written.append(write_cut(df, name))
        return written[-1]

    def sums(names: str, parts: list[Column]) -> list[Column]:
        return [p.alias(f"{names}_{v}") for v, p in zip(values, parts)]

    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    zero = [F.lit(0).cast("long") for _ in values]
    tree = cut(nodes.join(kids, "id", "left").select("id", "parent", F.coalesce("kids", F.lit(0)).alias("kids"), *sums("a", [F.col(v) for v in values]), *sums("w", zero)), "tree")
    total = lambda t: t.select("id", *[F.col(f"a_{v}").alias(v) for v in values])
    done = total(tree.where("parent IS NULL AND kids = 0"))
    chains = []
    while not _empty(tree.where("parent IS NOT NULL")):
        # rake
        leaves = tree.where("parent IS NOT NULL AND kids = 0")
        if _empty(leaves):
            raise ValueError("the parents form a cycle or are no nodes")
        done = done.unionAll(total(leaves))
        gain = leaves.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("gone"), *sums("g", [F.sum(F.col(f"a_{v}") + F.col(f"w_{v}")) for v in values]))
        rest = cut(
            tree.where("kids > 0").join(gain, "id", "left").select("id", "parent", (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids"), *sums("a", [F.col(f"a_{v}") + F.coalesce(f"g_{v}", F.lit(0)) for v in values]), *[f"w_{v}" for v in values]),
            "raked",
        )
        # a root without children is done
        done = done.unionAll(total(rest.where("parent IS NULL AND kids = 0")))
        unary = rest.where("parent IS NOT NULL AND kids = 1")
        if _empty(unary):
            tree = rest
            continue
        # compress: each node with one child, that child, and what the way to it adds
        child = rest.select(F.col("parent").alias("id"), F.col("id").alias("down"), (F.col("kids") == 1).alias("open"), *sums("c", [F.col(f"w_{v}") for v in values]))
        links = cut(unary.join(child.where("id IS NOT NULL"), "id").select("id", "down", "open", *sums("d", [F.col(f"a_{v}") + F.col(f"c_{v}") for v in values]), F.col("parent").alias("up"), *[f"w_{v}" for v in values]), "links")
        walk = links.select("id", "down", "open", *[f"d_{v}" for v in values])
        while not _empty(walk.where("open")):
            ahead = walk.select(F.col("id").alias("down"), F.col("down").alias("to"), F.col("open").alias("on"), *sums("e", [F.col(f"d_{v}") for v in values]))
            further = walk.where("open").join(ahead, "down").select("id", F.col("to").alias("down"), F.col("on").alias("open"), *sums("d", [F.col(f"d_{v}") + F.col(f"e_{v}") for v in values]))
            walk = cut(walk.where("NOT open").unionAll(further), "walk")
        chains.append(walk)
        # the child under each chain's last node hangs on what is above its first
        inner = links.where("open").select(F.col("down").alias("id"))
        heads = links.select("id", "up", *[f"w_{v}" for v in values]).join(inner, "id", "left_anti").join(walk, "id")
        heads = heads.select(F.col("down").alias("id"), "up", *sums("h", [F.col(f"d_{v}") + F.col(f"w_{v}") for v in values]))
        tree = cut(
            rest.where("parent IS NULL OR kids <> 1").join(heads, "id", "left").select("id", F.coalesce("up", "parent").alias("parent"), "kids", *[f"a_{v}" for v in values], *sums("w", [F.coalesce(f"h_{v}", f"w_{v}") for v in values])),
            "tree",
        )
    done = write_cut(done, "totals")
    steps = [done]
    for walk in reversed(chains):
        found = join_hot(walk, done.select(F.col("id").alias("down"), *sums("e", [F.col(v) for v in values])), "down")
        steps.append(write_cut(found.select("id", *[(F.col(f"d_{v}") + F.col(f"e_{v}")).alias(v) for v in values]), "expanded"))
        done = done.unionAll(steps[-1])
    release(*written)
    return done
