"""Ordered scans with carry-over, language profiles and the fast Gauss transform against brute force."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import language, ordered, profile

ROWS = "id long, g string, t long, v double, w double"


def _rows(n, seed=1):
    r = random.Random(seed)
    # one hot group, a null group, groups of one row; long stretches without a value
    return [(i, r.choice(["hot"] * 5 + [None, "a", "b"]) if i % 50 else f"one{i}", r.randrange(n), None if r.random() < 0.9 else float(i), None if i < n // 2 else float(-i)) for i in range(n)]


def _by_group(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        groups.setdefault(r[1], []).append(r)
    return groups


def test_last_value_carries_over_many_ranges(spark):
    rows = _rows(600)
    got = {r["id"]: (r["v"], r["w"]) for r in ordered.last_value(spark.createDataFrame(rows, ROWS), ["g"], ["t", "id"], ["v", "w"], rows=10).collect()}
    want = {}
    for group in _by_group(rows).values():
        v = w = None
        for r in group:
            v, w = (v if r[3] is None else r[3]), (w if r[4] is None else r[4])
            want[r[0]] = (v, w)
    assert got == want


def test_next_value_carries_over_many_ranges(spark):
    rows = _rows(600, seed=2)
    got = {r["id"]: r["nx"] for r in ordered.next_value(spark.createDataFrame(rows, ROWS), ["g"], ["t", "id"], "w", "nx", rows=10).collect()}
    want = {a[0]: b[4] for group in _by_group(rows).values() for a, b in zip(group, [*group[1:], (None,) * 5])}
    assert got == want


def test_scans_without_groups_and_of_empty_tables(spark):
    rows = _rows(200, seed=3)
    df = spark.createDataFrame(rows, ROWS)
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    got = {r["id"]: r["nx"] for r in ordered.next_value(df, [], ["t", "id"], "v", "nx", rows=10).collect()}
    assert got == {a[0]: b[3] for a, b in zip(order, [*order[1:], (None,) * 5])}
    assert ordered.last_value(df.limit(0), [], ["t"], ["v"]).columns == df.columns
    assert ordered.last_value(df.limit(0), ["g"], ["t"], ["v"]).collect() == []
    assert ordered.next_value(df.limit(0), ["g"], ["t"], "v", "nx").collect() == []


def test_scan_ranges_split_a_hot_group_evenly(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 3 != 0, 0).otherwise(F.col("id")).alias("g"), F.hash("id").alias("t"))
    sizes = [r["count"] for r in ordered.with_order_ranges(df, ["g"], ["t", "id"], rows=1000).groupBy(ordered.RANGE).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 2 * np.median(sizes)
    plan = ordered.last_value(df, ["g"], ["t", "id"], ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan  # carried rows are broadcast, fewer than the ranges


def _ranked(texts, top):
    n = Counter()
    for t in texts:
        for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split():
            p = f" {w} "
            n.update(p[i:i + s] for s in (1, 2, 3) for i in range(len(p) - s + 1) if p[i:i + s] != " ")
    return {g: k + 1 for k, (g, _) in enumerate(sorted(n.items(), key=lambda x: (-x[1], x[0].encode()))[:top])}


def test_language_profiles_match_brute_force(spark):
    learn = [("en", "the cat sat on the mat"), ("en", "where is the other thing"), ("fr", "le chat est sur la table où été"), ("de", "der Hund und die Katze über"), (None, "nothing"), ("de", None)]
    texts = [(1, "the thing on the table"), (2, "la table est là"), (3, "die Katze"), (4, ""), (5, None), (6, "123 !!"), (7, "жук"), (8, "x" * 5000)]
    df = spark.createDataFrame(learn, "lang string, body string").withColumn("text", F.lit("other")).withColumn("gram", F.lit(1))
    profiles = language.learn_profiles(df, "lang", "body", top=20)
    want = {la: _ranked([t for x, t in learn if x == la], 20) for la in ("en", "fr", "de")}
    assert {la: {r["gram"]: r["rank"] for r in profiles.where(F.col("lang") == la).collect()} for la in want} == want
    docs = spark.createDataFrame(texts, "id long, text string").withColumn("lang", F.lit("?"))
    got = {r["id"]: (r["detected_lang"], r["out_of_place"]) for r in language.detect_by_profiles(docs, "id", "text", profiles, top=20).collect()}
    for i, text in texts:
        own = _ranked([text], 20)
        best = min((sum(abs(k - p[g]) if g in p else 20 for g, k in own.items()), la) for la, p in want.items() if own.keys() & p.keys()) if any(own.keys() & p.keys() for p in want.values()) else None
        assert got[i] == ((best[1], best[0]) if best else ("unknown", None)), i
    assert language.detect_by_profiles(docs.limit(0), "id", "text", profiles).collect() == []


def test_language_of_held_out_documents(spark):
    import __spark_entry__ as E

    rows = E.queries()["language_detection_ngrams"](spark, "/root/testdata/sf0.001").where("held_out").collect()
    assert len(rows) > 20 and sum(r["lang"] == r["detected_lang"] for r in rows) >= 0.95 * len(rows)


def test_kde_matches_direct_sums(spark):
    r = random.Random(4)
    wide = [(r.gauss(0, 1) if i % 100 else r.choice([-4e3, 7e4]), float(r.randrange(5)), None if i % 7 else 1e-9 * i, 3.0, None) for i in range(2000)]
    df = spark.createDataFrame(wide, "a double, b double, c double, const double, nothing double")
    got = {}
    for row in profile.kde(df, df.columns, points=40).collect():
        got.setdefault(row["column"], {})[row["grid_index"]] = (row["x"], row["density"])
    assert "nothing" not in got and all(d is None for _, d in got["const"].values())
    for k, c in enumerate("abc"):
        v = np.array([x[k] for x in wide if x[k] is not None])
        h = v.std(ddof=1) * len(v) ** -0.2
        assert len(got[c]) == 40
        for x, d in got[c].values():
            want = np.exp(-0.5 * ((x - v) / h) ** 2).sum() / (len(v) * h * math.sqrt(2 * math.pi))
            assert abs(d - want) * h < 1e-11
