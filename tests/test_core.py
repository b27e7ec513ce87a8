"""Ledger cases (D1-D23) and invariants of the shared building blocks."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import core
from tessera.operators import clean, profile, relate


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    xs = np.concatenate([rng.normal(size=300), np.round(rng.normal(size=200), 1), [0.0, 0.0, -5.0, 1e6]])
    df = _frame(spark, [(float(x),) for x in xs], "x double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {r["pidx"]: r["q"] for r in core.exact_quantiles(df, ["x"], probs).collect()}
    for i, p in enumerate(probs):
        assert got[i] == pytest.approx(float(np.percentile(xs, p * 100)), rel=1e-12, abs=1e-12)


def test_average_ranks_match_pandas(spark):
    vals = [3.0, 1.0, 3.0, 2.0, 3.0, -1.0, 2.0]
    df = _frame(spark, [(v,) for v in vals], "x double")
    got = {r["value"]: r["rank"] for r in core.average_ranks(df, ["x"]).collect()}
    ranks = pd.Series(vals).rank(method="average")
    for v, rk in zip(vals, ranks):
        assert got[v] == rk


def test_mode_smallest_of_ties(spark):  # D5
    df = _frame(spark, [(2.0,), (1.0,), (2.0,), (1.0,), (None,), (None,), (None,)], "x double")
    m = core.modes(df, ["x"]).collect()[0]
    assert m["mode"] == 1.0 and m["mode_count"] == 2


def test_nan_is_null_and_all_null_column_untouched(spark):  # D1, C01
    df = _frame(spark, [(1.0, None), (float("nan"), None), (3.0, None)], "a double, b double")
    out = clean.impute_mean(core.nan_to_null(df)).collect()
    assert [r["a"] for r in out] == [1.0, 2.0, 3.0]
    assert all(r["b"] is None for r in out)


def test_scalers_constant_column_is_zero(spark):
    df = _frame(spark, [(5.0, 1.0), (5.0, 3.0), (None, 5.0)], "c double, x double")
    mm = clean.scale_minmax(df).collect()
    st = clean.scale_standard(df).collect()
    assert [r["c"] for r in mm] == [0.0, 0.0, None]
    assert [r["x"] for r in mm] == [0.0, 0.5, 1.0]
    assert [r["c"] for r in st][:2] == [0.0, 0.0]
    sd = np.std([1.0, 3.0, 5.0])
    assert st[0]["x"] == pytest.approx((1 - 3) / sd)


def test_outliers_joint_and_sequential(spark):  # D6
    rows = [(float(i), float(i % 5)) for i in range(20)] + [(1000.0, 2.0), (None, 100.0)]
    df = _frame(spark, rows, "a double, b double")
    joint = clean.remove_outliers_iqr(df, mode="joint").collect()
    seq = clean.remove_outliers_iqr(df, mode="sequential").collect()
    pdf = pd.DataFrame(rows, columns=["a", "b"])
    for col in ["a", "b"]:
        q1, q3 = pdf[col].quantile(0.25), pdf[col].quantile(0.75)
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        if ((pdf[col] < lo) | (pdf[col] > hi)).any():
            pdf = pdf[(pdf[col] >= lo) & (pdf[col] <= hi)]
    assert len(seq) == len(pdf)
    assert all(r["a"] != 1000.0 for r in joint) and all(r["b"] != 100.0 for r in joint)


def test_log_switches_to_log1p(spark):  # D7
    df = _frame(spark, [(0.0,), (1.0,), (-2.0,)], "x double")
    out = [r["x"] for r in clean.transform_log(df).collect()]
    assert out[0] == 0.0 and out[1] == pytest.approx(math.log(2.0)) and out[2] is None


def test_hash_randomness_is_partition_invariant(spark):  # D8
    df = spark.range(200).withColumn("u", core.hash_uniform(F.col("id").cast("string"), "s"))
    a = sorted(tuple(r) for r in df.repartition(1).collect())
    b = sorted(tuple(r) for r in df.repartition(7).collect())
    assert a == b
    us = [r["u"] for r in df.collect()]
    assert 0 <= min(us) and max(us) < 1
    n = spark.range(4000).select(core.hash_normal(F.col("id").cast("string"), "n").alias("z")).agg(
        F.avg("z").alias("m"), F.stddev("z").alias("s")).collect()[0]
    assert abs(n["m"]) < 0.1 and abs(n["s"] - 1) < 0.1


def test_spearman_pairwise_complete_matches_pandas(spark):
    rows = [(1.0, 2.0, None), (2.0, 1.0, 3.0), (3.0, 4.0, 3.0), (4.0, 3.0, 1.0), (5.0, 5.0, 2.0), (2.0, None, 5.0)]
    df = _frame(spark, rows, "a double, b double, c double")
    got = {(r["variable_1"], r["variable_2"]): r["spearman"] for r in relate.spearman_pairs(df, ["a", "b", "c"]).collect()}
    exp = pd.DataFrame(rows, columns=["a", "b", "c"]).corr(method="spearman")
    for (x, y), v in got.items():
        assert v == pytest.approx(exp.loc[x, y])


def test_describe_matches_pandas(spark):
    rows = [(float(x),) for x in [1, 2, 2, 3, 7, 11, 11, 11]]
    d = profile.describe(_frame(spark, rows, "x double")).collect()[0]
    s = pd.Series([r[0] for r in rows])
    assert d["mean"] == pytest.approx(s.mean()) and d["std"] == pytest.approx(s.std())
    assert d["q25"] == pytest.approx(s.quantile(0.25)) and d["q75"] == pytest.approx(s.quantile(0.75))


def test_skew_kurtosis_bias_switch(spark):  # D4
    vals = [1.0, 2.0, 2.0, 3.0, 9.0, 4.0]
    a = profile.advanced_stats(_frame(spark, [(v,) for v in vals], "x double"), bias=False).collect()[0]
    s = pd.Series(vals)
    assert a["skewness"] == pytest.approx(s.skew()) and a["kurtosis"] == pytest.approx(s.kurt())


def test_no_python_eval_in_flagship_plan(spark):
    from tessera.plans.common import NUM, lineitem_nulls

    df = lineitem_nulls(spark, "/root/testdata/sf0.001")
    df = clean.scale_standard(clean.remove_outliers_iqr(clean.impute_mean(df, NUM), NUM), NUM)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan


def test_ranges_are_monotone_on_extremes(spark):
    vals = [-float("inf"), -1e308, -3.5, -1.0, -1e-310, 0.0, 1e-320, 2.0 ** -1020, 1e-300, 0.5, 1.0, 1.0000001,
            2.0, 7.99999, 8.0, 8.0000001, 1e10, 1e308, float("inf")]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    cuts = core.range_cuts(df, ["v"], 8)
    got = [r["v__range"] for r in core.with_ranges(df, cuts).collect()]
    assert got == sorted(got) and len(set(got)) > 4
    q = {r["pidx"]: r["q"] for r in core.exact_quantiles(
        spark.createDataFrame([(v,) for v in vals[1:-1]] + [(float("nan"),)], "v double"), ["v"], [0.5]).collect()}
    assert q[0] == float(np.percentile(vals[1:-1], 50))


def test_spearman_with_nulls_matches_pandas(spark):
    rows = [(1.0, 2.0, None), (2.0, 1.0, 3.0), (3.0, 4.0, 3.0), (4.0, 3.0, 1.0), (5.0, 5.0, 2.0), (2.0, None, 5.0)]
    df = _frame(spark, rows, "a double, b double, c double")
    got = {(r["variable_1"], r["variable_2"]): r["spearman"] for r in relate.spearman_pairs(df, ["a", "b", "c"]).collect()}
    exp = pd.DataFrame(rows, columns=["a", "b", "c"]).corr(method="spearman")
    assert len(got) == 3
    for (x, y), v in got.items():
        assert v == pytest.approx(exp.loc[x, y])


def test_spearman_of_complete_columns_matches_pandas(spark):
    rng = np.random.default_rng(3)
    cols = [f"c{i}" for i in range(9)]
    rows = [tuple(float(x) for x in rng.integers(0, 6, size=9)) for _ in range(60)]
    df = _frame(spark, rows, ", ".join(f"{c} double" for c in cols))
    got = {(r["variable_1"], r["variable_2"]): r["spearman"] for r in relate.spearman_pairs(df, cols).collect()}
    exp = pd.DataFrame(rows, columns=cols).corr(method="spearman")
    assert len(got) == 36
    for (x, y), v in got.items():
        assert v == pytest.approx(exp.loc[x, y])


def test_wide_pearson_is_pairwise_complete(spark):
    rng = np.random.default_rng(5)
    cols = [f"c{i}" for i in range(46)]
    data = rng.normal(size=(80, 46))
    data[10:, 45] = np.nan  # one column with few values must not cost the other pairs their rows
    exp = pd.DataFrame(data, columns=cols).corr()
    rows = [tuple(None if np.isnan(x) else float(x) for x in r) for r in data]
    df = _frame(spark, rows, ", ".join(f"{c} double" for c in cols))
    got = {(r["variable_1"], r["variable_2"]): r["pearson"] for r in relate.pearson_pairs(df, cols).collect()}
    assert len(got) == 46 * 45 // 2
    for (x, y), v in got.items():
        assert v == pytest.approx(exp.loc[x, y])


def test_label_codes_and_sparse_onehot(spark):
    df = _frame(spark, [(1, "b"), (2, "a"), (3, None), (4, "c"), (5, "b")], "k long, v string")
    assert {r["k"]: r["v_encoded"] for r in clean.encode_label(df, "v").collect()} == {1: 1, 2: 0, 3: None, 4: 2, 5: 1}
    sparse = {(r["k"], r["index"], r["value"]) for r in clean.encode_onehot_sparse(df, "k", "v").collect()}
    assert sparse == {(1, 0, "b"), (4, 1, "c"), (5, 0, "b")}
    assert clean.encode_label(df.where("k > 9"), "v").count() == 0


def test_checkpoint_folder_is_named_on_clusters():
    from types import SimpleNamespace

    from tessera.session import checkpoint_dir

    context = SimpleNamespace(master="spark://somewhere:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(session)


@pytest.mark.parametrize("name", ["impute_median", "outliers_iqr_joint", "describe", "correlation_table", "stratified_split",
                                  "partner_rows", "smote"])
def test_no_unpartitioned_window_over_rows(spark, name):
    """Order statistics and positions never run a window without a partition key."""
    import json

    import __spark_entry__ as E

    df = E.queries()[name](spark, "/root/testdata/sf0.001")
    nodes = json.loads(df._jdf.queryExecution().sparkPlan().toJSON())
    windows = [n for n in nodes if n.get("class", "").endswith("WindowExec")]
    assert all(len(n.get("partitionSpec", [])) > 0 for n in windows), name
    assert not any("EvalPython" in n.get("class", "") for n in nodes)


@pytest.mark.parametrize("accuracy,most", [(10_000, 2_000_000), (50, 40), (200, 3)])
def test_exact_quantiles_by_narrowed_ranges(spark, accuracy, most):
    """Coarse sketches, and ranges that are narrowed again and again, give the same positions."""
    rng = np.random.default_rng(5)
    n = 4000
    cols = {
        "uniform": rng.random(n), "narrow": 1.7e9 + rng.integers(0, 500_000, n), "ties": rng.integers(0, 3, n).astype(float),
        "hot": np.where(rng.random(n) < 0.7, 5.0, rng.normal(size=n)), "tails": rng.standard_cauchy(n), "same": np.full(n, 2.5),
    }
    pdf = pd.DataFrame(cols)
    pdf.loc[::13, "uniform"] = None
    df = spark.createDataFrame(pdf).withColumn("void", F.lit(None).cast("double")).repartition(4)
    probs = [0.0, 0.001, 0.25, 0.5, 0.501, 0.999, 1.0]
    got = {(r["column"], r["pidx"]): r["q"] for r in core.exact_quantiles(df, [*cols, "void"], probs, accuracy, most).collect()}
    assert len(got) == len(cols) * len(probs)
    for c in cols:
        for i, p in enumerate(probs):
            assert got[c, i] == pytest.approx(float(pdf[c].dropna().quantile(p)), rel=1e-12, abs=1e-12)


def test_ranges_hold_equal_shares(spark):
    """Epoch seconds of a few days are parted as well as any other column."""
    df = spark.range(20_000).select((F.lit(1_700_000_000) + F.col("id") * 26).cast("double").alias("t"))
    cuts = core.range_cuts(df, ["t"], 128)
    sizes = [r["count"] for r in core.with_ranges(df, cuts).groupBy("t__range").count().collect()]
    assert len(sizes) == 128 and max(sizes) < 2 * 20_000 / 128


def test_positions_of_equal_order_values(spark):
    """Rows of one order value have positions of their own (they repeated one, and partners with it)."""
    df = spark.createDataFrame([("a", i, 0.5 if i % 2 else 0.25) for i in range(40)] + [(None, i, 0.1) for i in range(7)], "g string, k long, u double")
    for uniform in (True, False):
        got = core.group_positions(df, ["g"], F.col("u"), ["k"], uniform).collect()
        for g, n in (("a", 40), (None, 7)):
            rows = sorted((r["u"], r["k"], r["__rn"], r["__n"]) for r in got if r["g"] == g)
            assert [r[2] for r in rows] == list(range(1, n + 1)) and {r[3] for r in rows} == {n}
