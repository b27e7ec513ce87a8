"""Fitted features and early stopping."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.operators import features as FE


def test_saved_and_loaded(spark, tmp_path):
    rows = [(1, 1.0, 5.0, "red apple pie"), (2, None, 5.0, "green apple pie"), (3, 4.0, None, None), (4, float("nan"), 5.0, ""), (5, 10.0, 5.0, "red apple apple")]
    df = spark.createDataFrame(rows, "k long, a double, b double, t string")
    model = FE.PreparedFeatures(["a", "b"], ["t"], max_df=1.0).fit(df)
    out = model.transform(df)
    assert out.columns == ["k", "a", "b", "t", "features"]
    assert FE.vocabularies(model) == [["apple", "apple pie", "pie", "red", "red apple"]]
    vec = {r["k"]: r["v"] for r in out.select("k", vector_to_array("features").alias("v")).collect()}
    filled = [1.0, 4.0, 4.0, 4.0, 10.0]  # the exact median
    mean = sum(filled) / 5
    std = (sum((x - mean) ** 2 for x in filled) / 5) ** 0.5
    assert [vec[k][0] for k in range(1, 6)] == pytest.approx([(x - mean) / std for x in filled])
    assert all(vec[k][1] == 0.0 for k in vec) and vec[3][2:] == [0.0] * 5 == vec[4][2:]
    assert all(sum(x * x for x in vec[k][2:]) == pytest.approx(1.0) for k in (1, 2, 5))
    path = str(tmp_path / "model")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path).transform(df)
    assert {r["k"]: r["v"] for r in again.select("k", vector_to_array("features").alias("v")).collect()} == vec
    assert model.transform(df.limit(0)).count() == 0
    nothing = FE.PreparedFeatures([], ["t"]).fit(df.where("k = 3")).transform(df)
    assert nothing.select(F.max(F.array_max(vector_to_array("features")))).first()[0] == 0.0


def test_stop_round():
    assert FE.stop_round([1.0, 0.9, 0.8], 2, 0.0) is None
    assert FE.stop_round([1.0, 0.9, 0.9, 0.9, 0.1], 2, 1e-4) == 4  # no better than both before
    assert FE.stop_round([1.0, 0.5, 0.6, 0.55], 2, 1e-4) is None  # better than one of them
    assert FE.stop_round([0.5, 0.6, 0.7, 0.1], 2, 1e-4) == 3
    assert FE.stop_round([], 2) is None


def test_early_stop(spark):
    df = spark.range(400).select("id", *[F.sin(F.col("id") * (i + 3.7)).alias(f"x{i}") for i in range(4)])
    noisy = (F.col("x0") + 0.9 * F.sin(F.col("id") * 77.7) > 0).cast("int")
    model, curve = FE.boost_with_early_stop(df.withColumn("label", noisy), "label", [f"x{i}" for i in range(4)], "id", max_rounds=60, patience=5, maxDepth=3)
    rows = sorted((r["round"], r["loss"], r["used"]) for r in curve.collect())
    used = FE.stop_round([r[1] for r in rows], 5, 1e-4) or 60
    assert [r[0] for r in rows if r[2]] == list(range(1, used + 1)) and model.stages[-1].getNumTrees == used
    assert "prediction" in model.transform(df).columns
