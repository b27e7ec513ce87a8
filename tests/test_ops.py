"""Text, augmentation, catalog, ML and streaming operators: hand cases and invariants,
plus a DuckDB oracle run of a subset of the registered plans on sf0.001."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import augment as G
from tessera.operators import catalog as K
from tessera.operators import ml
from tessera.operators import text as X

SF = "/root/testdata/sf0.001"


def test_clean_and_tokenize(spark):
    df = spark.createDataFrame([(1, "  Héllo,   WORLD!! <b>x</b> don't 42 "), (2, None)], "id int, t string")
    r = df.select(T.clean_basic("t").alias("b"), T.clean_advanced("t").alias("a"),
                  T.tokenize_words("t").alias("w"), T.word_count("t").alias("n")).collect()
    assert r[0]["b"] == "héllo, world!! bxb dont 42"
    assert r[0]["a"] == "héllo world bxb dont"
    assert r[0]["w"] == ["Héllo", ",", "WORLD", "!", "!", "<", "b", ">", "x", "<", "/", "b", ">", "don't", "42"]
    assert r[0]["n"] == 5 and r[1]["n"] == 0 and r[1]["b"] == ""


def test_detokenize_and_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", ",", "c", "."],), (["x"],)], "t array<string>")
    r = df.select(T.detokenize("t").alias("d"), T.safe_ngrams(F.col("t"), 2).alias("g")).collect()
    assert r[0]["d"] == "a b, c." and r[0]["g"] == ["a b", "b ,", ", c", "c ."] and r[1]["g"] == []


def test_sentiment_negation_and_intensifier(spark):
    df = spark.createDataFrame([(1, "good"), (2, "not good"), (3, "very good"), (4, "nothing here")], "id int, t string")
    r = {x["id"]: x["polarity"] for x in X.sentiment(df, "t").collect()}
    assert r[1] == pytest.approx(0.7) and r[2] == pytest.approx(-0.35) and r[3] == pytest.approx(0.91) and r[4] == 0.0


def test_language_detection(spark):
    df = spark.createDataFrame([(1, "the cat and the dog"), (2, "le chat et le chien"), (3, "xyz")], "id int, t string")
    r = {x["id"]: x["detected_lang"] for x in X.detect_language(df, "t").collect()}
    assert r == {1: "en", 2: "fr", 3: "unknown"}


def test_text_augment_invariants(spark):
    df = spark.createDataFrame([(i, f"the quick brown fox {i} jumps over good dogs") for i in range(20)], "id int, t string")
    d = G.random_deletion(df, "id", "t").collect()
    s = G.random_swap(df, "id", "t").collect()
    for row in d:
        assert len(row["t_augmented"].split()) == len(row["t"].split()) - 1
    for row in s:
        assert sorted(row["t_augmented"].split()) == sorted(row["t"].split())
    again = G.random_swap(df.repartition(3), "id", "t").collect()
    assert sorted(tuple(r) for r in s) == sorted(tuple(r) for r in again)


def test_smote_balances_classes_on_segments(spark):
    rows = [(str(i), 0, float(i), float(2 * i)) for i in range(30)] + [(f"m{i}", 1, float(100 + i), float(5 * i)) for i in range(6)]
    df = spark.createDataFrame(rows, "k string, y int, a double, b double")
    out = G.smote(df, "k", "y", ["a", "b"], k=3)
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {0: 30, 1: 30}
    syn = out.where("synthetic").collect()
    assert len(syn) == 24
    for r in syn:
        assert 100.0 <= r["a"] <= 105.0 and 0.0 <= r["b"] <= 25.0


def test_noise_rows_copies(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 1.0).alias("x"))
    out = G.noise_rows(df, "k", ["x"], 0.1, 3)
    assert out.count() == 400
    orig = out.where("copy = 0").select("k", "x").collect()
    assert all(r["x"] == r["k"] for r in orig)


def test_lineage_pointer_jumping(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, None), (7, 6)]
    df = spark.createDataFrame(rows, "id int, input_artifact_id int")
    got = {r["id"]: (r["root_id"], r["depth"]) for r in K.lineage(df).collect()}
    assert got[5] == (1, 4) and got[1] == (1, 0) and got[7] == (6, 1)


def test_split_and_folds_exact_shares(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    sp = ml.stratified_split(df, "y", "k", (0.7, 0.15, 0.15))
    c = {(r["y"], r["split"]): r["count"] for r in sp.groupBy("y", "split").count().collect()}
    assert c[(1, "train")] == round(334 * 0.7) and c[(0, "train")] == round(666 * 0.7)
    f = ml.stratified_kfold(df, "y", "k", 3)
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert sizes[-1] - sizes[0] <= 2


def test_splits_keep_rows_without_label_and_part_equal_hashes(spark):
    df = spark.range(30).select(F.col("id").alias("k"), F.when(F.col("id") % 3 != 0, F.lit("y")).alias("y"))
    assert ml.stratified_kfold(df, "y", "k", 2).count() == 30
    twins = spark.createDataFrame([("same", "y")] * 10, "k string, y string")
    assert sorted(r["count"] for r in ml.stratified_kfold(twins, "y", "k", 2).groupBy("fold").count().collect()) == [5, 5]


def test_cross_validation_needs_a_row_key(spark):
    df = spark.range(30).select("id", F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    with pytest.raises(ValueError, match="row key"):
        ml.train_classifier(df, "y", ["x"], folds=3, grid={"regParam": [0.0]})


def test_smote_lowers_k_to_the_smallest_class_for_all(spark):
    # class b could have two neighbours each, class c only one: k is 1 for both
    rows = [(f"a{i}", "a", float(i)) for i in range(20)] + [(f"b{i}", "b", 100.0 + x) for i, x in enumerate((0, 1, 10))]
    rows += [("c0", "c", 1000.0), ("c1", "c", 1001.0)]
    out = G.smote(spark.createDataFrame(rows, "k string, y string, x double"), "k", "y", ["x"], k=5)
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {"a": 20, "b": 20, "c": 20}
    made = [r["x"] for r in out.where("synthetic AND y = 'b'").collect()]
    assert all(100 <= x <= 110 for x in made)
    # with its nearest neighbour only, 100 and 101 never mix with 110; 110 mixes with 101 alone
    near = G.knn_within_class(spark.createDataFrame(rows, "k string, y string, x double").withColumn("v", F.array("x")), "k", "y", "v", 1)
    assert {r["key"]: r["neighbour"] for r in near.where("key LIKE 'b%'").collect()} == {"b0": "b1", "b1": "b0", "b2": "b1"}


def test_pipeline_status_of_datasets_with_nothing_completed(spark):
    df = spark.createDataFrame([("d1", "upload", "completed"), ("d1", "clean", "failed"), ("d2", "upload", "failed")],
                               "dataset_id string, stage string, status string")
    got = {r["dataset_id"]: (r["completed_stages"], r["progress"]) for r in K.pipeline_status(df).collect()}
    assert got == {"d1": (["upload"], 20.0), "d2": ([], 0.0)}


def test_evaluate_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)], "label int, prediction int")
    per, summ, conf = ml.evaluate(df)
    s = {r["metric"]: r["value"] for r in summ.collect()}
    assert s["accuracy"] == pytest.approx(0.6)
    p = {r["class"]: r for r in per.collect()}
    assert p[2]["precision"] == 0.0 and p[2]["recall"] == 0.0 and p[1]["recall"] == 1.0


def test_streaming_stateless(spark):
    from tessera.streaming.stateless import clean_text_stream, read_parquet_stream

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stream = read_parquet_stream(spark, SF, docs, glob="documents.parquet")
    q = clean_text_stream(stream, "doc_id", "text").writeStream.format("memory").queryName("clean_stream").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT count(*) AS n FROM clean_stream").collect()[0]["n"] == docs.count()


ORACLE_SUBSET = [
    "prep_walk_correlation", "impute_median", "outliers_iqr_joint", "describe", "histogram", "word_frequency",
    "bigram_frequency", "sentiment", "tfidf", "noise_rows", "smote", "latest_artifact", "lineage", "stratified_split",
    "asof_alignment", "color_histograms",
]


@pytest.mark.parametrize("name", ORACLE_SUBSET)
def test_plan_matches_duckdb_oracle(spark, name):
    import __spark_entry__ as E
    from tools.oracle_check import TABLES, rows_of

    df = E.queries()[name](spark, SF)
    srows, scols = [tuple(r) for r in df.collect()], df.columns
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(scols) == sorted(dcols)
    assert rows_of(scols, srows) == rows_of(dcols, cur.fetchall())


def test_entry_runs(spark):
    import __spark_entry__ as E

    out = E.entry(spark)
    assert out.count() >= 0 and "pearson_correlation" in out.columns


def test_every_plan_has_ids():
    import __spark_entry__ as E
    from tessera.plans.registry import load_all

    plans = load_all()
    found = E.queries()
    assert set(plans) <= set(found) and all(p.ids for p in plans.values())
    assert all(name == "pipeline" or name.startswith("op") for name in set(found) - set(plans))
    assert set(E.oracle_sql()) <= set(E.queries())


def test_asof_join_across_empty_buckets(spark):
    from tessera.operators.relational import asof_join

    left = spark.createDataFrame([(1, "a", 5), (2, "a", 25), (3, "a", 47), (4, "b", 3), (5, "a", 30)], "id int, k string, t long") \
        .selectExpr("id", "k", "timestamp_seconds(t) AS ts")
    right = spark.createDataFrame([("a", 2, 10.0), ("a", 21, 20.0), ("a", 26, 30.0), ("b", 9, 99.0)], "k string, t long, v double") \
        .selectExpr("k", "timestamp_seconds(t) AS ts", "v")
    out = {r["id"]: r["right_v"] for r in asof_join(left, right, "k", "ts", "ts", None, ["v"], bucket_seconds=10).collect()}
    assert out == {1: 10.0, 2: 20.0, 3: 30.0, 4: None, 5: 30.0}


def test_bucketed_ffill_and_movement_match_unbucketed(spark):
    from tessera.operators.clean import impute_ffill
    from tessera.operators.relational import movement_label

    rows = [(i, "a" if i % 3 else "b", i * 7, None if i % 4 == 0 else float((i * 37) % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, g string, t long, v double")
    a = sorted(tuple(r) for r in impute_ffill(df, ["t", "id"], ["v"], ["g"]).collect())
    b = sorted(tuple(r) for r in impute_ffill(df, ["t", "id"], ["v"], ["g"], bucket=25).collect())
    assert a == b
    c = sorted(tuple(r) for r in movement_label(df.na.drop(), "v", ["t", "id"], ["g"]).collect())
    d = sorted(tuple(r) for r in movement_label(df.na.drop(), "v", ["t", "id"], ["g"], bucket=25).collect())
    assert c == d


def test_lineage_missing_parent_and_cycle(spark):
    import pytest

    from tessera.operators.catalog import lineage

    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 4)], "id long, input_artifact_id long")
    assert sorted(tuple(r) for r in lineage(nodes).collect()) == [(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 99, 1), (5, 99, 2)]
    with pytest.raises(ValueError):
        lineage(spark.createDataFrame([(1, 2), (2, 1), (3, None)], "id long, input_artifact_id long"))


def test_augmentation_quality_signed(spark):
    from tessera.operators.profile import augmentation_quality

    a = spark.createDataFrame([(1, 2.0, -1.0), (2, 4.0, 1.0)], "k long, x double, z double")
    b = spark.createDataFrame([(1, 1.0, 0.0), (2, 2.0, 3.0)], "k long, x double, z double")
    got = {r["column"]: r for r in augmentation_quality(a, b, "k", ["x", "z"]).collect()}
    assert (got["x"]["mean_change_pct"], got["z"]["mean_change_pct"]) == (-50.0, 0.0)


def test_topic_plans_read_all(spark, monkeypatch):
    """The topic plans take all documents, all terms and the operators' own number of rounds."""
    from tessera.plans.registry import load_all

    seen = {}
    monkeypatch.setattr(ml, "topic_nmf", lambda v, key, **kw: seen.update(v=v, nmf=kw) or v)
    monkeypatch.setattr(ml, "topic_lda", lambda d, col, **kw: seen.update(d=d, lda=kw) or d)
    for name in ("topic_nmf", "topic_lda"):
        load_all()[name].fn(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert seen["v"].count() == X.tfidf_long(docs, "doc_id", "text", (1, 1), 2, 0.95).count()
    assert seen["d"].count() == docs.count() and "iters" not in seen["nmf"] and "max_iter" not in seen["lda"]


def test_nmf_top_words(spark):
    """Top words by parts are those of one ranking."""
    rows = [(d, f"t{(7 * d + k * k) % 90}", 1.0 + (d * k) % 5) for d in range(40) for k in range(12)]
    v = spark.createDataFrame(rows, "d long, term string, tfidf double").dropDuplicates(["d", "term"])
    whole = {(r["topic"], r["rank"]): r["term"] for r in ml.topic_nmf(v, "d", k=2, iters=1, words=1000).collect()}
    few = {(r["topic"], r["rank"]): r["term"] for r in ml.topic_nmf(v, "d", k=2, iters=1, words=5).collect()}
    assert few == {k: t for k, t in whole.items() if k[1] <= 5} and len(few) == 10


def test_plans_use_whole_rows(spark):
    """The tokenization plan returns all of its tokenisations, the training data all 64 coordinates."""
    from tessera.plans.q_ml import _separable
    from tessera.plans.registry import load_all

    out = load_all()["tokenization_pipeline"].fn(spark, SF)
    assert {"advanced_clean", "tweet_tokens", "pos_tags"} <= set(out.columns) and len(out.limit(3).collect()) == 3
    assert {f"x{i}" for i in range(64)} <= set(_separable(spark, SF).columns)
