"""Plans for splits, folds, evaluation, training and topics."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import features, ml
from tessera.operators import text as X
from tessera.plans.common import round_doubles, sql_unit_hash
from tessera.plans.q_text import _sql_tfidf
from tessera.plans.registry import plan, table
from tessera.session import cut_lineage

_U_SQL = sql_unit_hash("doc_id::VARCHAR", "'split:42'")


def _labelled_docs(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", "quality", "toxic", "text", F.col("n_chars").cast("double").alias("n_chars"),
                    F.size(T.tokenize_whitespace("text")).cast("double").alias("words"))


@plan("stratified_split", (
    f"WITH p AS (SELECT d.doc_id, l.quality, row_number() OVER (PARTITION BY l.quality ORDER BY {_U_SQL.replace('doc_id', 'd.doc_id')}) AS rn, "
    "count(*) OVER (PARTITION BY l.quality) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id) "
    "SELECT doc_id, quality, CASE WHEN rn <= round(n * 0.7) THEN 'train' WHEN rn <= round(n * 0.85) THEN 'validation' ELSE 'test' END AS split FROM p"),
    ("M03", "W06"))
def q_split(spark, sf):
    d = _labelled_docs(spark, sf).select("doc_id", "quality")
    return ml.stratified_split(d, "quality", "doc_id", (0.7, 0.15, 0.15)).select("doc_id", "quality", "split")


@plan("stratified_kfold", (
    f"SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY {_U_SQL}) - 1) % 3)::INTEGER AS fold FROM labels"),
    ("M04",))
def q_kfold(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return ml.stratified_kfold(lab, "quality", "doc_id", 3).select("doc_id", "quality", "fold")


_PRED_SQL = ("SELECT d.doc_id, l.quality AS label, CASE WHEN d.n_chars > 20000 THEN 1 WHEN d.lang = 'de' THEN 2 ELSE 0 END AS prediction "
             "FROM documents d JOIN labels l ON d.doc_id = l.doc_id")


def _preds(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    p = F.when(F.col("n_chars") > 20000, 1).when(F.col("lang") == "de", 2).otherwise(0)
    return d.select("doc_id", F.col("quality").alias("label"), p.alias("prediction"))


_PER_CLASS_SQL = (
    f"WITH p AS ({_PRED_SQL}), conf AS (SELECT label AS actual, prediction AS predicted, count(*) AS cnt FROM p GROUP BY ALL), "
    "cls AS (SELECT actual AS c FROM conf UNION SELECT predicted FROM conf), "
    "s AS (SELECT c, coalesce((SELECT sum(cnt) FROM conf WHERE actual = c), 0) AS support, "
    "coalesce((SELECT sum(cnt) FROM conf WHERE predicted = c), 0) AS pc, coalesce((SELECT sum(cnt) FROM conf WHERE actual = c AND predicted = c), 0) AS tp FROM cls), "
    "m AS (SELECT c, CASE WHEN pc > 0 THEN tp / pc ELSE 0.0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc, support, tp FROM s), "
    "f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM m)"
)


@plan("evaluate_per_class", (
    _PER_CLASS_SQL + " SELECT c::INTEGER AS class, round(pr, 6) AS precision, round(rc, 6) AS recall, support::BIGINT AS support, "
    "round(f1, 6) AS f1 FROM f"), ("M07",))
def q_eval_class(spark, sf):
    per, _, _ = ml.evaluate(_preds(spark, sf))
    return round_doubles(per.select(F.col("class").cast("int"), "precision", "recall", "support", "f1"))


@plan("evaluate_summary", (
    _PER_CLASS_SQL + ", t AS (SELECT sum(support) AS n, sum(tp) AS correct, avg(pr) AS mp, avg(rc) AS mr, avg(f1) AS mf, "
    "sum(pr * support) AS wp, sum(rc * support) AS wr, sum(f1 * support) AS wf FROM f) "
    "SELECT 'accuracy' AS metric, round(correct / n, 6) AS value FROM t UNION ALL SELECT 'macro_precision', round(mp, 6) FROM t "
    "UNION ALL SELECT 'macro_recall', round(mr, 6) FROM t UNION ALL SELECT 'macro_f1', round(mf, 6) FROM t "
    "UNION ALL SELECT 'weighted_precision', round(wp / n, 6) FROM t UNION ALL SELECT 'weighted_recall', round(wr / n, 6) FROM t "
    "UNION ALL SELECT 'weighted_f1', round(wf / n, 6) FROM t"), ("M07",))
def q_eval_summary(spark, sf):
    _, summary, _ = ml.evaluate(_preds(spark, sf))
    return round_doubles(summary)


@plan("confusion_matrix", (
    f"SELECT label AS actual, prediction AS predicted, count(*)::BIGINT AS count FROM ({_PRED_SQL}) GROUP BY ALL"), ("M07",))
def q_confusion(spark, sf):
    _, _, conf = ml.evaluate(_preds(spark, sf))
    return conf


@plan("target_distribution", "SELECT quality AS value, count(*)::BIGINT AS count FROM labels GROUP BY 1 ORDER BY 2 DESC, 1", ("M02",))
def q_target_dist(spark, sf):
    from tessera.operators.profile import value_counts

    return value_counts(table(spark, sf, "labels"), "quality", None)


@plan("fuse_predictions", (
    "WITH a AS (SELECT doc_id, [1 - quality * 0.8::DOUBLE, quality * 0.8::DOUBLE] AS pa FROM labels), "
    "b AS (SELECT doc_id, [1 - toxic * 0.6::DOUBLE, toxic * 0.6::DOUBLE] AS pb FROM labels) "
    "SELECT a.doc_id, round(0.7 * pa[1] + 0.3 * pb[1], 6) AS p0, round(0.7 * pa[2] + 0.3 * pb[2], 6) AS p1, "
    "(CASE WHEN 0.7 * pa[2] + 0.3 * pb[2] > 0.7 * pa[1] + 0.3 * pb[1] THEN 1 ELSE 0 END)::INTEGER AS prediction "
    "FROM a JOIN b ON a.doc_id = b.doc_id"), ("M13",))
def q_fuse(spark, sf):
    lab = table(spark, sf, "labels")
    a = lab.select("doc_id", F.array(1 - F.col("quality") * 0.8, F.col("quality") * 0.8).alias("probability"))
    b = lab.select("doc_id", F.array(1 - F.col("toxic") * 0.6, F.col("toxic") * 0.6).alias("probability"))
    f = ml.fuse_predictions(a, b, "doc_id", 0.7)
    return round_doubles(f.select("doc_id", F.col("fused")[0].alias("p0"), F.col("fused")[1].alias("p1"), "prediction"))


def _separable(spark, sf):
    """embeddings with a learnable label: sign of the sum of the first 8 coordinates."""
    e = table(spark, sf, "embeddings")
    s = F.aggregate(F.slice("embedding", 1, 8), F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    cols = {f"x{i}": F.col("embedding")[i].cast("double") for i in range(64)}
    return e.select("vec_id", *[v.alias(k) for k, v in cols.items()], (s > 0).cast("int").alias("label"))


@plan("train_logistic_regression", None, ("M01", "M05", "M11"))
def q_train_lr(spark, sf):
    """LR with a 3-fold CV over C on a separable embedding label; test-split metrics (R: accuracy > majority)."""
    d = _separable(spark, sf)
    feats = [f"x{i}" for i in range(64)]
    sp = cut_lineage(ml.stratified_split(d, "label", "vec_id", (0.8, 0.2), ("train", "test")))
    train, test = sp.where("split = 'train'"), sp.where("split = 'test'")
    model = ml.train_classifier(train, "label", feats, model="logistic", folds=3, grid={"regParam": [0.0, 0.01, 0.1]},
                                key="vec_id")
    _, summary, _ = ml.evaluate(model.transform(test).withColumn("prediction", F.col("prediction").cast("int")), "label")
    return round_doubles(summary)


@plan("train_random_forest", None, ("M06",))
def q_train_rf(spark, sf):
    """Random forest on the separable label; test-split metrics (R)."""
    d = _separable(spark, sf)
    feats = [f"x{i}" for i in range(64)]
    sp = cut_lineage(ml.stratified_split(d, "label", "vec_id", (0.8, 0.2), ("train", "test")))
    model = ml.train_classifier(sp.where("split = 'train'"), "label", feats, model="random_forest", folds=0, n_estimators=30, max_depth=6)
    _, summary, _ = ml.evaluate(model.transform(sp.where("split = 'test'")).withColumn("prediction", F.col("prediction").cast("int")), "label")
    return round_doubles(summary)


@plan("tune_boosted_trees", None, ("M09", "D15"))
def q_tune_gbt(spark, sf):
    """GBT tuned by validation log-loss over a 2 x 2 grid (R: one score per grid point)."""
    d = _separable(spark, sf)
    feats = [f"x{i}" for i in range(64)]
    _, scores = ml.tune_boosted(d.select("vec_id", *feats, "label"), "label", feats, "vec_id",
                                grid={"maxDepth": [2, 4], "stepSize": [0.1, 0.3]}, max_iter=10)
    return round_doubles(scores)


@plan("train_gradient_boosting", None, ("M08",))
def q_train_gbt(spark, sf):
    """Gradient-boosted trees on the separable label; test-split metrics (R)."""
    d = _separable(spark, sf)
    feats = [f"x{i}" for i in range(64)]
    sp = cut_lineage(ml.stratified_split(d, "label", "vec_id", (0.8, 0.2), ("train", "test")))
    model = ml.train_classifier(sp.where("split = 'train'"), "label", feats, model="gbt", folds=0, n_estimators=20, max_depth=3)
    _, summary, _ = ml.evaluate(model.transform(sp.where("split = 'test'")).withColumn("prediction", F.col("prediction").cast("int")), "label")
    return round_doubles(summary)


@plan("topic_lda", None, ("X21",))
def q_lda(spark, sf):
    """LDA topics over documents (R: k topics x 10 words, weights in (0, 1))."""
    return round_doubles(ml.topic_lda(table(spark, sf, "documents"), "text", k=5, words=10))


@plan("topic_nmf", None, ("X22",))
def q_nmf(spark, sf):
    """NMF topics on TF-IDF of the documents, all terms (R: non-negative weights)."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    v = X.tfidf_long(d, "doc_id", "text", (1, 1), 2, 0.95, None)
    return round_doubles(ml.topic_nmf(v, "doc_id", k=3, words=8))


@plan("feature_pipeline_text", _sql_tfidf(max_features=1000), ("M01", "X20"))
def q_features(spark, sf):
    """The fitted text features, out of the feature vector: a weight for each document and term."""
    d = table(spark, sf, "documents").select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars"))
    model = features.PreparedFeatures(["n_chars"], ["text"], max_features=1000).fit(d)
    terms = F.array(*[F.lit(t) for t in features.vocabularies(model)[0]])
    cells = model.transform(d).select("doc_id", F.posexplode(vector_to_array("features")).alias("i", "tfidf"))
    return round_doubles(cells.where("i > 0 AND tfidf > 0").select("doc_id", F.get(terms, F.col("i") - 1).alias("term"), "tfidf"))


@plan("feature_pipeline_numeric", (
    "WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS x, c_nationkey::DOUBLE AS y FROM customer), "
    "f AS (SELECT c_custkey, coalesce(x, (SELECT median(x) FROM d)) AS x, y FROM d) "
    "SELECT c_custkey, round((x - (SELECT avg(x) FROM f)) / (SELECT stddev_pop(x) FROM f), 6) AS x, "
    "round((y - (SELECT avg(y) FROM f)) / (SELECT stddev_pop(y) FROM f), 6) AS y FROM f"), ("M01", "D2", "D19"))
def q_features_numeric(spark, sf):
    """Median imputation and scaling with ddof 0, out of the feature vector."""
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    out = features.PreparedFeatures(["x", "y"]).fit(c).transform(c).select("c_custkey", vector_to_array("features").alias("f"))
    return round_doubles(out.select("c_custkey", F.col("f")[0].alias("x"), F.col("f")[1].alias("y")))


@plan("gbt_early_stop", None, ("M08", "M10"))
def q_early_stop(spark, sf):
    """The validation loss of every boosting round, which rounds are used, and the trees of the model
    (R: trees = used rounds; the stop follows from the curve)."""
    names = [f"x{i}" for i in range(64)]
    model, curve = features.boost_with_early_stop(_separable(spark, sf), "label", names, "vec_id", maxDepth=3)
    return round_doubles(curve.withColumn("trees_used", F.lit(model.stages[-1].getNumTrees)))


@plan("feature_importance", None, ("M06", "M10"))
def q_importance(spark, sf):
    """The ten features that a random forest of 100 trees uses most (R: the label's own come first)."""
    names = [f"x{i}" for i in range(64)]
    model = ml.train_classifier(_separable(spark, sf), "label", names, model="random_forest", folds=0)
    return round_doubles(ml.feature_importance(model, names, 10, spark))


@plan("metrics_record", None, ("M12", "M05"))
def q_metrics_record(spark, sf):
    """The record of a cross-validated logistic regression: best parameters and test metrics."""
    names = [f"x{i}" for i in range(64)]
    dealt = cut_lineage(ml.stratified_split(_separable(spark, sf), "label", "vec_id", (0.8, 0.2), ("train", "test")))
    model = ml.train_classifier(dealt.where("split = 'train'"), "label", names, model="logistic", folds=3, grid={"regParam": [0.0, 0.01, 0.1]}, key="vec_id")
    _, summary, _ = ml.evaluate(model.transform(dealt.where("split = 'test'")).withColumn("prediction", F.col("prediction").cast("int")), "label")
    best = {p.name: v for p, v in model.stages[-1].extractParamMap().items() if p.name in ("regParam", "elasticNetParam", "maxIter")}
    return features.metrics_record("Logistic Regression", best, summary, "1970-01-01T00:00:00")
