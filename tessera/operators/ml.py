"""Model training and evaluation (M01-M13, X21, X22) on pyspark.ml.

Splits and folds are exact per-class shares computed from bucketed prefix counts of a
key hash (no per-class sort in one task); evaluation is a grouped confusion table;
training uses pyspark.ml estimators and CrossValidator with an explicit fold column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import core


def _hash_u(key: Sequence[str] | str, seed: int) -> F.Column:
    keys = [key] if isinstance(key, str) else list(key)
    return core.hash_uniform(core.key_string(*keys), F.lit(f"split:{seed}"))


def class_positions(df: DataFrame, label: str, key: str | Sequence[str], seed: int = 42) -> DataFrame:
    """Adds ``__rn`` (1-based position of the row inside its class in hash order) and ``__n``
    (class size); rows of one hash follow in order of the key, and rows without a label are a class
    of their own.  A class is parted into ranges of the hash (core.group_positions)."""
    keys = [key] if isinstance(key, str) else list(key)
    return core.group_positions(df, [label], _hash_u(key, seed), keys)


def stratified_split(df: DataFrame, label: str, key: str | Sequence[str], fractions: Sequence[float] = (0.7, 0.15, 0.15),
                     names: Sequence[str] = ("train", "validation", "test"), seed: int = 42) -> DataFrame:
    """Adds ``split``: inside each class, rows in hash order; the first round(f1 * n)
    are the first split, up to round((f1 + f2) * n) the second, the rest the last."""
    d = class_positions(df, label, key, seed)
    cum, expr = 0.0, None
    for frac, name in zip(fractions[:-1], names[:-1]):
        cum += frac
        cond = F.col("__rn") <= F.round(F.col("__n") * F.lit(cum))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    expr = expr.otherwise(F.lit(names[-1]))
    return d.withColumn("split", expr).drop("__rn", "__n")


def stratified_kfold(df: DataFrame, label: str, key: str | Sequence[str], k: int = 3, seed: int = 42) -> DataFrame:
    """Adds ``fold`` = (position in class - 1) % k (hash order, seed 42)."""
    d = class_positions(df, label, key, seed)
    return d.withColumn("fold", ((F.col("__rn") - 1) % F.lit(k)).cast("int")).drop("__rn", "__n")


def evaluate(pred: DataFrame, label: str = "label", prediction: str = "prediction"):
    """(per_class, summary, confusion).

    per_class: class, precision, recall, f1, support (zero division -> 0);
    summary: metric, value for accuracy, macro and weighted precision / recall / f1;
    confusion: actual, predicted, count (all sorted label pairs that occur).
    """
    conf = pred.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(
        F.count(F.lit(1)).alias("count"))
    tp = conf.where(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("class"), F.col("count").alias("tp"))
    sup = conf.groupBy(F.col("actual").alias("class")).agg(F.sum("count").alias("support"))
    pc = conf.groupBy(F.col("predicted").alias("class")).agg(F.sum("count").alias("predicted_count"))
    classes = sup.select("class").unionByName(pc.select("class")).distinct()
    per = classes.join(sup, "class", "left").join(pc, "class", "left").join(tp, "class", "left").fillna(0, ["support", "predicted_count", "tp"])
    prec = F.when(F.col("predicted_count") > 0, F.col("tp") / F.col("predicted_count")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.select("class", prec.alias("precision"), rec.alias("recall"), "support", "tp")
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("correct"), F.count(F.lit(1)).alias("k"),
                  F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"), F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"))
    metrics = [("accuracy", F.col("correct") / F.col("n")), ("macro_precision", F.col("macro_precision")),
               ("macro_recall", F.col("macro_recall")), ("macro_f1", F.col("macro_f1")),
               ("weighted_precision", F.col("wp") / F.col("n")), ("weighted_recall", F.col("wr") / F.col("n")),
               ("weighted_f1", F.col("wf") / F.col("n"))]
    summary = tot.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"))
                                                 for m, v in metrics])).alias("r")).select("r.*")
    return per.drop("tp"), summary, conf


def feature_pipeline(numeric: Sequence[str], text: Sequence[str] = (), impute: str = "mean", max_features: int = 10_000):
    """Numeric columns filled and standardised, text as TF-IDF weights of 1- and 2-grams over
    a real vocabulary, in one vector ``features``.  Fitted on the training rows only (D16)."""
    from pyspark.ml import Pipeline

    from tessera.operators.features import PreparedFeatures

    return Pipeline(stages=[PreparedFeatures(numeric, text, impute, max_features=max_features)])


def train_classifier(train: DataFrame, label: str, numeric: Sequence[str], text: Sequence[str] = (),
                     model: str = "logistic", folds: int = 3, grid: dict | None = None, parallelism: int = 4, key: str | None = None, **params):
    """Feature pipeline + classifier; with ``folds`` > 1 a CrossValidator over
    ``grid`` on a stratified fold column (M04; ``key`` names the row key that deals the folds), metric weighted F1.  Returns the fitted
    PipelineModel (best model when cross-validated)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    fp = feature_pipeline(numeric, text)
    if model == "logistic":
        est = LogisticRegression(featuresCol="features", labelCol=label, maxIter=params.get("max_iter", 100),
                                 regParam=params.get("reg", 0.0), elasticNetParam=params.get("l1_ratio", 0.0))
    elif model == "random_forest":
        est = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=params.get("n_estimators", 100),
                                     maxDepth=min(params.get("max_depth", 10), 30), seed=42,
                                     minInstancesPerNode=max(params.get("min_samples_leaf", 1), -(-params.get("min_samples_split", 2) // 2)))
    elif model == "gbt":
        base = GBTClassifier(featuresCol="features", labelCol=label, maxIter=params.get("n_estimators", 50),
                             stepSize=params.get("learning_rate", 0.1), maxDepth=params.get("max_depth", 3),
                             subsamplingRate=params.get("subsample", 1.0), seed=42)
        est = OneVsRest(classifier=base, featuresCol="features", labelCol=label) if params.get("multiclass") else base
    else:
        raise ValueError(f"unknown model {model!r}")
    pipe = Pipeline(stages=fp.getStages() + [est])
    if folds and folds > 1 and grid:
        pg = ParamGridBuilder()
        for name, values in grid.items():
            pg = pg.addGrid(est.getParam(name), values)
        ev = MulticlassClassificationEvaluator(labelCol=label, metricName="f1")
        from tessera.session import cut_lineage

        if key is None or key == label:
            raise ValueError("cross-validation needs the row key that deals the folds")
        # every (fold, grid point) fit re-reads the data: materialise the fold assignment once
        data = cut_lineage(stratified_kfold(train, label, key, folds))
        cv = CrossValidator(estimator=pipe, estimatorParamMaps=pg.build(), evaluator=ev, foldCol="fold",
                            parallelism=parallelism, seed=42)
        return cv.fit(data).bestModel
    return pipe.fit(train)


def tune_boosted(train: DataFrame, label: str, numeric: Sequence[str], key: str, grid: dict | None = None,
                 validation: float = 0.2, max_iter: int = 50, seed: int = 42):
    """M09 (D15): gradient-boosted trees tuned on a stratified validation split by log-loss
    (smaller is better) over the whole grid of depth x step x subsample x feature share;
    the best setting is refitted on all training rows.  Returns (model, table of grid scores)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    from tessera.session import cut_lineage

    grid = grid or {"maxDepth": [3, 5], "stepSize": [0.1, 0.3], "subsamplingRate": [0.8, 1.0], "featureSubsetStrategy": ["all", "sqrt"]}
    sp = cut_lineage(stratified_split(train, label, key, (1 - validation, validation), ("fit", "val"), seed))
    fit, val = sp.where("split = 'fit'"), sp.where("split = 'val'")
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="logLoss")
    import itertools

    names = list(grid)
    scores = []
    for combo in itertools.product(*[grid[n] for n in names]):
        params = dict(zip(names, combo))
        est = GBTClassifier(featuresCol="features", labelCol=label, maxIter=max_iter, seed=seed, **params)
        pm = Pipeline(stages=feature_pipeline(numeric).getStages() + [est]).fit(fit)
        scores.append((ev.evaluate(pm.transform(val)), params))
    best = min(scores, key=lambda x: x[0])
    est = GBTClassifier(featuresCol="features", labelCol=label, maxIter=max_iter, seed=seed, **best[1])
    model = Pipeline(stages=feature_pipeline(numeric).getStages() + [est]).fit(train)
    rows = [(str(sorted(p.items())), float(sc)) for sc, p in scores]
    return model, core.lit_table(train.sparkSession, rows, "params string, log_loss double")


def feature_importance(pipeline_model, feature_names: Sequence[str], top: int = 10, spark=None):
    """(feature, importance) of a tree model, descending."""
    m = pipeline_model.stages[-1]
    imp = m.featureImportances.toArray()
    rows = sorted(((feature_names[i] if i < len(feature_names) else f"f{i}", float(v)) for i, v in enumerate(imp)),
                  key=lambda x: (-x[1], x[0]))[:top]
    return core.lit_table(spark, rows, "feature string, importance double")


def fuse_predictions(a: DataFrame, b: DataFrame, key: str, weight: float = 0.5, prob: str = "probability") -> DataFrame:
    """M13 late fusion: join two prediction sets on the key, weighted mean of probability
    arrays (zip_with), predicted class = argmax."""
    j = a.select(key, F.col(prob).alias("__pa")).join(b.select(key, F.col(prob).alias("__pb")), key)
    fused = F.zip_with("__pa", "__pb", lambda x, y: F.lit(weight) * x + F.lit(1 - weight) * y)
    j = j.withColumn("fused", fused)
    best = F.array_position(F.col("fused"), F.array_max("fused")) - 1
    return j.select(key, "fused", best.cast("int").alias("prediction"))


def vote(preds: DataFrame, key: str, prediction: str = "prediction") -> DataFrame:
    """M13 voting: most frequent prediction per key, smallest class on ties."""
    c = preds.groupBy(key, prediction).agg(F.count(F.lit(1)).alias("votes"))
    return c.groupBy(key).agg(F.min_by(prediction, F.struct(-F.col("votes"), F.col(prediction))).alias("prediction"))


def topic_lda(df: DataFrame, text_col: str, k: int = 5, words: int = 10, max_iter: int = 20):
    """LDA topics (topic, rank, term, weight) on term counts of the frequency tokens, with
    every term that two documents or more hold.

    The counts are held in no more parts than there are cores, as an iteration sums a matrix of all
    terms for each part."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    from tessera.operators.text import frequency_tokens

    toks = df.select(frequency_tokens(F.col(text_col)).alias("tokens"))
    cv = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=2**31 - 1, minDF=2).fit(toks)
    counts = cv.transform(toks)
    model = LDA(k=k, maxIter=max_iter, seed=42, featuresCol="features").fit(counts.coalesce(df.sparkSession.sparkContext.defaultParallelism))
    topics = model.describeTopics(words)
    vocab = cv.vocabulary
    spark = df.sparkSession
    # at most k * words terms are named
    named = sorted({i for row in topics.select("termIndices").collect() for i in row[0]})
    names = core.lit_table(spark, [(i, vocab[i]) for i in named], "term_index int, term string")
    ex = topics.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "tw")).select(
        "topic", "rank", F.col("tw.termIndices").alias("term_index"), F.col("tw.termWeights").alias("weight"))
    return ex.join(F.broadcast(names), "term_index").drop("term_index")


#: Cells of V that a task of the NMF holds, and of a block if there are no more blocks than cores.
NMF_CELLS, NMF_LEAST_CELLS = 1 << 21, 1 << 16


def topic_nmf(tfidf_long: DataFrame, key: str, k: int = 5, iters: int = 30, words: int = 10, seed: int = 42) -> DataFrame:
    """NMF of the long (key, term, tfidf) matrix V ~ W H by multiplicative updates.
    W (doc x k) and H (k x term) hold k numbers a document and term; the k x k Gram matrices are tiny.
    Returns (topic, rank, term, weight).

    V is dealt by document into blocks once and stays there.  An update sends a block the rows of H of the
    terms that it holds, and takes from it its documents' rows of W and its part of each term's sum; so what
    is shuffled are a block's distinct terms, not its cells."""
    from pyspark import StorageLevel

    from tessera.session import cut_lineage, release

    spark = tfidf_long.sparkSession
    xs = [f"x{t}" for t in range(k)]

    def start(name: str, salt: str) -> list[Column]:
        return [(core.hash_uniform(F.concat_ws(":", F.col(name).cast("string"), F.lit(str(t))), F.lit(salt)) + 0.01).alias(xs[t]) for t in range(k)]

    v = cut_lineage(tfidf_long.select(F.col(key).alias("d"), "term", F.col("tfidf").alias("v")))
    cells = v.count()
    n = max(-(-cells // NMF_CELLS), min(-(-cells // NMF_LEAST_CELLS), spark.sparkContext.defaultParallelism), 1)
    terms = cut_lineage(v.select("term").distinct().select("term", F.monotonically_increasing_id().alias("t"), *start("term", f"nmf-h:{seed}")))
    # a null name meets no row of the other matrix
    docs = v.where("d IS NOT NULL").select("d").distinct().withColumn("b", F.pmod(F.xxhash64("d"), F.lit(n)).cast("int"))
    docs = cut_lineage(docs.select("d", "b", (F.row_number().over(Window.partitionBy("b").orderBy("d")) - 1).alias("i"), *start("d", f"nmf-w:{seed}")))
    placed = v.join(terms.select("term", "t"), "term").join(docs.select("d", "b", "i"), "d").select("b", "i", "t", F.coalesce("v", F.lit(0.0)).alias("v"))
    packed = cut_lineage(placed.groupBy("b").applyInPandas(_packed_block, "b int, i binary, j binary, v binary, terms binary"))
    release(v)
    held = cut_lineage(packed.select("b", "terms").mapInPandas(_terms_of_blocks, "b int, t long, j int"))
    blocks = packed.repartition(n, "b").persist(StorageLevel.DISK_ONLY)

    def visit(H: DataFrame, W: DataFrame, gram: list[float] | None) -> DataFrame:
        """(b, i, t, x...): W, updated with H if its Gram matrix is given, with i; each block's sums by term, with t."""
        sent = W.select("b", "i", F.lit(None).cast("int").alias("j"), *xs)
        if gram is not None:
            sent = sent.unionByName(H.join(held, "t").select("b", F.lit(None).cast("int").alias("i"), "j", *xs))
        shape = "b int, i int, t long, " + ", ".join(f"{x} double" for x in xs)
        return cut_lineage(blocks.groupBy("b").cogroup(sent.groupBy("b")).applyInPandas(_nmf_block(k, gram), shape))

    def gram(M: DataFrame) -> DataFrame:
        return M.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)).alias(f"g{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs)])

    H, out = terms.select("t", *xs), visit(terms, docs, None)
    for done in range(iters):
        sums = out.where("t IS NOT NULL").groupBy("t").agg(*[F.sum(x).alias(f"num{i}") for i, x in enumerate(xs)])
        den = [sum((F.col(f"g{i}_{j}") * F.col(x) for j, x in enumerate(xs)), F.lit(0.0)) for i in range(k)]
        new = [(F.col(x) * F.coalesce(F.col(f"num{i}"), F.lit(0.0)) / (den[i] + F.lit(1e-9))).alias(x) for i, x in enumerate(xs)]
        W = out.where("i IS NOT NULL")
        before, H = H, cut_lineage(H.join(sums, "t", "left").crossJoin(F.broadcast(gram(W))).select("t", *new))
        last, out = out, visit(H, W, list(gram(H).first()))
        release(last, *([before] if done else []))
    blocks.unpersist()
    release(out, packed, held, docs)
    H = H.join(terms.select("t", "term"), "t").select("term", F.posexplode(F.array(*xs)).alias("t", "h"))
    # the top words of parts of the vocabulary first, then of what they leave
    part = Window.partitionBy("t", F.pmod(F.xxhash64("term"), F.lit(64))).orderBy(F.desc("h"), "term")
    H = H.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= words)
    w = Window.partitionBy("t").orderBy(F.desc("h"), "term")
    return H.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= words).select(
        F.col("t").alias("topic"), "rank", "term", F.col("h").alias("weight"))


def _packed_block(cells: pd.DataFrame) -> pd.DataFrame:
    """The cells (b, i, t, v) of a block as one row of bytes, with its distinct terms; j is a term's place in these."""
    terms, j = np.unique(cells["t"].to_numpy(np.int64), return_inverse=True)
    row = {"i": cells["i"].to_numpy(np.int32), "j": j.astype(np.int32), "v": cells["v"].to_numpy(np.float64), "terms": terms}
    return pd.DataFrame({"b": [int(cells["b"].iloc[0])]} | {c: [x.tobytes()] for c, x in row.items()})


def _terms_of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for b, held in zip(batch["b"], batch["terms"], strict=True):
            t = np.frombuffer(held, np.int64)
            yield pd.DataFrame({"b": np.full(len(t), b, np.int32), "t": t, "j": np.arange(len(t), dtype=np.int32)})


def _nmf_block(k: int, gram: list[float] | None):
    """A function of a block and of what it is sent: rows of W with i and of H with j."""

    def run(block: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        # a block whose documents have no named term is not there
        i, j = (np.frombuffer(b"".join(block[c]), np.int32) for c in ("i", "j"))
        v, terms = np.frombuffer(b"".join(block["v"]), np.float64), np.frombuffer(b"".join(block["terms"]), np.int64)
        xs = [f"x{t}" for t in range(k)]
        own = sent[sent["i"].notna()]
        W = np.zeros((len(own), k))
        W[own["i"].to_numpy(np.int64)] = own[xs].to_numpy(np.float64)
        if gram is not None:
            there = sent[sent["j"].notna()]
            H = np.zeros((len(terms), k))
            H[there["j"].to_numpy(np.int64)] = there[xs].to_numpy(np.float64)
            num = np.stack([np.bincount(i, v * H[j, t], len(W)) for t in range(k)], axis=1)
            W = W * num / (W @ np.array(gram).reshape(k, k).T + 1e-9)
        sums = np.stack([np.bincount(j, v * W[i, t], len(terms)) for t in range(k)], axis=1)
        of_term = np.arange(len(W) + len(terms)) >= len(W)
        out = {"b": np.full(len(of_term), sent["b"].iloc[0], np.int32)}
        out["i"] = pd.arrays.IntegerArray(np.arange(len(of_term), dtype=np.int32), of_term)
        out["t"] = pd.arrays.IntegerArray(np.r_[np.zeros(len(W), np.int64), terms], ~of_term)
        return pd.DataFrame(out | {x: np.r_[W[:, t], sums[:, t]] for t, x in enumerate(xs)})

    return run


# ---------------------------------------------------------------------------
# Custom transformers usable inside a Pipeline (saved / loaded with it)
# ---------------------------------------------------------------------------

from pyspark import keyword_only  # noqa: E402
from pyspark.ml import Transformer  # noqa: E402
from pyspark.ml.param.shared import HasInputCols, HasOutputCol  # noqa: E402
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable  # noqa: E402


class TextSelector(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Combine text columns into one (NULL -> '', space-joined; P12) as a pipeline stage."""

    @keyword_only
    def __init__(self, inputCols=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        cols = self.getInputCols()
        return df.withColumn(self.getOutputCol(), F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))


class NumericSelector(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Numeric columns cast to double into an array column (NULL kept) as a pipeline stage."""

    @keyword_only
    def __init__(self, inputCols=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        return df.withColumn(self.getOutputCol(), F.array(*[F.col(c).cast("double") for c in self.getInputCols()]))
