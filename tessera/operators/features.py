"""Feature preparation that is fitted on training rows and saved with the model (M01), and boosting
with early stopping (M08, M09).

``PreparedFeatures`` learns statistics and a vocabulary with Spark aggregates and becomes a
``PipelineModel`` of Spark's own transformers, so it is saved, loaded and applied inside the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import core
from tessera.functions import dictionaries as D
from tessera.operators.text import row_term_counts


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class PreparedFeatures(Estimator):
    """``features``: numeric columns, missing values filled with the median (exact) or mean and scaled
    to mean 0 and variance 1 (ddof 0; a constant column becomes 0), then per text column the
    TF-IDF weights of its 1- and 2-grams.

    Weights are those of the long form (``text.tfidf_long``): lower-cased words of two or more
    characters without stop words, terms that ``min_df`` rows or more and at most the share
    ``max_df`` of rows hold, of these the ``max_features`` commonest (ties by term), idf
    ln((1 + n) / (1 + df)) + 1, rows of length 1.  ``max_features`` bounds what the driver holds.
    NULL texts are empty, NaN counts as missing, a column without any value is filled with 0.
    """

    def __init__(self, numeric: Sequence[str], text: Sequence[str] = (), impute: str = "median", ngrams: int = 2, min_df: int = 2, max_df: float = 0.95, max_features: int = 10_000, output: str = "features"):
        super().__init__()
        if impute not in ("mean", "median"):
            raise ValueError(f"unknown imputation {impute!r}")
        self.numeric, self.text, self.impute, self.ngrams = list(numeric), list(text), impute, ngrams
        self.min_df, self.max_df, self.max_features, self.output = min_df, max_df, max_features, output

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        stages: list = []
        made: list[str] = []
        if self.numeric:
            stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(self._scaled(dataset, made))} FROM __THIS__"))
        for c in self.text:
            stages += self._text_stages(dataset, c, made)
        stages.append(VectorAssembler(inputCols=list(made), outputCol=self.output))
        helpers = [x for s in stages[:-1] for x in ([s.getOutputCol()] if s.hasParam("outputCol") and not isinstance(s, SQLTransformer) else [])]
        helpers += made + [f"__{c}__{part}" for c in self.text for part in ("text", "grams")]
        drop = ", ".join(_q(x) for x in dict.fromkeys(helpers))
        stages.append(SQLTransformer(statement=f"SELECT * EXCEPT ({drop}) FROM __THIS__"))
        return PipelineModel(stages)

    def _scaled(self, df: DataFrame, made: list[str]) -> list[str]:
        if self.impute == "median":
            fill = {r["column"]: r["q"] for r in core.exact_quantiles(df, self.numeric, [0.5]).collect()}
        else:
            row = df.agg(*[F.avg(core.number(c)).alias(f"m{i}") for i, c in enumerate(self.numeric)]).first()
            fill = {c: row[f"m{i}"] for i, c in enumerate(self.numeric)}
        fill = {c: fill[c] if fill.get(c) is not None else 0.0 for c in self.numeric}
        full = [F.coalesce(core.number(c), F.lit(fill[c])) for c in self.numeric]
        row = df.agg(*[e for i, x in enumerate(full) for e in (F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"))]).first()
        out = []
        for i, c in enumerate(self.numeric):
            made.append(f"__{c}__scaled")
            mean, std = row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0
            out.append(f"(coalesce(nanvl(CAST({_q(c)} AS DOUBLE), NULL), {fill[c]!r}D) - ({mean!r}D)) / {std!r}D AS {_q(made[-1])}")
        return out

    def _text_stages(self, df: DataFrame, c: str, made: list[str]) -> list:
        name = lambda part: f"__{c}__{part}"
        stages = [
            SQLTransformer(statement=f"SELECT *, coalesce(CAST({_q(c)} AS STRING), '') AS {_q(name('text'))} FROM __THIS__"),
            RegexTokenizer(inputCol=name("text"), outputCol=name("words"), pattern=r"(?U)\w\w+", gaps=False),
            StopWordsRemover(inputCol=name("words"), outputCol=name("kept"), stopWords=list(D.STOPWORDS_EN), caseSensitive=True),
        ]
        parts = [name("kept")]
        for n in range(2, self.ngrams + 1):
            stages.append(NGram(n=n, inputCol=name("kept"), outputCol=name(f"gram{n}")))
            parts.append(name(f"gram{n}"))
        stages.append(SQLTransformer(statement=f"SELECT *, concat({', '.join(_q(p) for p in parts)}) AS {_q(name('grams'))} FROM __THIS__"))
        rows = PipelineModel(stages).transform(df.select(c)).select(F.col(name("grams")).alias("g"))
        n = df.count()
        # a term's rows and occurrences: counted in each row, summed before the shuffle
        counted = row_term_counts(rows, "g")
        stats = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
        kept = stats.where((F.col("df") >= self.min_df) & (F.col("df") <= F.lit(self.max_df * n))).orderBy(F.desc("cf"), "term").limit(self.max_features)
        found = kept.select("term", (F.ln(F.lit(n + 1.0) / (F.col("df") + 1)) + 1).alias("idf")).collect()  # max_features rows
        found = found or [{"term": "", "idf": 1.0}]  # no term: a column of zeros
        counts = CountVectorizerModel.from_vocabulary([r["term"] for r in found], inputCol=name("grams"), outputCol=name("counts"))
        stages += [
            counts,
            ElementwiseProduct(inputCol=name("counts"), outputCol=name("weights"), scalingVec=Vectors.dense([r["idf"] for r in found])),
            Normalizer(inputCol=name("weights"), outputCol=name("tfidf"), p=2.0),
        ]
        made.append(name("tfidf"))
        return stages


def vocabularies(model: PipelineModel) -> list[list[str]]:
    """The terms of each text column of a fitted ``PreparedFeatures``, in order of their weights."""
    return [list(s.vocabulary) for s in model.stages if isinstance(s, CountVectorizerModel)]


def stop_round(losses: Sequence[float], patience: int = 10, tol: float = 1e-4) -> int | None:
    """Rounds after which boosting stops: the first that has not improved on any of the ``patience``
    rounds before it by more than ``tol``; None if there is none."""
    for i, loss in enumerate(losses):
        if i >= patience and all(loss + tol >= before for before in losses[i - patience : i]):
            return i + 1
    return None


def boost_with_early_stop(train: DataFrame, label: str, numeric: Sequence[str], key: str | Sequence[str], text: Sequence[str] = (), max_rounds: int = 100, patience: int = 10, tol: float = 1e-4, validation: float = 0.1, seed: int = 42, impute: str = "median", **params):
    """Gradient-boosted trees with a validation loss after every round and patience.

    A stratified share of the rows, dealt by ``key``, is held out; boosting runs for 25, 50, 100, ...
    rounds until the loss curve of the held-out rows stops (a longer run has the same trees first),
    and the model is then fitted with the rounds used.  Returns (model, curve): the fitted
    PipelineModel with as many trees as rounds used, and (round, loss, used) of every round seen.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier

    from tessera.operators.ml import stratified_split
    from tessera.session import cut_lineage

    dealt = stratified_split(train, label, key, (1 - validation, validation), ("fit", "validation"), seed)
    prepared = PreparedFeatures(numeric, text, impute).fit(dealt.where("split = 'fit'"))
    ready = cut_lineage(prepared.transform(dealt).select("split", F.col(label).cast("double").alias("label"), "features"))
    fit, held = ready.where("split = 'fit'"), ready.where("split = 'validation'")
    rounds, losses, used = 25, [], None
    while used is None:
        rounds = min(rounds, max_rounds)
        boosted = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, seed=seed, **params).fit(fit)
        losses = list(boosted.evaluateEachIteration(held))
        used = stop_round(losses, patience, tol) or (rounds if rounds == max_rounds else None)
        rounds *= 2
    if used < len(losses):
        boosted = GBTClassifier(featuresCol="features", labelCol="label", maxIter=used, seed=seed, **params).fit(fit)
    curve = core.lit_table(train.sparkSession, [(i + 1, float(v), i < used) for i, v in enumerate(losses)], "round int, loss double, used boolean")
    return PipelineModel(prepared.stages + [boosted]), curve


def metrics_record(model_type: str, best_parameters: dict, summary: DataFrame, at: str) -> DataFrame:
    """One row (model_type, timestamp, best_parameters, test_metrics), parameters and metrics as
    JSON text with sorted names; ``summary`` holds (metric, value), ``at`` is an ISO timestamp."""
    import json

    listed = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value"))))
    return summary.agg(F.to_json(listed).alias("test_metrics")).select(
        F.lit(model_type).alias("model_type"), F.lit(at).alias("timestamp"), F.lit(json.dumps(best_parameters, sort_keys=True)).alias("best_parameters"), "test_metrics",
    )
