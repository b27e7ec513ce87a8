"""Relationships between numeric columns: correlation (Pearson / Spearman), pair tables,
strength summaries, trend lines and PCA (A11-A17, W01, W05)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import core


def _grams(k: int, versions: int, partner: list[int]):
    """A map from rows of k x versions numbers to one row per task: for every pair of columns the
    count and the sums of x, x^2 and x y over the rows where both are there.  A column may come
    in several versions; ``partner[b]`` is the one that it shows to column b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sx, sxx, sxy = (np.zeros((k, k)) for _ in range(4))
        step = max(1, (1 << 22) // (k * k))  # bounds the pair arrays of wide tables
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k, versions)
            for a in range(0, len(flat), step):
                x = flat[a : a + step]
                there = ~np.isnan(x[:, :, 0])
                m = there.astype(float)
                n += m.T @ m
                if versions == 1:
                    v = np.where(there, x[:, :, 0], 0.0)
                    sx += v.T @ m
                    sxx += (v * v).T @ m
                    sxy += v.T @ v
                else:
                    both = there[:, :, None] & there[:, None, :]
                    v = np.where(both, x[:, :, partner], 0.0)  # row, column, its partner
                    sx += v.sum(axis=0)
                    sxx += (v * v).sum(axis=0)
                    sxy += np.einsum("nab,nba->ab", v, v)
        yield pa.RecordBatch.from_arrays([pa.array([s.ravel().tolist()], pa.list_(pa.float64())) for s in (n, sx, sxx, sxy)], names=["n", "sx", "sxx", "sxy"])

    return run


def _gram_corr(rows: DataFrame, cols: Sequence[str], value: str, versions: int = 1, partner: Sequence[int] = ()) -> DataFrame:
    """(variable_1, variable_2, ``value``): the correlation of every pair of columns from block Gram
    sums.  ``rows`` holds one array of len(cols) x versions numbers, centred so that squares keep
    their digits; each task sums its rows as matrices, and only one row a task and pair moves."""
    k = len(cols)
    parts = rows.mapInArrow(_grams(k, versions, list(partner)), "n array<double>, sx array<double>, sxx array<double>, sxy array<double>")
    sums = parts.select(F.posexplode(F.arrays_zip("n", "sx", "sxx", "sxy")).alias("at", "s")).groupBy("at").agg(*[F.sum(f"s.{c}").alias(c) for c in ("n", "sx", "sxx", "sxy")])
    sums = sums.select((F.col("at") / k).cast("int").alias("i"), (F.col("at") % k).cast("int").alias("j"), "n", "sx", "sxx", "sxy")
    x, y = sums.where("i < j").alias("x"), sums.where("i > j").select(F.col("j").alias("i"), F.col("i").alias("j"), "sx", "sxx").alias("y")

    def spread(side: str):
        square = F.col("x.n") * F.col(f"{side}.sxx")
        left = square - F.col(f"{side}.sx") * F.col(f"{side}.sx")
        return F.when(left > 1e-12 * square, left)  # else all values are the same

    corr = (F.col("x.n") * F.col("x.sxy") - F.col("x.sx") * F.col("y.sx")) / F.sqrt(spread("x") * spread("y"))
    names = F.array(*[F.lit(c) for c in cols])
    return x.join(y, ["i", "j"]).select(F.get(names, "i").alias("variable_1"), F.get(names, "j").alias("variable_2"), F.greatest(F.least(corr, F.lit(1.0)), F.lit(-1.0)).alias(value))


def pearson_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Upper-triangle (variable_1, variable_2, pearson) of pairwise-complete rows, at any width.
    NULL where a pair has fewer than two rows or one value."""
    cols = list(cols)
    if len(cols) < 2:
        return core.lit_table(df.sparkSession, [], "variable_1 string, variable_2 string, pearson double")
    means = df.agg(*[F.avg(core.number(c)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    centred = df.select(F.array(*[core.number(c) - F.lit(means[i] or 0.0) for i, c in enumerate(cols)]).alias("v"))
    return _gram_corr(centred, cols, "pearson")


def spearman_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Upper-triangle (variable_1, variable_2, spearman) = Pearson of average ranks.

    A pair is ranked over the rows where both columns are there (pandas pairwise-complete rule), so
    a column has a rank of its own for each partner with NULLs.  All of them come from one
    pass over the distinct values (core.value_positions with a mask for each such partner), are
    joined to the rows by value, column by column, and meet in Gram sums.
    """
    from tessera.session import cut_parts

    cols = list(cols)
    if len(cols) < 2:
        return core.lit_table(df.sparkSession, [], "variable_1 string, variable_2 string, spearman double")
    wide = df.select(*[core.number(c).alias(f"v{i}") for i, c in enumerate(cols)])
    counted = wide.agg(F.count(F.lit(1)), *[F.count(c) for c in wide.columns]).first()  # one row
    rows = counted[0]
    holes = [i for i in range(len(cols)) if counted[i + 1] < rows]
    pos = core.value_positions(wide, wide.columns, {f"m{i}": F.col(f"v{i}").isNotNull() for i in holes})
    rank = lambda s: F.when(F.col(f"cnt{s}") > 0, F.col(f"before{s}") + (F.col(f"cnt{s}") + 1) / 2.0 - (rows + 1) / 2.0)
    ranks = pos.select(F.substring("column", 2, 9).cast("int").alias("part"), "value", F.array(rank(""), *[rank(f"_m{i}") for i in holes]).alias("ranks"))
    parts = cut_parts(ranks, "part", range(len(cols)))
    out = wide
    for i in range(len(cols)):  # a column of few values is joined by broadcast
        out = out.join(parts[i].select(F.col("value").alias(f"v{i}"), F.col("ranks").alias(f"r{i}")), f"v{i}", "left")
    none = F.array(*[F.lit(None).cast("double")] * (len(holes) + 1))
    partner = [1 + holes.index(i) if i in holes else 0 for i in range(len(cols))]
    flat = out.select(F.flatten(F.array(*[F.coalesce(f"r{i}", none) for i in range(len(cols))])).alias("v"))
    return _gram_corr(flat, cols, "spearman", 1 + len(holes), partner)


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """Long matrix (variable_1, variable_2, correlation) incl. the diagonal (1.0)."""
    cols = core.numeric_columns(df, cols)
    up = pearson_pairs(df, cols) if method == "pearson" else spearman_pairs(df, cols)
    val = "pearson" if method == "pearson" else "spearman"
    up = up.select("variable_1", "variable_2", F.col(val).alias("correlation"))
    low = up.select(F.col("variable_2").alias("variable_1"), F.col("variable_1").alias("variable_2"), "correlation")
    diag = core.lit_table(df.sparkSession, [(c, c, 1.0) for c in cols], "variable_1 string, variable_2 string, correlation double")
    return up.unionByName(low).unionByName(diag)


def correlation_table(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """Ordered pairs i != j with pearson, spearman, |pearson| and the high flag, |r| desc."""
    cols = core.numeric_columns(df, cols)
    up = pearson_pairs(df, cols).join(spearman_pairs(df, cols), ["variable_1", "variable_2"])
    low = up.select(F.col("variable_2").alias("variable_1"), F.col("variable_1").alias("variable_2"), "pearson", "spearman")
    both = up.unionByName(low)
    return both.select(
        "variable_1",
        "variable_2",
        F.col("pearson").alias("pearson_correlation"),
        F.col("spearman").alias("spearman_correlation"),
        F.abs("pearson").alias("abs_pearson"),
        (F.abs("pearson") >= F.lit(threshold)).alias("high_correlation"),
    ).orderBy(F.desc("abs_pearson"), "variable_1", "variable_2")


def high_correlations(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.7,
                      method: str = "pearson") -> DataFrame:
    """Upper-triangle pairs with |r| >= threshold."""
    cols = core.numeric_columns(df, cols)
    up = pearson_pairs(df, cols) if method == "pearson" else spearman_pairs(df, cols)
    val = "pearson" if method == "pearson" else "spearman"
    return up.where(F.abs(val) >= F.lit(threshold)).select(
        F.col("variable_1").alias("var1"), F.col("variable_2").alias("var2"), F.col(val).alias("correlation")
    )


def correlation_strength(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Weak (< .3) / moderate (< .7) / strong counts over upper-triangle |r|; total, max, min, avg."""
    cols = core.numeric_columns(df, cols)
    a = F.abs(F.col("pearson"))
    return pearson_pairs(df, cols).agg(
        F.count_if(a < 0.3).alias("weak_count"),
        F.count_if((a >= 0.3) & (a < 0.7)).alias("moderate_count"),
        F.count_if(a >= 0.7).alias("strong_count"),
        F.count(F.lit(1)).alias("total_pairs"),
        F.max(a).alias("max_correlation"),
        F.min(a).alias("min_correlation"),
        F.avg(a).alias("avg_correlation"),
    )


def feature_correlation_ranking(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Mean |r| of each column with all the others, descending."""
    m = correlation_matrix(df, cols).where(F.col("variable_1") != F.col("variable_2"))
    return (
        m.groupBy(F.col("variable_1").alias("variable"))
        .agg(F.avg(F.abs("correlation")).alias("mean_abs_correlation"))
        .orderBy(F.desc("mean_abs_correlation"), "variable")
    )


def trend_lines(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Least-squares slope and intercept of y on x for each (x, y) pair, complete rows."""
    aggs = []
    for x, y in pairs:
        aggs += [
            F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias(f"{x}__{y}__s"),
            F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias(f"{x}__{y}__i"),
        ]
    row = df.agg(*aggs)
    structs = [
        F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"{x}__{y}__s").alias("slope"),
                 F.col(f"{x}__{y}__i").alias("intercept"))
        for x, y in pairs
    ]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def pca_summary(df: DataFrame, cols: Sequence[str] | None = None, k: int = 2):
    """PCA of the standardised complete rows.

    Returns (variance, loadings, scores): variance (pc, explained_variance_ratio,
    cumulative_variance) with W05's running sum; loadings (variable, pc, loading) =
    component * sqrt(eigenvalue); scores = input rows with PC1..PCk.  The covariance is
    a d x d aggregate (pyspark.ml PCA); signs fixed so the largest |loading| is positive.
    """
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from tessera.operators.clean import scale_standard

    cols = core.numeric_columns(df, cols)
    k = min(k, len(cols))
    complete = df.na.drop(subset=cols)
    std = scale_standard(complete, cols)
    va = VectorAssembler(inputCols=cols, outputCol="__x")
    vec = va.transform(std)
    model = PCA(k=k, inputCol="__x", outputCol="__pc").fit(vec)
    ratios = [float(v) for v in model.explainedVariance.toArray()]
    pcm = model.pc.toArray()  # d x k, small
    n = complete.count()
    total_var = len(cols) * n / max(n - 1, 1)
    signs = []
    for j in range(k):
        col = pcm[:, j]
        signs.append(1.0 if col[abs(col).argmax()] >= 0 else -1.0)
    spark = df.sparkSession
    var_df = core.lit_table(spark, [(j + 1, ratios[j]) for j in range(k)], "pc int, explained_variance_ratio double")
    var_df = var_df.withColumn(
        "cumulative_variance",
        F.sum("explained_variance_ratio").over(Window.orderBy("pc").rowsBetween(Window.unboundedPreceding, 0)),
    )
    load_rows = []
    for i, c in enumerate(cols):
        for j in range(k):
            load_rows.append((c, j + 1, float(signs[j] * pcm[i, j] * (ratios[j] * total_var) ** 0.5)))
    load_df = core.lit_table(spark, load_rows, "variable string, pc int, loading double")
    scores = model.transform(vec).withColumn("__arr", vector_to_array("__pc"))
    scores = scores.withColumns({f"PC{j + 1}": F.col("__arr")[j] * F.lit(signs[j]) for j in range(k)})
    scores = scores.drop("__x", "__pc", "__arr")
    return var_df, load_df, scores
