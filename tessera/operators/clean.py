"""Numeric preprocessing: imputation, outliers, scaling, transforms, encoders.

Each operator computes its statistics in one aggregate pass over all selected columns and
applies them back through a broadcast one-row cross join, so a single plan covers the
whole step and nothing but a one-row frame is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import core
from tessera.operators.ordered import last_value

# ---------------------------------------------------------------------------
# imputation
# ---------------------------------------------------------------------------


def _fill(df: DataFrame, stats: DataFrame, cols: Sequence[str], suffix: str) -> DataFrame:
    joined = core.broadcast_row(df, stats)
    filled = joined.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}{suffix}")) for c in cols}
    )
    return filled.drop(*[f"{c}{suffix}" for c in cols])


def impute_mean(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULLs of numeric columns become the column mean; an all-NULL column stays NULL."""
    cols = core.numeric_columns(df, cols)
    if not cols:
        return df
    stats = df.agg(*[F.avg(c).alias(f"{c}__fill") for c in cols])
    return _fill(df, stats, cols, "__fill")


def impute_median(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Exact median (linear interpolation), distributed."""
    cols = core.numeric_columns(df, cols)
    if not cols:
        return df
    stats = core.quantile_row(df, cols, [0.5], fmt="{c}__fill")
    return _fill(df, stats, cols, "__fill")


def impute_mode(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Most frequent value, smallest of ties."""
    cols = core.numeric_columns(df, cols)
    if not cols:
        return df
    m = core.modes(df, cols)
    stats = m.agg(*[F.max(F.when(F.col("column") == c, F.col("mode"))).alias(f"{c}__fill") for c in cols])
    return _fill(df, stats, cols, "__fill")


def impute(df: DataFrame, strategy: str = "mean", cols: Sequence[str] | None = None) -> DataFrame:
    ops = {"mean": impute_mean, "median": impute_median, "mode": impute_mode}
    if strategy not in ops:
        raise ValueError(f"invalid strategy {strategy!r}; choose mean, median or mode")
    return ops[strategy](df, cols)


def impute_ffill(df: DataFrame, order_by: Sequence[str], cols: Sequence[str] | None = None,
                 partition_by: Sequence[str] = (), bucket: float | None = None) -> DataFrame:
    """Forward fill along an explicit order (D9) inside optional groups.

    A hot group, or a table without groups, is scanned in ranges taken from the data, with
    carry-over between them (``ordered.last_value``; the table is written once when called).
    With ``bucket`` (a width on the first order column; seconds for timestamps) the ranges are
    (group, bucket) and nothing is written; a row with no earlier value in its bucket takes the
    last value of the nearest earlier bucket from a small (group, bucket) summary."""
    cols = list(cols) if cols else [c for c in df.columns if c not in order_by and c not in partition_by]
    part = list(partition_by)
    if bucket is None:
        return last_value(df, part, order_by, cols)
    first = F.col(order_by[0])
    num = F.unix_timestamp(first.cast("timestamp")) if dict(df.dtypes)[order_by[0]].startswith("timestamp") else first
    d = df.withColumn("__fb", F.floor(num / F.lit(bucket)))
    w = Window.partitionBy(*part, "__fb").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({f"__f_{c}": F.last(F.col(c), ignorenulls=True).over(w) for c in cols})
    order_key = F.struct(*order_by)
    summ = d.groupBy(*part, "__fb").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order_key)).alias(f"__s_{c}") for c in cols])
    wb = Window.partitionBy(*part).orderBy("__fb").rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.select(*part, "__fb", *[F.last(f"__s_{c}", ignorenulls=True).over(wb).alias(f"__p_{c}") for c in cols])
    j = d.join(carry, [*part, "__fb"], "left")
    out = j.withColumns({c: F.coalesce(F.col(f"__f_{c}"), F.col(f"__p_{c}")) for c in cols})
    return out.select(*df.columns)


# ---------------------------------------------------------------------------
# outliers (C05-C07)
# ---------------------------------------------------------------------------


def iqr_fences(df: DataFrame, cols: Sequence[str], threshold: float = 1.5) -> DataFrame:
    """One row: {c}__lo, {c}__hi for every column (exact quartiles)."""
    q = core.quantile_row(df, cols, [0.25, 0.75])
    exprs = []
    for c in cols:
        iqr = F.col(f"{c}__q1") - F.col(f"{c}__q0")
        exprs += [
            (F.col(f"{c}__q0") - F.lit(threshold) * iqr).alias(f"{c}__lo"),
            (F.col(f"{c}__q1") + F.lit(threshold) * iqr).alias(f"{c}__hi"),
        ]
    return q.select(*exprs)


def _outside(c: str) -> Column:
    return (F.col(c) < F.col(f"{c}__lo")) | (F.col(c) > F.col(f"{c}__hi"))


def _inside(c: str) -> Column:
    return (F.col(c) >= F.col(f"{c}__lo")) & (F.col(c) <= F.col(f"{c}__hi"))


def remove_outliers_iqr(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 1.5,
                        mode: str = "joint", checkpoint_every: int | None = None) -> DataFrame:
    """Keep rows inside [Q1 - t*IQR, Q3 + t*IQR].

    ``joint``: every fence from one pass over the input; a column that has at least one
    outlier then filters (its NULL rows go too, as in the reference); columns without
    outliers filter nothing.  ``sequential``: column k sees the survivors of 1..k-1
    (the reference's loop); one pass per column, optional checkpoint to cut lineage.
    """
    cols = core.numeric_columns(df, cols)
    if not cols:
        return df
    if mode == "sequential":
        # each step reads its input three times (quartiles, outlier test, filter); without a
        # cut the plan tree would grow 3^k, so survivors are checkpointed between steps
        from tessera.session import cut_lineage

        every = checkpoint_every or 1
        out = df
        for i, c in enumerate(cols):
            out = remove_outliers_iqr(out, [c], threshold, mode="joint")
            if (i + 1) % every == 0 and i + 1 < len(cols):
                out = cut_lineage(out)
        return out
    if mode != "joint":
        raise ValueError("mode must be 'joint' or 'sequential'")
    fences = iqr_fences(df, cols, threshold)
    flagged = core.broadcast_row(df, fences)
    has = flagged.agg(*[F.max(F.when(_outside(c), F.lit(True)).otherwise(F.lit(False))).alias(f"{c}__has") for c in cols])
    stats = fences.crossJoin(has)
    joined = core.broadcast_row(df, stats)
    keep = F.lit(True)
    for c in cols:
        keep = keep & (~F.coalesce(F.col(f"{c}__has"), F.lit(False)) | F.coalesce(_inside(c), F.lit(False)))
    return joined.where(keep).select(*df.columns)


def flag_outliers_iqr(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 1.5,
                      share: float = 5.0) -> DataFrame:
    """Per numeric column the fences, outlier count and share of all rows (%), flagged above ``share``."""
    cols = core.numeric_columns(df, cols)
    fences = iqr_fences(df, cols, threshold)
    joined = core.broadcast_row(df, fences)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in cols:
        aggs += [
            F.count_if(_outside(c)).alias(f"{c}__cnt"),
            F.first(f"{c}__lo").alias(f"{c}__lo"),
            F.first(f"{c}__hi").alias(f"{c}__hi"),
        ]
    agg = joined.agg(*aggs)
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"{c}__lo").alias("lower_bound"),
            F.col(f"{c}__hi").alias("upper_bound"),
            F.col(f"{c}__cnt").alias("outlier_count"),
            (F.col(f"{c}__cnt") * F.lit(100.0) / F.col("__n")).alias("outlier_pct"),
        )
        for c in cols
    ]
    out = agg.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.withColumn("flagged", F.col("outlier_pct") > F.lit(share))


def remove_outliers_zscore(df: DataFrame, cols: Sequence[str] | None = None, z: float = 3.0) -> DataFrame:
    """Keep rows with |x - mean| / std_pop <= z in every column; NULLs kept, constant columns ignored."""
    cols = core.numeric_columns(df, cols)
    stats = df.agg(*[e for c in cols for e in (F.avg(c).alias(f"{c}__mu"), F.stddev_pop(c).alias(f"{c}__sd"))])
    joined = core.broadcast_row(df, stats)
    keep = F.lit(True)
    for c in cols:
        zc = core.safe_div(F.abs(F.col(c) - F.col(f"{c}__mu")), F.col(f"{c}__sd"))
        keep = keep & F.coalesce(zc <= F.lit(z), F.lit(True))
    return joined.where(keep).select(*df.columns)


# ---------------------------------------------------------------------------
# scaling (C08-C10)
# ---------------------------------------------------------------------------


def _apply(df: DataFrame, stats: DataFrame, exprs: dict[str, Column], drop: Sequence[str]) -> DataFrame:
    return core.broadcast_row(df, stats).withColumns(exprs).drop(*drop)


def scale_minmax(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(x - min) / (max - min); a constant column becomes 0; NULL stays NULL."""
    cols = core.numeric_columns(df, cols)
    if not cols:
        return df
    stats = df.agg(*[e for c in cols for e in (F.min(c).alias(f"{c}__mn"), F.max(c).alias(f"{c}__mx"))])
    exprs = {}
    for c in cols:
        rng = F.col(f"{c}__mx") - F.col(f"{c}__mn")
        exprs[c] = (F.col(c) - F.col(f"{c}__mn")) / F.when(rng == 0, F.lit(1.0)).otherwise(rng)
    return _apply(df, stats, exprs, [f"{c}__{s}" for c in cols for s in ("mn", "mx")])


def scale_standard(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(x - mean) / std (ddof 0, D19); a constant column becomes 0."""
    cols = core.numeric_columns(df, cols)
    if not cols:
        return df
    stats = df.agg(*[e for c in cols for e in (F.avg(c).alias(f"{c}__mu"), F.stddev_pop(c).alias(f"{c}__sd"))])
    exprs = {}
    for c in cols:
        sd = F.col(f"{c}__sd")
        exprs[c] = (F.col(c) - F.col(f"{c}__mu")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)
    return _apply(df, stats, exprs, [f"{c}__{s}" for c in cols for s in ("mu", "sd")])


def scale_robust(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(x - median) / IQR; zero IQR divides by 1."""
    cols = core.numeric_columns(df, cols)
    if not cols:
        return df
    stats = core.quantile_row(df, cols, [0.25, 0.5, 0.75])
    exprs = {}
    for c in cols:
        iqr = F.col(f"{c}__q2") - F.col(f"{c}__q0")
        exprs[c] = (F.col(c) - F.col(f"{c}__q1")) / F.when(iqr == 0, F.lit(1.0)).otherwise(iqr)
    return _apply(df, stats, exprs, [f"{c}__q{i}" for c in cols for i in range(3)])


def scale(df: DataFrame, scaler: str = "standard", cols: Sequence[str] | None = None) -> DataFrame:
    ops = {"minmax": scale_minmax, "standard": scale_standard, "robust": scale_robust}
    if scaler not in ops:
        raise ValueError(f"invalid scaler {scaler!r}")
    return ops[scaler](df, cols)


# ---------------------------------------------------------------------------
# transforms
# ---------------------------------------------------------------------------


def transform_log(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """C11 (D7): ln(x) if the column minimum is > 0, else ln(1 + x); out-of-domain -> NULL."""
    cols = core.numeric_columns(df, cols)
    stats = df.agg(*[F.min(c).alias(f"{c}__mn") for c in cols])
    exprs = {}
    for c in cols:
        x = F.col(c).cast("double")
        arg = F.when(F.col(f"{c}__mn") <= 0, x + F.lit(1.0)).otherwise(x)
        exprs[c] = F.when(arg > 0, F.ln(arg))
    return _apply(df, stats, exprs, [f"{c}__mn" for c in cols])


def transform_sqrt(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Sqrt; negatives -> NULL."""
    cols = core.numeric_columns(df, cols)
    return df.withColumns({c: F.when(F.col(c) >= 0, F.sqrt(F.col(c).cast("double"))) for c in cols})


def transform_reciprocal(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """1/x; zero -> NULL."""
    cols = core.numeric_columns(df, cols)
    return df.withColumns({c: core.safe_div(F.lit(1.0), F.col(c).cast("double")) for c in cols})


def boxcox_expr(x: Column, lam: Column | float) -> Column:
    lam_c = lam if isinstance(lam, Column) else F.lit(float(lam))
    return F.when(F.abs(lam_c) < F.lit(1e-12), F.ln(x)).otherwise((F.pow(x, lam_c) - F.lit(1.0)) / lam_c)


def boxcox_lambdas(df: DataFrame, cols: Sequence[str], lo: float = -2.0, hi: float = 2.0,
                   grid: int = 41, rounds: int = 3) -> DataFrame:
    """C12 fit: maximum-likelihood lambda per positive column.

    llf(l) = (l - 1) * sum(ln x) - n/2 * ln(var_pop(boxcox(x, l))).  Each round evaluates a
    whole grid of lambdas for every column in one aggregate; the next round zooms into the
    best cell.  Returns (column, lambda) with one row per column whose minimum is > 0.
    """
    spark = df.sparkSession
    pos = df.agg(*[F.min(c).alias(c) for c in cols]).collect()[0]
    keep = [c for c in cols if pos[c] is not None and pos[c] > 0]
    if not keep:
        return core.lit_table(spark, [], "column string, lambda double")
    centers = {c: 0.0 for c in keep}
    half = {c: (hi - lo) / 2 for c in keep}
    xs = df.select(*[F.col(c).cast("double").alias(c) for c in keep])
    best = {}
    for _ in range(rounds):
        aggs = []
        lams = {}
        for c in keep:
            lams[c] = [centers[c] - half[c] + 2 * half[c] * i / (grid - 1) for i in range(grid)]
            for i, lam in enumerate(lams[c]):
                aggs.append(F.var_pop(boxcox_expr(F.col(c), lam)).alias(f"{c}__v{i}"))
            aggs.append(F.sum(F.ln(F.col(c))).alias(f"{c}__sl"))
            aggs.append(F.count(c).alias(f"{c}__n"))
        row = xs.agg(*aggs).collect()[0]  # one row of grid statistics
        import math

        for c in keep:
            n, sl = row[f"{c}__n"], row[f"{c}__sl"]
            scores = []
            for i, lam in enumerate(lams[c]):
                v = row[f"{c}__v{i}"]
                if v is None or v <= 0:
                    continue
                scores.append(((lam - 1) * sl - n / 2 * math.log(v), lam))
            if scores:
                best[c] = max(scores)[1]
                centers[c] = best[c]
            half[c] = 2 * half[c] / (grid - 1)
    return core.lit_table(spark, [(c, float(best[c])) for c in keep if c in best], "column string, lambda double")


def transform_boxcox(df: DataFrame, cols: Sequence[str] | None = None,
                     lambdas: dict[str, float] | None = None) -> DataFrame:
    """Box-Cox of positive columns with fitted (or given) lambda; other columns untouched."""
    cols = core.numeric_columns(df, cols)
    if lambdas is None:
        lambdas = {r["column"]: r["lambda"] for r in boxcox_lambdas(df, cols).collect()}
    return df.withColumns({c: boxcox_expr(F.col(c).cast("double"), lam) for c, lam in lambdas.items()})


# ---------------------------------------------------------------------------
# encoders (C16, C17)
# ---------------------------------------------------------------------------


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, code): sorted distinct values -> 0..k-1.  Distinct values are dealt into ranges of
    the order; a code is the rank in its range plus the sizes of the ranges before it, so no task
    sorts more than a range.  The ranges are written once, as a second pass could draw others."""
    from tessera.session import cut_lineage

    values = df.select(F.col(col).alias("value")).where(F.col(col).isNotNull()).distinct()
    dealt = cut_lineage(values.repartitionByRange("value").withColumn("__p", F.spark_partition_id()))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    starts = sizes.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__start"))
    rank = F.row_number().over(Window.partitionBy("__p").orderBy("value"))
    return dealt.withColumn("__r", rank).join(starts, "__p").select("value", (F.col("__start") + F.col("__r") - 1).cast("int").alias("code"))


def encode_label(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """C17: label encoding by sorted distinct value; a NULL has no code.  Spark broadcasts the code
    table if its measured bytes allow it."""
    codes = label_codes(df, col).withColumnRenamed("value", col)
    return df.join(codes, col, "left").withColumnRenamed("code", out or f"{col}_encoded")


def encode_onehot(df: DataFrame, col: str, values: Sequence[str], drop_first: bool = True) -> DataFrame:
    """C16, wide: one indicator column ``{col}_{value}`` for each of the caller's values (first
    dropped).  Where the values are not known beforehand, see ``encode_onehot_sparse``."""
    vals = list(values)[1:] if drop_first else list(values)
    return df.withColumns({f"{col}_{v}": (F.col(col) == F.lit(v)).cast("int") for v in vals}).drop(col)


def encode_onehot_sparse(df: DataFrame, key: str, col: str, drop_first: bool = True) -> DataFrame:
    """C16, long: (key, index, value) of each row's indicator that is 1, for any number of distinct
    values.  ``index`` counts the indicator columns in sorted order of values from 0; rows of a NULL
    or of the dropped first value have no indicator that is 1, hence no row."""
    first = 1 if drop_first else 0
    coded = encode_label(df.select(key, F.col(col).alias("value")), "value", "index")
    return coded.where(F.col("index") >= first).select(key, (F.col("index") - first).alias("index"), "value")


# ---------------------------------------------------------------------------
# row filters and column helpers
# ---------------------------------------------------------------------------


def select_columns(df: DataFrame, cols: Sequence[str], numeric_only: bool = True) -> DataFrame:
    """User subset; refuses unknown or (optionally) non-numeric columns."""
    core.require_columns(df, cols)
    if numeric_only:
        bad = [c for c in cols if c not in core.numeric_columns(df)]
        if bad:
            raise ValueError(f"non-numeric columns: {bad}")
    return df.select(*cols)


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Complete cases."""
    return df.na.drop(how="any", subset=list(cols) if cols else None)


def combine_text(cols: Sequence[str]) -> Column:
    """NULL -> '', joined by a single space."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def validate_data(df: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """Per column null share, distinct count and, for string columns, the share of
    values castable to ``rules[col]`` (default double)."""
    rules = rules or {}
    n = F.count(F.lit(1))
    aggs = [n.alias("__n")]
    for c in df.columns:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__null"), F.count_distinct(c).alias(f"{c}__nd")]
        target = rules.get(c, "double")
        aggs.append(F.count_if(F.col(c).cast("string").try_cast(target).isNotNull()).alias(f"{c}__ok"))
    row = df.agg(*aggs)
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"{c}__null").alias("null_count"),
            F.col(f"{c}__nd").alias("distinct_count"),
            F.col(f"{c}__ok").alias("castable_count"),
            F.col("__n").alias("rows"),
        )
        for c in df.columns
    ]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")
