"""Dataset profiling: info, describe, advanced statistics, value counts, quality metrics,
insights, missing patterns, histograms, box statistics, KDE, Q-Q points, augmentation and
class-balance reports, text-column detection, samples (A01-A10, A18-A24, P03-P05, P08-P09).

Wide statistics are one ``agg`` over all columns; order statistics come from
``core.exact_quantiles``; results are tidy long tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import core


def _long(row: DataFrame, structs: list) -> DataFrame:
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


# ---------------------------------------------------------------------------
# A01 / A07 / A09 / A10
# ---------------------------------------------------------------------------


def dataset_info(df: DataFrame, exact: bool = True, rsd: float = 0.01) -> DataFrame:
    """Per column dtype, null count, null %, distinct count (NULL not counted), rows.
    ``exact=False`` uses HyperLogLog++ (``approx_count_distinct``, relative error ``rsd``)
    instead of one exact distinct aggregation per column (an Expand of the rows per column)."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in df.columns:
        nd = F.count_distinct(c) if exact else F.approx_count_distinct(c, rsd)
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__null"), nd.alias(f"{c}__nd")]
    row = df.agg(*aggs)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(types[c]).alias("dtype"),
            F.col(f"{c}__null").alias("null_count"),
            (F.col(f"{c}__null") * F.lit(100.0) / F.col("__n")).alias("null_percentage"),
            F.col(f"{c}__nd").alias("unique_count"),
            F.col("__n").alias("rows"),
        )
        for c in df.columns
    ]
    return _long(row, structs)


def dtype_summary(df: DataFrame) -> DataFrame:
    """A01 second part: number of columns per dtype (schema metadata only)."""
    counts: dict[str, int] = {}
    for f in df.schema.fields:
        counts[f.dataType.simpleString()] = counts.get(f.dataType.simpleString(), 0) + 1
    return core.lit_table(df.sparkSession, sorted(counts.items()), "dtype string, column_count long")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier identical row (pandas ``duplicated().sum()``): n - distinct."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__c"))
    return groups.agg(F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).cast("long").alias("duplicates"))


def quality_metrics(df: DataFrame) -> DataFrame:
    """Nulls per column (map), duplicate rows, dtypes (map), total rows and columns."""
    nulls = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.create_map(*[x for c in df.columns for x in (F.lit(c), F.count_if(F.col(c).isNull()))]).alias("missing_values"),
    )
    dtypes = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    return nulls.crossJoin(duplicate_count(df)).select(
        "missing_values", "duplicates", dtypes.alias("data_types"), "total_rows",
        F.lit(len(df.columns)).cast("long").alias("total_columns"),
    )


def missing_pattern(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A10: count of rows per null pattern; pattern = '0'/'1' flag per column in order."""
    cols = list(cols) if cols else df.columns
    pat = F.concat(*[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    return df.groupBy(pat.alias("pattern")).agg(F.count(F.lit(1)).alias("rows"))


def dashboard(df: DataFrame) -> DataFrame:
    """Shape, missing total and %, numeric / categorical counts, duplicates as (metric, value)."""
    num = core.numeric_columns(df)
    cat = core.categorical_columns(df)
    ncols = len(df.columns)
    miss = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(miss).alias("missing")).crossJoin(duplicate_count(df))
    structs = [
        F.struct(F.lit("rows").alias("metric"), F.col("rows").cast("double").alias("value")),
        F.struct(F.lit("columns").alias("metric"), F.lit(float(ncols)).alias("value")),
        F.struct(F.lit("missing_values").alias("metric"), F.coalesce(F.col("missing"), F.lit(0)).cast("double").alias("value")),
        F.struct(F.lit("missing_pct").alias("metric"),
                 (F.coalesce(F.col("missing"), F.lit(0)) * F.lit(100.0) / (F.col("rows") * F.lit(ncols))).alias("value")),
        F.struct(F.lit("numeric_columns").alias("metric"), F.lit(float(len(num))).alias("value")),
        F.struct(F.lit("categorical_columns").alias("metric"), F.lit(float(len(cat))).alias("value")),
        F.struct(F.lit("duplicate_rows").alias("metric"), F.col("duplicates").cast("double").alias("value")),
    ]
    return _long(row, structs)


# ---------------------------------------------------------------------------
# A02-A04 numeric summaries
# ---------------------------------------------------------------------------


def _moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [
            F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"),
            F.var_samp(x).alias(f"{c}__var"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"),
            F.skewness(x).alias(f"{c}__skew"), F.kurtosis(x).alias(f"{c}__kurt"),
        ]
    return df.agg(*aggs)


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, std (ddof 1), min, 25/50/75 % (exact), max per numeric column."""
    cols = core.numeric_columns(df, cols)
    row = _moments(df, cols).crossJoin(core.quantile_row(df, cols, [0.25, 0.5, 0.75]))
    structs = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"{c}__count").alias("count"), F.col(f"{c}__mean").alias("mean"),
            F.col(f"{c}__std").alias("std"), F.col(f"{c}__min").alias("min"), F.col(f"{c}__q0").alias("q25"),
            F.col(f"{c}__q1").alias("q50"), F.col(f"{c}__q2").alias("q75"), F.col(f"{c}__max").alias("max"),
        )
        for c in cols
    ]
    return _long(row, structs)


def advanced_stats(df: DataFrame, cols: Sequence[str] | None = None, bias: bool = True) -> DataFrame:
    """Mean, median, mode, std, variance, skewness, kurtosis (Fisher), min, max, range,
    q1, q3, iqr per numeric column.  ``bias=True`` is the reference CLI's biased moments (D4)."""
    cols = core.numeric_columns(df, cols)
    row = _moments(df, cols).crossJoin(core.quantile_row(df, cols, [0.25, 0.5, 0.75]))
    m = core.modes(df, cols)
    mrow = m.agg(*[F.max(F.when(F.col("column") == c, F.col("mode"))).alias(f"{c}__mode") for c in cols])
    row = row.crossJoin(mrow)
    structs = []
    for c in cols:
        n = F.col(f"{c}__count").cast("double")
        g1, g2 = F.col(f"{c}__skew"), F.col(f"{c}__kurt")
        if not bias:
            g1 = g1 * F.sqrt(n * (n - 1)) / (n - 2)
            g2 = ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))
        structs.append(F.struct(
            F.lit(c).alias("column"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__q1").alias("median"),
            F.col(f"{c}__mode").alias("mode"), F.col(f"{c}__std").alias("std"), F.col(f"{c}__var").alias("variance"),
            g1.alias("skewness"), g2.alias("kurtosis"), F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"),
            (F.col(f"{c}__max") - F.col(f"{c}__min")).alias("range"), F.col(f"{c}__q0").alias("q1"),
            F.col(f"{c}__q2").alias("q3"), (F.col(f"{c}__q2") - F.col(f"{c}__q0")).alias("iqr"),
        ))
    return _long(row, structs)


def stats_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Long (metric, value): dataset_rows, dataset_columns, {col}_mean/_median/_std/_min/_max."""
    cols = core.numeric_columns(df, cols)
    row = _moments(df, cols).crossJoin(core.quantile_row(df, cols, [0.5])).crossJoin(df.agg(F.count(F.lit(1)).alias("__n")))
    structs = [
        F.struct(F.lit("dataset_rows").alias("metric"), F.col("__n").cast("double").alias("value")),
        F.struct(F.lit("dataset_columns").alias("metric"), F.lit(float(len(df.columns))).alias("value")),
    ]
    for c in cols:
        for name, src in (("mean", "mean"), ("median", "q0"), ("std", "std"), ("min", "min"), ("max", "max")):
            structs.append(F.struct(F.lit(f"{c}_{name}").alias("metric"), F.col(f"{c}__{src}").alias("value")))
    return _long(row, structs)


# ---------------------------------------------------------------------------
# A05 / A06 categorical
# ---------------------------------------------------------------------------


def value_counts(df: DataFrame, col: str, top: int | None = 10) -> DataFrame:
    """Most frequent values, ties by value ascending; NULL not counted."""
    vc = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    vc = vc.orderBy(F.desc("count"), F.asc("value"))
    return vc.limit(top) if top else vc


def categorical_summary(df: DataFrame, cols: Sequence[str] | None = None, top: int = 10):
    """(column, unique_count, most_common, missing) and the top-``top`` values per column
    (column, value, count, rank) chosen by a window over the small (column, value) count table
    partitioned by column."""
    cols = core.categorical_columns(df, cols)
    long = df.select(*cols).unpivot([], cols, "column", "value")
    counts = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    miss = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    miss_long = miss.unpivot([], cols, "column", "missing")
    modes = core.modes(df, cols, cast="string").select("column", F.col("mode").alias("most_common"))
    uniq = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    summary = miss_long.join(uniq, "column", "left").join(modes, "column", "left").select(
        "column", F.coalesce("unique_count", F.lit(0)).alias("unique_count"), "most_common", "missing"
    )
    # top values: one distributed top-k (TakeOrderedAndProject: k rows per partition, then
    # merged) per column, so a high-cardinality column is never sorted in one task; the
    # rank window runs over the k surviving rows only.
    topv = None
    for c in cols:
        t = counts.where(F.col("column") == c).orderBy(F.desc("count"), F.asc("value")).limit(top)
        t = t.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), F.asc("value"))))
        topv = t if topv is None else topv.unionByName(t)
    return summary, topv


# ---------------------------------------------------------------------------
# A08 insights
# ---------------------------------------------------------------------------


def key_insights(df: DataFrame, threshold: float = 1.5) -> DataFrame:
    """(insight, value, detail) rows: missing band (>20 % high, >5 % moderate, else good),
    duplicate rows, columns with > 5 % IQR outliers, high-cardinality (> 10 % distinct) string columns."""
    from tessera.operators.clean import flag_outliers_iqr

    num = core.numeric_columns(df)
    cat = core.categorical_columns(df)
    ncols = len(df.columns)
    miss = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    base = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(miss).alias("missing"),
        *[F.count_distinct(c).alias(f"{c}__nd") for c in cat],
    ).crossJoin(duplicate_count(df))
    pct = F.coalesce(F.col("missing"), F.lit(0)) * F.lit(100.0) / (F.col("n") * F.lit(ncols))
    band = F.when(pct > 20, F.lit("high_missing")).when(pct > 5, F.lit("moderate_missing")).otherwise(F.lit("good_quality"))
    high_card = F.concat_ws(",", F.array_compact(F.array(*[
        F.when(F.col(f"{c}__nd") > F.col("n") * F.lit(0.1), F.lit(c)) for c in cat
    ]))) if cat else F.lit("")
    rows = [
        F.struct(band.alias("insight"), pct.alias("value"), F.lit("").alias("detail")),
        F.struct(F.lit("duplicate_rows").alias("insight"), F.col("duplicates").cast("double").alias("value"),
                 F.lit("").alias("detail")),
        F.struct(F.lit("high_cardinality").alias("insight"),
                 F.lit(float(len(cat))).alias("value") if not cat else F.size(F.split(high_card, ",")).cast("double").alias("value"),
                 high_card.alias("detail")),
    ]
    out = _long(base, rows)
    out = out.withColumn("value", F.when((F.col("insight") == "high_cardinality") & (F.col("detail") == ""), F.lit(0.0))
                         .otherwise(F.col("value")))
    if num:
        fl = flag_outliers_iqr(df, num, threshold).where("flagged")
        outl = fl.agg(
            F.lit("outlier_columns").alias("insight"), F.count(F.lit(1)).cast("double").alias("value"),
            F.coalesce(F.concat_ws(",", F.array_sort(F.collect_list("column"))), F.lit("")).alias("detail"),
        )
        out = out.unionByName(outl)
    return out


# ---------------------------------------------------------------------------
# A18-A21 distributions
# ---------------------------------------------------------------------------


def histogram(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 30) -> DataFrame:
    """Equal-width bins between min and max (last bin closed), every bin listed
    (zero counts included): (column, bin, bin_start, bin_end, count)."""
    cols = core.numeric_columns(df, cols)
    rng = df.agg(*[e for c in cols for e in (F.min(c).cast("double").alias(f"{c}__mn"), F.max(c).cast("double").alias(f"{c}__mx"))])
    rng_long = _long(rng, [F.struct(F.lit(c).alias("column"), F.col(f"{c}__mn").alias("mn"), F.col(f"{c}__mx").alias("mx")) for c in cols])
    long = core.unpivot_numeric(df, cols).where(F.col("value").isNotNull())
    j = long.join(F.broadcast(rng_long), "column")  # one row per column
    w = (F.col("mx") - F.col("mn")) / F.lit(bins)
    b = F.when(F.col("mx") == F.col("mn"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("mn")) / w), F.lit(bins - 1))
    ).cast("int")
    counts = j.groupBy("column", b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng_long.select("column", "mn", "mx", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    ww = (F.col("mx") - F.col("mn")) / F.lit(bins)
    return grid.join(counts, ["column", "bin"], "left").select(
        "column", "bin", (F.col("mn") + F.col("bin") * ww).alias("bin_start"),
        (F.col("mn") + (F.col("bin") + 1) * ww).alias("bin_end"), F.coalesce("count", F.lit(0)).alias("count"),
    )


def box_stats(df: DataFrame, cols: Sequence[str] | None = None, whisker: float = 1.5) -> DataFrame:
    """q1, median, q3, whiskers (extreme data inside the fences), outlier count."""
    cols = core.numeric_columns(df, cols)
    q = core.quantile_row(df, cols, [0.25, 0.5, 0.75])
    j = core.broadcast_row(df, q)
    aggs = []
    for c in cols:
        q1, q3 = F.col(f"{c}__q0"), F.col(f"{c}__q2")
        lo, hi = q1 - F.lit(whisker) * (q3 - q1), q3 + F.lit(whisker) * (q3 - q1)
        x = F.col(c).cast("double")
        aggs += [
            F.first(q1).alias(f"{c}__a"), F.first(F.col(f"{c}__q1")).alias(f"{c}__b"), F.first(q3).alias(f"{c}__c"),
            F.min(F.when(x >= lo, x)).alias(f"{c}__wl"), F.max(F.when(x <= hi, x)).alias(f"{c}__wh"),
            F.count_if((x < lo) | (x > hi)).alias(f"{c}__o"),
        ]
    row = j.agg(*aggs)
    return _long(row, [
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__a").alias("q1"), F.col(f"{c}__b").alias("median"),
                 F.col(f"{c}__c").alias("q3"), F.col(f"{c}__wl").alias("whisker_low"),
                 F.col(f"{c}__wh").alias("whisker_high"), F.col(f"{c}__o").alias("outliers"))
        for c in cols
    ])


#: Terms of the Hermite sums of ``kde``, and bandwidths beyond which a bin adds under 1e-17.
HERMITE_TERMS = 12
KDE_REACH = 9


def _hermite_sum(z):
    """Sum of m_k / k! He_k(z) over the moments m0, m1, ... as one polynomial in z."""
    he = [[1.0], [0.0, 1.0]]
    for k in range(1, HERMITE_TERMS - 1):
        he.append([a - k * b for a, b in zip([0.0, *he[k]], [*he[k - 1], 0.0, 0.0])])
    acc = F.lit(0.0)
    for j in range(HERMITE_TERMS - 1, -1, -1):
        at = F.lit(0.0)
        for k in range(j, HERMITE_TERMS):
            if he[k][j]:
                at = at + F.col(f"m{k}") * F.lit(he[k][j] / math.factorial(k))
        acc = acc * z + at
    return acc


def kde(df: DataFrame, cols: Sequence[str] | None = None, points: int = 50) -> DataFrame:
    """Gaussian KDE on an equal grid of ``points`` between min and max; Scott bandwidth
    h = std(ddof 1) * n^-0.2: (column, grid_index, x, density).

    A fast Gauss transform: values fall into bins of width h / 2, each bin keeps the power sums
    of its values' offsets from its centre (combined before the shuffle), and a bin meets only the
    grid points within ``KDE_REACH`` bandwidths.  An offset is at most h / 4, so by Cramer's
    inequality what the series leaves out of a density is below 1e-11 / h, whatever the data.
    Values are never paired with the grid, and distinct values are never shuffled.  NaN counts as
    missing; a column with fewer than two values or without spread has no bandwidth and null densities."""
    cols = core.numeric_columns(df, cols)
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    st = df.agg(*[e for c in cols for e in (
        F.min(value[c]).alias(f"{c}__mn"), F.max(value[c]).alias(f"{c}__mx"),
        F.stddev_samp(value[c]).alias(f"{c}__sd"), F.count(value[c]).alias(f"{c}__n"))])
    st_long = _long(st, [F.struct(F.lit(c).alias("column"), F.col(f"{c}__mn").alias("mn"), F.col(f"{c}__mx").alias("mx"),
                                  F.col(f"{c}__sd").alias("sd"), F.col(f"{c}__n").alias("n")) for c in cols])
    st_long = st_long.where("n > 0").select("column", "mn", "mx", "n", F.expr("nullif(sd * power(CAST(n AS double), -0.2D), 0D)").alias("h"))
    step = (F.col("mx") - F.col("mn")) / F.lit(float(points - 1))
    grid = st_long.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("gi"))
    grid = grid.select("column", "gi", "n", "h", (F.col("mn") + (F.col("mx") - F.col("mn")) * F.col("gi") / F.lit(points - 1)).alias("x"))

    long = core.unpivot_numeric(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    binned = long.join(F.broadcast(st_long), "column").where("h IS NOT NULL")  # one row for each column
    binned = binned.withColumn("bin", F.floor((F.col("value") - F.col("mn")) / (F.col("h") / 2)))
    centre = F.col("mn") + (F.col("bin") + 0.5) * (F.col("h") / 2)
    binned = binned.select("column", "bin", ((F.col("value") - centre) / F.col("h")).alias("d"))
    power, sums = F.lit(1.0), []
    for k in range(HERMITE_TERMS):
        sums.append(F.sum(power).alias(f"m{k}"))
        power = power * F.col("d")
    bins = binned.groupBy("column", "bin").agg(*sums).join(F.broadcast(st_long), "column").withColumn("centre", centre)
    reach = KDE_REACH * F.col("h")
    first = F.greatest(F.lit(0), F.ceil((F.col("centre") - reach - F.col("mn")) / step).cast("int"))
    last = F.least(F.lit(points - 1), F.floor((F.col("centre") + reach - F.col("mn")) / step).cast("int"))
    near = bins.withColumns({"first": first, "last": last}).where("first <= last").withColumn("gi", F.explode(F.sequence("first", "last")))
    z = (F.col("mn") + (F.col("mx") - F.col("mn")) * F.col("gi") / F.lit(points - 1) - F.col("centre")) / F.col("h")
    near = near.withColumn("z", z)
    total = near.groupBy("column", "gi").agg(F.sum(F.exp(F.lit(-0.5) * F.col("z") * F.col("z")) * _hermite_sum(F.col("z"))).alias("s"))
    density = F.coalesce("s", F.lit(0.0)) / (F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))
    return grid.join(total, ["column", "gi"], "left").select("column", F.col("gi").alias("grid_index"), "x", density.alias("density"))


# Rational approximation of the inverse normal CDF (P. J. Acklam), |relative error| < 1.2e-9
PPF_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02,
         -3.066479806614716e01, 2.506628277459239e00]
PPF_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01,
         -1.328068155288572e01]
PPF_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00,
         4.374664141464968e00, 2.938163982698783e00]
PPF_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]


def _norm_ppf(p):
    """Inverse normal CDF as a Column expression (coefficients above)."""
    a, b, c, d = PPF_A, PPF_B, PPF_C, PPF_D
    plow = 0.02425

    def poly(coefs, x):
        acc = F.lit(coefs[0])
        for k in coefs[1:]:
            acc = acc * x + F.lit(k)
        return acc

    q_lo = F.sqrt(F.lit(-2.0) * F.ln(p))
    lo = poly(c, q_lo) / (poly(d, q_lo) * q_lo + F.lit(1.0))
    q_hi = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - p))
    hi = -poly(c, q_hi) / (poly(d, q_hi) * q_hi + F.lit(1.0))
    q = p - F.lit(0.5)
    r = q * q
    mid = poly(a, r) * q / (poly(b, r) * r + F.lit(1.0))
    return F.when(p < plow, lo).when(p > 1 - plow, hi).otherwise(mid)


def qq_points(df: DataFrame, col: str) -> DataFrame:
    """(i, theoretical, sample) for the ordered non-null values; plotting positions
    (i - 0.5) / n.  Positions come from counts inside ranges; each distinct value expands to its
    ``cnt`` positions, in parts of 4,096 that are dealt over tasks."""
    pos = core.value_positions(df, [col])
    last = F.col("before") + F.col("cnt")
    parts = pos.select("value", "n", last.alias("last"), F.explode(F.sequence(F.col("before") + 1, last, F.lit(4096).cast("long"))).alias("at")).repartition("at")
    ex = parts.select("value", "n", F.explode(F.sequence("at", F.least("last", F.col("at") + 4095))).alias("i"))
    p = (F.col("i") - F.lit(0.5)) / F.col("n")
    return ex.select("i", _norm_ppf(p).alias("theoretical"), F.col("value").alias("sample"))


# ---------------------------------------------------------------------------
# A22-A24 augmentation reports
# ---------------------------------------------------------------------------


def augmentation_report(original: DataFrame, augmented: DataFrame) -> DataFrame:
    """Original size, augmented size, ratio."""
    a = original.agg(F.count(F.lit(1)).alias("original_size"))
    b = augmented.agg(F.count(F.lit(1)).alias("augmented_size"))
    return a.crossJoin(b).withColumn("ratio", core.safe_div(F.col("augmented_size").cast("double"), F.col("original_size")))


def _change_pct(base, now):
    """Signed change in percent of the base; 0 for a base of 0."""
    return F.when(base != 0, (now - base) / F.when(base != 0, base) * 100).otherwise(F.when(base.isNotNull(), F.lit(0.0)))


def augmentation_quality(original: DataFrame, augmented: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Per column corr(original, augmented), signed mean and std change %, quality band."""
    j = original.select(key, *cols).alias("o").join(
        augmented.select(key, *[F.col(c).alias(f"{c}__aug") for c in cols]), key)
    aggs = []
    for c in cols:
        aggs += [F.corr(c, f"{c}__aug").alias(f"{c}__r"), F.avg(c).alias(f"{c}__m0"), F.avg(f"{c}__aug").alias(f"{c}__m1"),
                 F.stddev_samp(c).alias(f"{c}__s0"), F.stddev_samp(f"{c}__aug").alias(f"{c}__s1")]
    row = j.agg(*aggs)
    out = _long(row, [F.struct(
        F.lit(c).alias("column"), F.col(f"{c}__r").alias("correlation"),
        _change_pct(F.col(f"{c}__m0"), F.col(f"{c}__m1")).alias("mean_change_pct"),
        _change_pct(F.col(f"{c}__s0"), F.col(f"{c}__s1")).alias("std_change_pct"),
    ) for c in cols])
    r = F.col("correlation")
    return out.withColumn("quality", F.when(r > 0.95, "Excellent").when(r > 0.90, "Good").when(r > 0.80, "Fair").otherwise("Poor"))


def class_balance(before: DataFrame, after: DataFrame, target: str) -> DataFrame:
    """Counts per class before and after (full outer join of two grouped counts)."""
    b = before.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("before_count"))
    a = after.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("after_count"))
    return b.join(a, "class", "full_outer").select(
        "class", F.coalesce("before_count", F.lit(0)).alias("before_count"), F.coalesce("after_count", F.lit(0)).alias("after_count")
    )


# ---------------------------------------------------------------------------
# P03-P05, P08-P09
# ---------------------------------------------------------------------------


def identify_column_types(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """(column, role): numeric, text (distinct share > 0.1 and mean length > 10), other."""
    cols = [c for c in df.columns if c not in exclude]
    num = set(core.numeric_columns(df, cols))
    strs = [c for c in core.categorical_columns(df, cols)]
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in strs:
        aggs += [F.count_distinct(c).alias(f"{c}__nd"), F.avg(F.length(c)).alias(f"{c}__len")]
    row = df.agg(*aggs)
    structs = []
    for c in cols:
        if c in num:
            role = F.lit("numeric")
        elif c in strs:
            role = F.when((F.col(f"{c}__nd") / F.col("__n") > 0.1) & (F.col(f"{c}__len") > 10), F.lit("text")).otherwise(F.lit("categorical"))
        else:
            role = F.lit("other")
        structs.append(F.struct(F.lit(c).alias("column"), role.alias("role")))
    return _long(row, structs)


TEXT_NAMES = ("text", "content", "message", "description")


def detect_text_column(df: DataFrame) -> str:
    """A column named text/content/message/description (case-insensitive), else the first
    string column with mean length > 10, else the first string column."""
    strs = core.categorical_columns(df)
    for c in df.columns:
        if c.lower() in TEXT_NAMES and c in strs:
            return c
    if not strs:
        raise ValueError("no string column")
    row = df.agg(*[F.avg(F.length(c)).alias(c) for c in strs]).collect()[0]  # one row
    for c in strs:
        if row[c] is not None and row[c] > 10:
            return c
    return strs[0]


def text_columns(df: DataFrame) -> DataFrame:
    """P04 variant: (column, mean_length, is_text) for every string column."""
    strs = core.categorical_columns(df)
    row = df.agg(*[F.avg(F.length(c)).alias(c) for c in strs])
    return _long(row, [F.struct(F.lit(c).alias("column"), F.col(c).alias("mean_length"),
                                (F.col(c) > 10).alias("is_text")) for c in strs])


def extract_texts(df: DataFrame, key: str | None = None) -> DataFrame:
    """Every column holding at least one non-empty non-numeric value is unpivoted into
    one list of trimmed, non-empty texts: (column, text)."""
    cols = [c for c in df.columns if c != key]
    s = df.select(*([key] if key else []), *[F.col(c).cast("string").alias(c) for c in cols])
    flags = s.agg(*[F.max((F.trim(F.col(c)) != "") & F.col(c).try_cast("double").isNull()).alias(c) for c in cols])
    long = s.unpivot([key] if key else [], cols, "column", "text")
    keep = flags.unpivot([], cols, "column", "has_text").where("has_text")
    return long.join(F.broadcast(keep), "column").select(
        *([key] if key else []), "column", F.trim("text").alias("text")
    ).where(F.col("text") != "")


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly n rows, repeatable: smallest md5(key ':' seed) first (TakeOrdered)."""
    h = F.md5(F.concat_ws(":", core.key_string(*key), F.lit(str(seed))))
    return df.withColumn("__h", h).orderBy("__h").limit(n).drop("__h")


def head_sample(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """First n records as JSON by explicit order, with total rows and columns."""
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    head = df.orderBy(*order_by).limit(n).select(F.to_json(F.struct(*df.columns)).alias("record"), *order_by)
    return head.crossJoin(total).withColumn("total_columns", F.lit(len(df.columns)).cast("long"))
