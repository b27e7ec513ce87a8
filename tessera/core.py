"""Shared building blocks: ingest rules, column roles, key-hash randomness and
distributed exact order statistics (ranks, quantiles, modes).

Scale rules followed here (see README "Scale design"):
* every statistic over all columns is one aggregate pass;
* order statistics never put all values of a column into one task: mergeable sketches give
  ranges of equal shares, targets are found by counting inside their own ranges only, and
  ranks come from windows over one range;
* one-row statistics are applied back with a broadcast cross join (size bound: 1 row).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# column roles
# ---------------------------------------------------------------------------


def numeric_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Columns of a numeric type (byte..long, float, double, decimal); booleans excluded."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    names = list(cols) if cols else list(fields)
    return [c for c in names if isinstance(fields[c], T.NumericType)]


def categorical_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """String columns (pandas ``object``/``category``)."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    names = list(cols) if cols else list(fields)
    return [c for c in names if isinstance(fields[c], T.StringType)]


def require_columns(df: DataFrame, cols: Iterable[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


# ---------------------------------------------------------------------------
# ingest (D1): NaN behaves like NULL
# ---------------------------------------------------------------------------


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Turn NaN in float/double columns into NULL so aggregates skip them (pandas semantics)."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    targets = [c for c in (cols or df.columns) if isinstance(fields[c], (T.FloatType, T.DoubleType))]
    if not targets:
        return df
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in targets})


# ---------------------------------------------------------------------------
# key-hash randomness (D8): same draw for any partitioning, retry or engine
# ---------------------------------------------------------------------------

_HEX13 = float(16**13)


def key_string(*cols: str | Column) -> Column:
    return F.concat_ws(":", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan dealt over all cores where it has fewer parts than cores, as a file of one row
    group has one; a scan of more parts is left as it is.  Rows stay the same, only their places
    change.  Not for a frame with a shuffle, whose parts are only known once it has run."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def hash_uniform(key: Column, salt: str | Column) -> Column:
    """U[0,1) from the first 13 hex digits of md5(key ':' salt)."""
    salt_col = salt if isinstance(salt, Column) else F.lit(str(salt))
    h = F.md5(F.concat_ws(":", key.cast("string"), salt_col.cast("string")))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(_HEX13)


def hash_normal(key: Column, salt: str) -> Column:
    """Standard normal by Box-Muller over two hash uniforms."""
    u1 = hash_uniform(key, F.lit(f"{salt}:a"))
    u2 = hash_uniform(key, F.lit(f"{salt}:b"))
    return F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * 3.141592653589793) * u2)


def row_key(df: DataFrame, cols: Sequence[str], name: str = "_key") -> DataFrame:
    """md5 of the given columns as a row key (caller guarantees uniqueness)."""
    return df.withColumn(name, F.md5(key_string(*cols)))


# ---------------------------------------------------------------------------
# misc expression helpers
# ---------------------------------------------------------------------------


def rnd(c: Column | str, dp: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, dp)


def safe_div(a: Column, b: Column) -> Column:
    """a / b with NULL for a zero or NULL divisor (Spark is ANSI by default)."""
    return a / F.nullif(b, F.lit(0))


def unpivot_numeric(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """Long form (ids..., column, value double); NULL values kept."""
    casted = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return casted.unpivot(list(ids), list(cols), "column", "value")


def lit_table(spark, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """Small constant table built JVM-side (a local relation, no Python worker round trip).

    ``schema`` is 'name type, name type, ...'."""
    fields = [f.strip().split() for f in schema.split(",")]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in fields])
    structs = [
        F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, fields)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def broadcast_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attach a one-row statistics frame to every row (broadcast side is one row)."""
    return df.crossJoin(F.broadcast(row))


# ---------------------------------------------------------------------------
# distributed exact order statistics
# ---------------------------------------------------------------------------

#: The quantile sketch is right to one part in so many of a column's rows.
SKETCH = 10_000
#: Rows that the range around one target position may hold before it is narrowed again.
RANGE_ROWS = 2_000_000
#: Ranges into which a column's values are dealt to be ranked.
RANGES = 256
#: Ranges of order values that are uniform on [0, 1).
UNIFORM_RANGES = 4096


def _number_sql(c: str) -> str:
    return "nanvl(CAST(`" + c.replace("`", "``") + "` AS DOUBLE), NULL)"


def number(c: str) -> Column:
    """A column as double, NaN as NULL."""
    return F.expr(_number_sql(c))


def _double_sql(v: float) -> str:
    return f"{v!r}D" if math.isfinite(v) else f"double('{'-' * (v < 0)}Infinity')"


def _sketched(df: DataFrame, asked: dict[str, tuple[str, list[float]]], accuracy: int) -> dict[str, tuple[int, dict[float, float]]]:
    """One pass: per name the count of the non-null values of an SQL expression and its approximate
    quantiles at the asked probabilities, from sketches that tasks build and Spark merges."""
    aggs = []
    for name, (x, ps) in asked.items():
        listed = ", ".join(f"{float(p)!r}D" for p in ps)
        aggs += [F.expr(f"count({x})").alias(f"n:{name}"), F.expr(f"percentile_approx({x}, array({listed}), {accuracy})").alias(f"q:{name}")]
    row = df.agg(*aggs).first().asDict()
    return {name: (row[f"n:{name}"], dict(zip(ps, row[f"q:{name}"] or []))) for name, (_, ps) in asked.items()}


class _Target:
    """Positions ``low`` and ``high`` of a column with a range of values that holds them: ``below``
    rows are smaller and ``inside`` rows in it."""

    def __init__(self, column: str, p: float, n: int, span: tuple[float, float]):
        self.column, self.p, self.n, self.span = column, p, n, span
        self.pos = p * (n - 1)
        self.low, self.high = math.floor(self.pos), math.ceil(self.pos)
        self.below, self.inside = 0, n

    def rows(self) -> str:
        """SQL: the row is in the range."""
        x = _number_sql(self.column)
        return f"({x} >= {_double_sql(self.span[0])} AND {x} <= {_double_sql(self.span[1])})"


def _targets(df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int, most: int) -> list[_Target]:
    """A target per column with values and probability, with a narrow range of values.

    The sketch is off by n / accuracy positions at most; the range takes three times that, and is
    checked by exact counts.  A range of more than ``most`` rows and several values is sketched
    again by itself, so a few passes do at any size."""
    inf = float("inf")
    near, wide = 3.0 / accuracy, max(0.01, 3.0 / accuracy)
    grid = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-wide, -near, near, wide)})
    targets = []
    for c, (n, q) in _sketched(df, {c: (_number_sql(c), grid) for c in cols}, accuracy).items():
        d = near if n >= accuracy else wide if n >= 250 else 2.0
        targets += [_Target(c, p, n, (q[p - d] if p - d > 0 else -inf, q[p + d] if p + d < 1 else inf)) for p in probs if n]
    fresh = targets
    while fresh:
        counted = df.agg(*[e for k, t in enumerate(fresh) for e in (F.expr(f"count_if({_number_sql(t.column)} < {_double_sql(t.span[0])})").alias(f"b{k}"), F.expr(f"count_if({t.rows()})").alias(f"i{k}"))]).first()
        asked = {}
        for k, t in enumerate(fresh):
            t.below, t.inside = counted[f"b{k}"], counted[f"i{k}"]
            if not t.below <= t.low <= t.high < t.below + t.inside:
                raise ArithmeticError(f"the sketch of {t.column} missed position {t.pos}")
            if t.inside > most and t.span[0] < t.span[1]:
                at = [(t.pos - t.below + side * (2 + 3.0 * t.inside / accuracy)) / t.inside for side in (-1, 1)]
                asked[k] = (t, at, f"CASE WHEN {t.rows()} THEN {_number_sql(t.column)} END")
        found = _sketched(df, {str(k): (x, [min(max(a, 0.0), 1.0) for a in at]) for k, (_, at, x) in asked.items()}, accuracy) if asked else {}
        fresh = []
        for k, (t, at, _) in asked.items():
            q = list(found[str(k)][1].values())
            span = (q[0] if at[0] > 0 else t.span[0], q[-1] if at[1] < 1 else t.span[1])
            if span != t.span:
                t.span = span
                fresh.append(t)
    return targets


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int = SKETCH, most: int = RANGE_ROWS) -> DataFrame:
    """(column, pidx, p, q): exact linear-interpolated quantiles (pandas / DuckDB quantile_cont).

    1. one pass of mergeable sketches gives, per column and target, a narrow range of values;
    2. a second pass counts the rows below and inside each range: a range of one value is done;
    3. of the others, the rows inside are counted by value and the target's position is found.
    Only values of ranges that hold a target are shuffled.  The passes run when this is called;
    what comes back is a constant table of columns x probabilities.  A column without values has
    no row.
    """
    spark, probs = df.sparkSession, [float(p) for p in probs]
    schema = "column string, pidx int, p double, q double"
    targets = _targets(df, list(cols), probs, accuracy, most) if cols and probs else []
    at = {(t.column, i): t.span[0] for t in targets if t.span[0] == t.span[1] for i in (t.low, t.high)}
    open_targets = [t for t in targets if t.span[0] < t.span[1]]
    if open_targets:
        # plans of one size for any number of columns: values in long form, ranges as a small table
        held = list(dict.fromkeys(t.column for t in open_targets))
        spans = lit_table(spark, [(held.index(t.column), k, *t.span) for k, t in enumerate(open_targets)], "c int, t int, lo double, hi double")
        long = df.select(F.posexplode(F.array(*[number(c) for c in held])).alias("c", "value"))
        inside = long.join(F.broadcast(spans), "c").where((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))
        counts = inside.groupBy("t", "value").agg(F.count(F.lit(1)).alias("cnt"))
        w = Window.partitionBy("t").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        asked = lit_table(spark, [(k, i - t.below) for k, t in enumerate(open_targets) for i in sorted({t.low, t.high})], "t int, i long")
        placed = counts.withColumn("upto", F.sum("cnt").over(w)).join(F.broadcast(asked), "t")
        hit = placed.where((F.col("i") < F.col("upto")) & (F.col("i") >= F.col("upto") - F.col("cnt")))
        for r in hit.select("t", "i", "value").collect():  # two a target at most
            t = open_targets[r["t"]]
            at[t.column, r["i"] + t.below] = r["value"]
    out = []
    for t in targets:
        lo, hi = at[t.column, t.low], at[t.column, t.high]
        out.append((t.column, probs.index(t.p), t.p, lo + (t.pos - t.low) * (hi - lo) if lo != hi else lo))
    return lit_table(spark, out, schema)


def quantile_row(df: DataFrame, cols: Sequence[str], probs: Sequence[float], fmt: str = "{c}__q{i}") -> DataFrame:
    """One row with a column ``fmt.format(c=col, i=prob_index)`` per (column, probability)."""
    found = {(r["column"], r["pidx"]): r["q"] for r in exact_quantiles(df, cols, probs).collect()}
    return df.sparkSession.range(1).select(*[F.lit(found.get((c, i))).cast("double").alias(fmt.format(c=c, i=i)) for c in cols for i in range(len(probs))])


def range_cuts(df: DataFrame, cols: Sequence[str], ranges: int = RANGES) -> dict[str, list[float]]:
    """Per column ascending distinct values that cut it into at most ``ranges`` ranges of nearly
    equal size, from one pass of sketches.  A single value may outweigh a range."""
    grid = [k / ranges for k in range(1, ranges)]
    return {c: sorted(set(q.values())) for c, (_, q) in _sketched(df, {c: (_number_sql(c), grid) for c in cols}, 8 * ranges).items()}


def with_ranges(df: DataFrame, cuts: dict[str, list[float]], fmt: str = "{c}__range") -> DataFrame:
    """Adds, for each column of numbers, the range that its value lies in (binary search, in the
    JVM); NULL and NaN have one of their own."""
    from pyspark.ml.feature import Bucketizer

    inf = float("inf")
    splits = [[-inf, *[v for v in cut if abs(v) != inf], inf] for cut in cuts.values()]
    splits = [s if len(s) > 2 else [-inf, 0.0, inf] for s in splits]
    return Bucketizer(inputCols=list(cuts), outputCols=[fmt.format(c=c) for c in cuts], splitsArray=splits, handleInvalid="keep").transform(df)


def value_positions(df: DataFrame, cols: Sequence[str], masks: dict[str, Column] | None = None, ranges: int = RANGES) -> DataFrame:
    """(column, value, cnt, before, n) of every distinct non-null value: its rows, the rows of smaller
    values and the column's.  For each of ``masks`` the same over the rows where it holds, as
    ``cnt_<name>``, ``before_<name>``, ``n_<name>``.

    Values are counted before they are shuffled and ranked inside (column, range) windows, with
    offsets from one row per range; the ranges come from the data, so they hold equal shares.
    """
    masks = masks or {}
    wide = df.select(*[number(c).alias(f"v{j}") for j, c in enumerate(cols)], *[m.alias(f"m{k}") for k, m in enumerate(masks.values())])
    cuts = range_cuts(wide, [f"v{j}" for j in range(len(cols))], ranges)
    dealt = with_ranges(wide, cuts)
    rows = [F.struct(F.lit(j).alias("c"), F.col(f"v{j}").alias("value"), F.col(f"v{j}__range").alias("rng"), *[F.col(f"m{k}") for k in range(len(masks))]) for j in range(len(cols))]
    sums = {"": F.count(F.lit(1))} | {f"_{name}": F.count_if(F.col(f"m{k}")) for k, name in enumerate(masks)}
    counts = dealt.select(F.inline(F.array(*rows))).where("value IS NOT NULL").groupBy("c", "rng", "value").agg(*[agg.alias(f"cnt{s}") for s, agg in sums.items()])
    per_range = counts.groupBy("c", "rng").agg(*[F.sum(f"cnt{s}").alias(f"r{s}") for s in sums])
    upto = Window.partitionBy("c").orderBy("rng").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("c")
    offsets = per_range.select("c", "rng", *[e for s in sums for e in ((F.sum(f"r{s}").over(upto) - F.col(f"r{s}")).alias(f"off{s}"), F.sum(f"r{s}").over(whole).alias(f"n{s}"))])
    inner = Window.partitionBy("c", "rng").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = counts.withColumns({f"in{s}": F.sum(f"cnt{s}").over(inner) - F.col(f"cnt{s}") for s in sums})
    return local.join(offsets, ["c", "rng"]).select(F.get(F.array(*[F.lit(c) for c in cols]), "c").alias("column"), "value", *[e for s in sums for e in (F.col(f"cnt{s}"), (F.col(f"off{s}") + F.col(f"in{s}")).alias(f"before{s}"), F.col(f"n{s}"))])


def value_counts_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, cnt) of the non-null values of numeric columns (map-side combined)."""
    long = unpivot_numeric(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))  # NaN counts as missing (D1)
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))


def average_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, rank) with pandas 'average' tie rule, 1-based."""
    return value_positions(df, cols).select("column", "value", (F.col("before") + (F.col("cnt") + F.lit(1)) / F.lit(2.0)).alias("rank"))


def group_positions(df: DataFrame, group: Sequence[str], order_value: Column, tie: Sequence[str] = (), uniform: bool = True) -> DataFrame:
    """Adds ``__rn`` (1-based position inside the group by a double order value) and ``__n`` (group
    size).  Each row has a position of its own: equal order values are told apart by ``tie``, or
    by a hash of all columns (rows that are equal in all of them are interchangeable).

    A group is parted into ranges of the order value, so no task sorts a whole group: fixed ones
    where it is ``uniform`` on [0, 1), as a key hash is, or else ranges taken from the data.
    """
    g = F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in group]) if group else F.lit("")
    d = df.withColumns({"__gp_g": g, "__gp_v": order_value.cast("double")})
    if uniform:
        d = d.withColumn("__gp_r", F.floor(F.col("__gp_v") * UNIFORM_RANGES))
    else:
        d = with_ranges(d, range_cuts(d, ["__gp_v"]), "__gp_r")
    order = [F.col("__gp_v"), *([F.col(c) for c in tie] or [F.xxhash64(*df.columns)])]
    sizes = d.groupBy("__gp_g", "__gp_r").agg(F.count(F.lit(1)).alias("__gp_c"))
    upto = Window.partitionBy("__gp_g").orderBy("__gp_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.select("__gp_g", "__gp_r", (F.sum("__gp_c").over(upto) - F.col("__gp_c")).alias("__gp_off"), F.sum("__gp_c").over(Window.partitionBy("__gp_g")).alias("__n"))
    placed = d.withColumn("__gp_i", F.row_number().over(Window.partitionBy("__gp_g", "__gp_r").orderBy(*order))).join(offsets, ["__gp_g", "__gp_r"])
    return placed.withColumn("__rn", F.col("__gp_off") + F.col("__gp_i")).drop("__gp_g", "__gp_v", "__gp_r", "__gp_i", "__gp_off")


def modes(df: DataFrame, cols: Sequence[str], cast: str = "double") -> DataFrame:
    """(column, mode, mode_count): most frequent non-null value, smallest on ties.

    Two partial-aggregate passes (max count per column, then min value at that count);
    no window over a whole column.
    """
    casted = df.select(*[F.col(c).cast(cast).alias(c) for c in cols])
    long = casted.unpivot([], list(cols), "column", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    top = counts.groupBy("column").agg(F.max("cnt").alias("mode_count"))
    return (
        counts.join(F.broadcast(top), "column")
        .where(F.col("cnt") == F.col("mode_count"))
        .groupBy("column")
        .agg(F.min("value").alias("mode"), F.first("mode_count").alias("mode_count"))
    )
