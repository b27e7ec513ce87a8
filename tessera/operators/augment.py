"""Repeatable augmentation of numeric and text datasets.

All randomness is a function of (row key, copy, column, salt) through md5 (D8): the same
draw for any partitioning, retry or engine, so results are oracle-checkable and survive
executor loss.  Statistics come from one aggregate row applied by a broadcast cross join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import core
from tessera.functions import dictionaries as D
from tessera.functions import text as T


def _key(key: str | Sequence[str]) -> Column:
    return core.key_string(*([key] if isinstance(key, str) else key))


# ---------------------------------------------------------------------------
# numeric (G01-G04, G07, G16)
# ---------------------------------------------------------------------------


def noise_rows(df: DataFrame, key: str, cols: Sequence[str] | None = None, noise_factor: float = 0.1,
               augmentation_factor: int = 2) -> DataFrame:
    """The original rows (copy 0) plus ``augmentation_factor`` noisy copies; each copy adds
    N(0, (noise_factor * std_pop)^2) per numeric column.  NULLs are skipped in the std and stay
    NULL (D23)."""
    if noise_factor <= 0 or augmentation_factor < 1:
        raise ValueError("noise_factor must be > 0 and augmentation_factor >= 1")
    cols = [c for c in core.numeric_columns(df, cols) if c != key]
    stats = df.agg(*[F.stddev_pop(c).alias(f"{c}__sd") for c in cols])
    rows = core.broadcast_row(df, stats).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(augmentation_factor))))
    k = F.concat_ws(":", _key(key), F.col("copy").cast("string"))
    exprs = {
        c: F.when(F.col("copy") == 0, F.col(c).cast("double")).otherwise(
            F.col(c) + core.hash_normal(k, f"noise:{c}") * F.lit(noise_factor) * F.col(f"{c}__sd"))
        for c in cols
    }
    return rows.withColumns(exprs).drop(*[f"{c}__sd" for c in cols])


def noise_columns(df: DataFrame, key: str, cols: Sequence[str] | None = None, noise_level: float = 0.01) -> DataFrame:
    """Adds ``{col}_noisy`` = x + N(0, (noise_level * std_samp)^2)."""
    cols = [c for c in core.numeric_columns(df, cols) if c != key]
    stats = df.agg(*[F.stddev_samp(c).alias(f"{c}__sd") for c in cols])
    j = core.broadcast_row(df, stats)
    exprs = {f"{c}_noisy": F.col(c) + core.hash_normal(_key(key), f"noisy:{c}") * F.lit(noise_level) * F.col(f"{c}__sd")
             for c in cols}
    return j.withColumns(exprs).drop(*[f"{c}__sd" for c in cols])


def scale_jitter(df: DataFrame, key: str, cols: Sequence[str] | None = None, scale_min: float = 0.8,
                 scale_max: float = 1.2, jitter: float = 0.1) -> DataFrame:
    """X * U(scale_min, scale_max) + N(0, (jitter * std_pop of the scaled column)^2), in place."""
    cols = [c for c in core.numeric_columns(df, cols) if c != key]
    scaled = df.withColumns({
        c: F.col(c) * (F.lit(scale_min) + (F.lit(scale_max) - F.lit(scale_min)) * core.hash_uniform(_key(key), F.lit(f"scale:{c}")))
        for c in cols})
    stats = scaled.agg(*[F.stddev_pop(c).alias(f"{c}__sd") for c in cols])
    j = core.broadcast_row(scaled, stats)
    exprs = {c: F.col(c) + core.hash_normal(_key(key), f"jitter:{c}") * F.lit(jitter) * F.col(f"{c}__sd") for c in cols}
    return j.withColumns(exprs).drop(*[f"{c}__sd" for c in cols])


def scale_jitter_columns(df: DataFrame, key: str, cols: Sequence[str] | None = None, scale_min: float = 0.95,
                         scale_max: float = 1.05, jitter: float = 0.01) -> DataFrame:
    """Adds ``{col}_scaled_jittered``; jitter std from std_samp of the original column."""
    cols = [c for c in core.numeric_columns(df, cols) if c != key]
    stats = df.agg(*[F.stddev_samp(c).alias(f"{c}__sd") for c in cols])
    j = core.broadcast_row(df, stats)
    exprs = {}
    for c in cols:
        u = core.hash_uniform(_key(key), F.lit(f"sj-scale:{c}"))
        exprs[f"{c}_scaled_jittered"] = (F.col(c) * (F.lit(scale_min) + (F.lit(scale_max - scale_min)) * u)
                                         + core.hash_normal(_key(key), f"sj-jitter:{c}") * F.lit(jitter) * F.col(f"{c}__sd"))
    return j.withColumns(exprs).drop(*[f"{c}__sd" for c in cols])


def inject_outliers(df: DataFrame, key: str, cols: Sequence[str] | None = None, ratio: float = 0.05,
                    strength: float = 3.0) -> DataFrame:
    """Rows with hash-uniform < ratio get x + sign * strength * std_pop (sign by hash);
    adds ``is_injected``."""
    cols = [c for c in core.numeric_columns(df, cols) if c != key]
    stats = df.agg(*[F.stddev_pop(c).alias(f"{c}__sd") for c in cols])
    j = core.broadcast_row(df, stats)
    chosen = core.hash_uniform(_key(key), F.lit("outlier:pick")) < F.lit(ratio)
    sign = F.when(core.hash_uniform(_key(key), F.lit("outlier:sign")) < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))
    exprs = {c: F.when(chosen, F.col(c) + sign * F.lit(strength) * F.col(f"{c}__sd")).otherwise(F.col(c).cast("double"))
             for c in cols}
    return j.withColumns(exprs).withColumn("is_injected", chosen).drop(*[f"{c}__sd" for c in cols])


def modality_dropout(df: DataFrame, key: str, groups: Mapping[str, Sequence[str]], rate: float = 0.1) -> DataFrame:
    """Per row and column group, NULL the whole group with probability ``rate``."""
    exprs = {}
    for g, cols in groups.items():
        drop = core.hash_uniform(_key(key), F.lit(f"dropout:{g}")) < F.lit(rate)
        for c in cols:
            exprs[c] = F.when(~drop, F.col(c))
    return df.withColumns(exprs)


# ---------------------------------------------------------------------------
# partners (J05) and SMOTE
# ---------------------------------------------------------------------------


def partner_rows(df: DataFrame, key: str, group: str | None = None, salt: str = "partner") -> DataFrame:
    """For each row a different random row of the same group (or of the whole frame):
    rows numbered by hash inside the group, partner index (i + 1 + h % (n - 1)) % n, then an
    equi-join on (group, index).  Groups with one row get no partner.  Adds ``partner_key``."""
    g = [group] if group else []
    # positions inside the group in hash order from bucketed prefix counts: a large group is
    # never sorted in one task
    numbered = core.group_positions(df, g, core.hash_uniform(_key(key), F.lit(salt)), [key])
    numbered = numbered.withColumn("__i", F.col("__rn") - 1).drop("__rn")
    r = F.conv(F.substring(F.md5(F.concat_ws(":", _key(key), F.lit(salt + ":pick"))), 1, 12), 16, 10).cast("long")
    numbered = numbered.withColumn(
        "__pi", F.when(F.col("__n") > 1, (F.col("__i") + 1 + r % (F.col("__n") - 1)) % F.col("__n")))
    right = numbered.select(*[F.col(c).alias(f"__p_{c}") for c in g], F.col("__i").alias("__pj"), F.col(key).alias("partner_key"))
    cond = [F.col("__pi") == F.col("__pj")] + [F.col(c) == F.col(f"__p_{c}") for c in g]
    out = numbered.join(right, cond, "left")
    return out.drop("__i", "__n", "__pi", "__pj", *[f"__p_{c}" for c in g])


def smote_validate(df: DataFrame, target: str, max_distinct_ratio: float = 0.5) -> DataFrame:
    """One row of checks: target nulls, distinct ratio, class count, smallest class."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(target).isNull()).alias("null_targets"),
                 F.count_distinct(target).alias("classes"))
    mins = counts.agg(F.min("n").alias("smallest_class"), F.max("n").alias("largest_class"))
    out = row.crossJoin(mins)
    ok = ((F.col("null_targets") == 0) & (F.col("classes") / F.col("rows") <= F.lit(max_distinct_ratio))
          & (F.col("classes") >= 2) & (F.col("smallest_class") >= 2))
    return out.withColumn("valid", ok)


def knn_within_class(df: DataFrame, key: str, label: str, vec: str, k: int = 5) -> DataFrame:
    """Exact k nearest neighbours (Euclidean, not self) inside each class:
    (key, neighbour, rank, distance), by pivots and cells (``neighbours.nearest``)."""
    from tessera.operators.neighbours import nearest

    return nearest(df, key, label, vec, k)


def smote(df: DataFrame, key: str, target: str, cols: Sequence[str], k: int = 5, salt: str = "smote") -> DataFrame:
    """Raise every smaller class to the size of the largest.  Synthetic row j of class c:
    base = row number (h1 % n_c) of the class, neighbour = one of its k' = min(k, n - 1)
    (n = size of the smallest class, one k' for all; a smallest class of one row is an error)
    nearest neighbours chosen by hash, point = x + u * (nn - x) with u = hash uniform.
    Rows with a NULL feature are dropped first (D13); other columns come from the base row
    (D14 'base').  Output: originals (synthetic = false) union synthetic rows."""
    feats = list(cols)
    clean = df.na.drop(subset=feats + [target])
    counts = clean.groupBy(target).agg(F.count(F.lit(1)).alias("__n"))
    mx = counts.agg(F.max("__n").alias("__mx"))
    need = counts.crossJoin(F.broadcast(mx)).select(target, "__n", (F.col("__mx") - F.col("__n")).alias("__need")).where("__need > 0")
    # base rows numbered inside their class in key-hash order (bucketed positions, no
    # per-class sort in one task)
    numbered = core.group_positions(clean, [target], core.hash_uniform(_key(key), F.lit(salt + ":order")), [key])
    numbered = numbered.withColumn("__i", F.col("__rn") - 1).drop("__rn", "__n")
    vec = F.array(*[F.col(c).cast("double") for c in feats])
    # only classes that need rows get neighbours
    # the classes needing rows: no forced broadcast (AQE broadcasts it after measuring it)
    minority = numbered.join(need.select(target), target, "left_semi").withColumn("__v", vec)
    nn = knn_within_class(minority, key, target, "__v", k)
    least = F.min("__n")
    kk = counts.agg(F.when(least < 2, F.raise_error(F.lit("a class of one row has no neighbours"))).otherwise(F.least(least - 1, F.lit(k))).alias("__k"))
    # numbers of the new rows, in parts of 4,096 that are dealt over tasks
    parts = need.crossJoin(F.broadcast(kk)).select(target, "__n", "__k", "__need", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__need"), F.lit(4096).cast("long"))).alias("__from")).repartition(target, "__from")
    syn = parts.select(target, "__n", "__k", F.explode(F.sequence("__from", F.least("__need", F.col("__from") + 4095))).alias("__j"))
    sk = F.concat_ws(":", F.col(target).cast("string"), F.col("__j").cast("string"))
    h1 = F.conv(F.substring(F.md5(F.concat_ws(":", sk, F.lit(salt + ":base"))), 1, 12), 16, 10).cast("long")
    h2 = F.conv(F.substring(F.md5(F.concat_ws(":", sk, F.lit(salt + ":nn"))), 1, 12), 16, 10).cast("long")
    syn = syn.select(target, "__j", (h1 % F.col("__n")).alias("__i"), (h2 % F.col("__k") + 1).alias("__r"),
                     core.hash_uniform(sk, F.lit(salt + ":gap")).alias("__u"))
    base = syn.join(minority, [target, "__i"])
    nb = nn.select(F.col("key").alias(key), F.col("neighbour").alias("__nk"), F.col("rank").alias("__r"))
    base = base.join(nb, [key, "__r"])
    nbv = minority.select(F.col(key).alias("__nk"), F.col("__v").alias("__nv"))
    base = base.join(nbv, "__nk")
    point = F.zip_with("__v", "__nv", lambda x, y: x + F.col("__u") * (y - x))
    synth = base.withColumn("__p", point).withColumns({c: F.col("__p")[i] for i, c in enumerate(feats)})
    synth = synth.withColumn(key, F.concat_ws(":", F.lit("syn"), F.col(target).cast("string"), F.col("__j").cast("string")))
    out_cols = clean.columns
    orig = clean.select(*[F.col(c).cast("double") if c in feats else F.col(c) for c in out_cols]).withColumn("synthetic", F.lit(False))
    orig = orig.withColumn(key, F.col(key).cast("string"))
    synth = synth.select(*[F.col(c) for c in out_cols]).withColumn("synthetic", F.lit(True))
    return orig.unionByName(synth)


# ---------------------------------------------------------------------------
# text (G08-G15)
# ---------------------------------------------------------------------------


def _content_mask(toks: Column, stopwords=D.STOPWORDS_EN) -> Column:
    sw = list(stopwords)
    return F.transform(toks, lambda t: t.rlike(r"(?U)^\p{L}+$") & ~F.lower(t).isin(*sw))


def _positions(flags: Column) -> Column:
    """1-based positions where a boolean array is true."""
    return F.filter(F.transform(flags, lambda f, i: F.when(f, i + 1)), lambda x: x.isNotNull())


def _pick(arr: Column, u: Column) -> Column:
    return F.try_element_at(arr, (F.floor(u * F.size(arr)) + 1).cast("int"))


# Each step below is its own projection (withColumn) so that no array expression is
# re-evaluated inside a per-element lambda: every operator stays linear in the text length.


def random_deletion(df: DataFrame, key: str, text_col: str, out: str | None = None) -> DataFrame:
    """Delete one hash-chosen content word (alphabetic, not a stop word); any token if
    there is none; texts with <= 1 token unchanged."""
    d = df.withColumn("__tok", T.tokenize_words(F.col(text_col)))
    d = d.withColumn("__cand", _positions(_content_mask(F.col("__tok"))))
    d = d.withColumn("__cand", F.when(F.size("__cand") > 0, F.col("__cand")).otherwise(
        F.sequence(F.lit(1), F.greatest(F.size("__tok"), F.lit(1)))))
    d = d.withColumn("__pick", _pick(F.col("__cand"), core.hash_uniform(_key(key), F.lit("delete"))))
    kept = F.filter("__tok", lambda t, i: (i + 1) != F.col("__pick"))
    res = F.when(F.size("__tok") <= 1, F.col("__tok")).otherwise(kept)
    return d.withColumn(out or f"{text_col}_augmented", T.detokenize(res)).drop("__tok", "__cand", "__pick")


def random_swap(df: DataFrame, key: str, text_col: str, out: str | None = None) -> DataFrame:
    """Swap two hash-chosen alphabetic tokens (positions i != j); fewer than two -> unchanged."""
    d = df.withColumn("__tok", T.tokenize_words(F.col(text_col)))
    d = d.withColumn("__alpha", _positions(F.transform("__tok", lambda t: t.rlike(r"(?U)^\p{L}+$"))))
    n = F.size("__alpha")
    u1 = core.hash_uniform(_key(key), F.lit("swap:a"))
    u2 = core.hash_uniform(_key(key), F.lit("swap:b"))
    a = F.floor(u1 * n).cast("int")
    b = ((a + 1 + F.floor(u2 * (n - 1)).cast("int")) % n).cast("int")
    d = d.withColumn("__pa", F.try_element_at("__alpha", a + 1)).withColumn("__pb", F.try_element_at("__alpha", b + 1))
    d = d.withColumn("__ta", F.try_element_at("__tok", F.col("__pa"))).withColumn("__tb", F.try_element_at("__tok", F.col("__pb")))
    swapped = F.transform("__tok", lambda t, i: F.when(i + 1 == F.col("__pa"), F.col("__tb"))
                          .when(i + 1 == F.col("__pb"), F.col("__ta")).otherwise(t))
    res = F.when(n >= 2, swapped).otherwise(F.col("__tok"))
    return d.withColumn(out or f"{text_col}_augmented", T.detokenize(res)).drop("__tok", "__alpha", "__pa", "__pb", "__ta", "__tb")


def _synonym_map(synonyms: Mapping[str, Sequence[str]]) -> Column:
    keys = list(synonyms)
    return F.map_from_arrays(F.array(*[F.lit(k) for k in keys]),
                             F.array(*[F.array(*[F.lit(s) for s in synonyms[k]]) for k in keys]))


def synonym_replace(df: DataFrame, key: str, text_col: str, p: float = 0.3,
                    synonyms: Mapping[str, Sequence[str]] | DataFrame = D.SYNONYMS, out: str | None = None) -> DataFrame:
    """Each alphabetic non-stop word that has synonyms (other than itself) is replaced
    with probability p by a hash-chosen synonym; adds ``{col}_augmented``.

    ``synonyms`` is a mapping, or a table (word, synonym, rank) of any size such as
    ``synonyms.synonym_candidates`` gives, which is joined with the words of the texts; ``key`` then
    names a row."""
    d = df.withColumn("__tok", T.tokenize_words(F.col(text_col)))
    sw = list(D.STOPWORDS_EN)
    none = F.array().cast("array<string>")
    if isinstance(synonyms, DataFrame):
        from tessera.operators.text import values_by_word

        lists = synonyms.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "synonym"))), lambda s: s["synonym"]).alias("__cands"))
        words = d.select(_key(key).alias("__id"), F.transform("__tok", lambda t: F.lower(t)).alias("__low"))
        d = d.withColumn("__id", _key(key)).join(values_by_word(words, "__id", "__low", lists, "__cands"), "__id", "left").drop("__id")
        held = lambda t, i: F.get("__cands", i)
    else:
        m = _synonym_map(synonyms)
        held = lambda t, i: F.try_element_at(m, F.lower(t))

    def rep(t, i):
        cands = F.filter(F.coalesce(held(t, i), none), lambda s: s != F.lower(t))
        k = F.concat_ws(":", _key(key), i.cast("string"))
        take = (t.rlike(r"(?U)^\p{L}+$") & ~F.lower(t).isin(*sw) & (F.size(cands) > 0)
                & (core.hash_uniform(k, F.lit("syn:p")) < F.lit(p)))
        return F.when(take, _pick(cands, core.hash_uniform(k, F.lit("syn:c")))).otherwise(t)

    return d.withColumn(out or f"{text_col}_augmented", T.detokenize(F.transform("__tok", rep))).drop("__tok", "__cands")


def random_insertion(df: DataFrame, key: str, text_col: str, synonyms: Mapping[str, Sequence[str]] = D.SYNONYMS,
                     out: str | None = None) -> DataFrame:
    """Insert a synonym of a hash-chosen content word (one that has synonyms) at a
    hash-chosen position; texts with <= 1 token or no such word unchanged."""
    m = _synonym_map(synonyms)
    sw = list(D.STOPWORDS_EN)
    d = df.withColumn("__tok", T.tokenize_words(F.col(text_col)))
    d = d.withColumn("__has", _positions(F.transform(
        "__tok", lambda t: t.rlike(r"(?U)^\p{L}+$") & ~F.lower(t).isin(*sw) & F.try_element_at(m, F.lower(t)).isNotNull())))
    u1 = core.hash_uniform(_key(key), F.lit("ins:word"))
    u2 = core.hash_uniform(_key(key), F.lit("ins:syn"))
    u3 = core.hash_uniform(_key(key), F.lit("ins:pos"))
    d = d.withColumn("__w", F.lower(F.try_element_at("__tok", _pick(F.col("__has"), u1))))
    d = d.withColumn("__s", _pick(F.try_element_at(m, F.col("__w")), u2))
    pos = F.floor(u3 * (F.size("__tok") + 1)).cast("int")
    inserted = F.concat(F.slice("__tok", 1, pos), F.array("__s"), F.slice("__tok", pos + 1, F.size("__tok")))
    res = F.when((F.size("__tok") > 1) & (F.size("__has") > 0), inserted).otherwise(F.col("__tok"))
    return d.withColumn(out or f"{text_col}_augmented", T.detokenize(res)).drop("__tok", "__has", "__w", "__s")


def context_candidates(df: DataFrame, text_col: str, top: int = 5) -> DataFrame:
    """G13 re-aimed: (left, right, word, count, rank) - the ``top`` most frequent middle words
    for each (left, right) context over the corpus, by a window over the context-count table
    partitioned by context."""
    toks = df.select(T.tokenize_words(F.lower(F.coalesce(F.col(text_col), F.lit("")))).alias("__tk"))
    tri = toks.select(F.explode(T.safe_ngrams(F.col("__tk"), 3, "\u0001")).alias("g"))
    parts = F.split("g", "\u0001")
    ctx = tri.where(parts[1].rlike(r"(?U)^\p{L}+$")).select(F.struct(parts[0].alias("left"), parts[2].alias("right")).alias("c"), parts[1].alias("word"))
    # dealt by context once, for the counts and the ranks; most (left, word, right) occur only once in a task
    counts = ctx.repartition("c").groupBy("c", "word").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("c").orderBy(F.desc("count"), "word")
    ranked = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.select("c.left", "c.right", "word", "count", "rank")


def masked_word_replace(df: DataFrame, key: str, text_col: str, top: int = 5, out: str | None = None) -> DataFrame:
    """Mask one hash-chosen inner content word; candidates are the corpus' most frequent
    words in the same (left, right) context; one that is not the word itself is picked by
    hash; no candidate -> unchanged.  Candidates join on the context (a table bounded by
    distinct contexts x ``top``)."""
    d = df.withColumn("__t", T.tokenize_words(F.lower(F.coalesce(F.col(text_col), F.lit("")))))
    d = d.withColumn("__inner", F.filter(_positions(_content_mask(F.col("__t"))),
                                         lambda i: (i > 1) & (i < F.size("__t"))))
    u = core.hash_uniform(_key(key), F.lit("mlm:pos"))
    d = d.withColumn("__pos", F.when(F.size("__inner") > 0, _pick(F.col("__inner"), u)))
    spot = F.struct(F.try_element_at("__t", F.col("__pos") - 1).alias("l"), F.try_element_at("__t", F.col("__pos") + 1).alias("r"),
                    F.try_element_at("__t", F.col("__pos")).alias("w"))
    # as a generated row, through which the join does not push its tests of the context: each would
    # repeat the steps above for every row
    asked = d.select(key, F.explode(F.array(spot)).alias("__m")).select(key, F.col("__m.l").alias("__l"), F.col("__m.r").alias("__r"), F.col("__m.w").alias("__w"))
    cands = context_candidates(df, text_col, top).select(F.col("left").alias("__l"), F.col("right").alias("__r"),
                                                         F.col("word").alias("__c"))
    j = asked.join(cands, ["__l", "__r"]).where(F.col("__c") != F.col("__w"))
    pick = j.groupBy(key).agg(F.min_by("__c", F.md5(F.concat_ws(":", _key(key), F.col("__c")))).alias("__new"))
    res = d.join(pick, key, "left")
    new_toks = F.transform("__t", lambda t, i: F.when((i + 1 == F.col("__pos")) & F.col("__new").isNotNull(), F.col("__new")).otherwise(t))
    return res.withColumn(out or f"{text_col}_augmented", T.detokenize(new_toks)).drop(
        "__t", "__inner", "__pos", "__new")
