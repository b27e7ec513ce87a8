"""Text mixup (G14, G15): blend an embedding with a random partner's and keep whichever of
the two texts is nearer (cosine) to the blend.  Partners come from J05 (hash numbering and
an equi-join), so no pair enumeration is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import core
from tessera.functions import text as T
from tessera.operators.augment import partner_rows
from tessera.operators.relational import blend_expr, cosine_expr


def text_mixup(df: DataFrame, key: str, text_col: str, vec: str, alpha_lo: float = 0.3, alpha_hi: float = 0.7) -> DataFrame:
    """Alpha ~ U(lo, hi) by hash; mixed = a*x + (1-a)*y; result text = nearer of the two;
    empty texts unchanged."""
    p = partner_rows(df.select(key, text_col, vec), key)
    other = df.select(F.col(key).alias("partner_key"), F.col(text_col).alias("__pt"), F.col(vec).alias("__pv"))
    j = p.join(other, "partner_key", "left")
    a = F.lit(alpha_lo) + F.lit(alpha_hi - alpha_lo) * core.hash_uniform(core.key_string(key), F.lit("mixup:alpha"))
    j = j.withColumn("alpha", a).withColumn("__mix", blend_expr(vec, "__pv", F.col("alpha")))
    near_self = cosine_expr("__mix", vec) >= cosine_expr("__mix", "__pv")
    res = F.when((F.length(text_col) == 0) | F.col("__pv").isNull(), F.col(text_col)).when(near_self, F.col(text_col)).otherwise(F.col("__pt"))
    return j.select(key, "partner_key", "alpha", res.alias("augmented"))


def hashed_bag(text_col: str, dims: int = 64):
    """A fixed-size bag-of-words vector per text (hash of each lower-cased word mod dims)."""
    toks = T.alpha_lower(T.tokenize_words(text_col))
    idx = F.transform(toks, lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)),
                       lambda i: F.size(F.filter(idx, lambda x: x == i)).cast("double"))


def text_mixup_batch(df: DataFrame, key: str, text_col: str, alpha: float = 0.2) -> DataFrame:
    """alpha_used = clip(alpha +- 0.1 by hash, 0.1, 0.9) rounded to 3 dp; output id,
    original, augmented, alpha_used, mixed_with (partner key); needs >= 2 texts."""
    v = df.withColumn("__v", hashed_bag(text_col))
    m = text_mixup(v, key, text_col, "__v", alpha - 0.1, alpha + 0.1)
    m = m.withColumn("alpha_used", F.round(F.least(F.greatest(F.col("alpha"), F.lit(0.1)), F.lit(0.9)), 3))
    orig = df.select(key, F.col(text_col).alias("original"))
    return m.join(orig, key).select(F.col(key).alias("id"), "original", "augmented", "alpha_used",
                                    F.col("partner_key").alias("mixed_with"))
