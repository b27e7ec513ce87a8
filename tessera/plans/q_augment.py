"""Plans for numeric and text augmentation, partners, kNN and SMOTE (G01-G11, G13, G16,
J04, J05, A22-A24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import augment as G
from tessera.operators import profile
from tessera.plans.common import round_doubles, sql_normal, sql_unit_hash
from tessera.plans.q_text import sql_word_tokens, sq
from tessera.plans.registry import plan, table


def _k(col: str) -> str:
    return f"{col}::VARCHAR"


# ---------------------------------------------------------------------------
# G01-G04, G07, G16 numeric
# ---------------------------------------------------------------------------


@plan("noise_rows", (
    "SELECT o_orderkey, c.copy::INTEGER AS copy, round(CASE WHEN c.copy = 0 THEN o_totalprice ELSE o_totalprice + "
    + sql_normal("concat_ws(':', o_orderkey::VARCHAR, c.copy::VARCHAR)", "noise:o_totalprice")
    + " * 0.1 * sd END, 6) AS o_totalprice FROM orders, (SELECT stddev_pop(o_totalprice) AS sd FROM orders) s, range(0, 3) c(copy)"),
    ("G01", "U01", "D8", "D23"))
def q_noise_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return round_doubles(G.noise_rows(o, "o_orderkey", ["o_totalprice"], 0.1, 2).select("o_orderkey", "copy", "o_totalprice"))


@plan("noise_columns", (
    "SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal, round(c_acctbal + " + sql_normal(_k("c_custkey"), "noisy:c_acctbal")
    + " * 0.01 * sd, 6) AS c_acctbal_noisy FROM customer, (SELECT stddev_samp(c_acctbal) AS sd FROM customer)"), ("G02",))
def q_noise_cols(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return round_doubles(G.noise_columns(c, "c_custkey", ["c_acctbal"], 0.01))


@plan("scale_jitter", (
    "WITH s AS (SELECT o_orderkey, o_totalprice * (0.8 + (1.2 - 0.8) * " + sql_unit_hash(_k("o_orderkey"), "'scale:o_totalprice'")
    + ") AS o_totalprice FROM orders) SELECT o_orderkey, round(o_totalprice + " + sql_normal(_k("o_orderkey"), "jitter:o_totalprice")
    + " * 0.1 * sd, 6) AS o_totalprice FROM s, (SELECT stddev_pop(o_totalprice) AS sd FROM s)"), ("G03",))
def q_scale_jitter(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return round_doubles(G.scale_jitter(o, "o_orderkey", ["o_totalprice"], 0.8, 1.2, 0.1))


@plan("scale_jitter_columns", (
    "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice, round(o_totalprice * (0.95 + 0.1 * "
    + sql_unit_hash(_k("o_orderkey"), "'sj-scale:o_totalprice'") + ") + " + sql_normal(_k("o_orderkey"), "sj-jitter:o_totalprice")
    + " * 0.01 * sd, 6) AS o_totalprice_scaled_jittered FROM orders, (SELECT stddev_samp(o_totalprice) AS sd FROM orders)"), ("G04",))
def q_scale_jitter_cols(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return round_doubles(G.scale_jitter_columns(o, "o_orderkey", ["o_totalprice"], 0.95, 1.05, 0.01))


@plan("inject_outliers", (
    "SELECT o_orderkey, round(CASE WHEN " + sql_unit_hash(_k("o_orderkey"), "'outlier:pick'") + " < 0.05 THEN o_totalprice + "
    "(CASE WHEN " + sql_unit_hash(_k("o_orderkey"), "'outlier:sign'") + " < 0.5 THEN -1.0 ELSE 1.0 END) * 3.0 * sd "
    "ELSE o_totalprice END, 6) AS o_totalprice, " + sql_unit_hash(_k("o_orderkey"), "'outlier:pick'") + " < 0.05 AS is_injected "
    "FROM orders, (SELECT stddev_pop(o_totalprice) AS sd FROM orders)"), ("G07",))
def q_inject(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return round_doubles(G.inject_outliers(o, "o_orderkey", ["o_totalprice"], 0.05, 3.0))


@plan("modality_dropout", (
    "SELECT o_orderkey, CASE WHEN " + sql_unit_hash(_k("o_orderkey"), "'dropout:price'") + " < 0.1 THEN NULL ELSE o_totalprice END AS o_totalprice, "
    "CASE WHEN " + sql_unit_hash(_k("o_orderkey"), "'dropout:status'") + " < 0.1 THEN NULL ELSE o_orderstatus END AS o_orderstatus, "
    "CASE WHEN " + sql_unit_hash(_k("o_orderkey"), "'dropout:status'") + " < 0.1 THEN NULL ELSE o_orderpriority END AS o_orderpriority "
    "FROM orders"), ("G16",))
def q_dropout(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return G.modality_dropout(o, "o_orderkey", {"price": ["o_totalprice"], "status": ["o_orderstatus", "o_orderpriority"]}, 0.1)


@plan("augmentation_report", (
    "SELECT (SELECT count(*) FROM orders)::BIGINT AS original_size, (SELECT count(*) * 3 FROM orders)::BIGINT AS augmented_size, "
    "3.0::DOUBLE AS ratio"), ("A22",))
def q_aug_report(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return profile.augmentation_report(o, G.noise_rows(o, "o_orderkey", ["o_totalprice"], 0.1, 2))


@plan("augmentation_quality", (
    "WITH a AS (SELECT o_orderkey, o_totalprice AS x, o_totalprice * (0.95 + 0.1 * " + sql_unit_hash(_k("o_orderkey"), "'sj-scale:o_totalprice'")
    + ") + " + sql_normal(_k("o_orderkey"), "sj-jitter:o_totalprice") + " * 0.01 * sd AS y FROM orders, "
    "(SELECT stddev_samp(o_totalprice) AS sd FROM orders)) SELECT 'o_totalprice' AS column, round(corr(x, y), 6) AS correlation, "
    "round((avg(y) - avg(x)) / avg(x) * 100, 6) AS mean_change_pct, "
    "round((stddev_samp(y) - stddev_samp(x)) / stddev_samp(x) * 100, 6) AS std_change_pct, "
    "CASE WHEN corr(x, y) > 0.95 THEN 'Excellent' WHEN corr(x, y) > 0.90 THEN 'Good' WHEN corr(x, y) > 0.80 THEN 'Fair' ELSE 'Poor' END AS quality FROM a"),
    ("A23",))
def q_aug_quality(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    aug = G.scale_jitter_columns(o, "o_orderkey", ["o_totalprice"]).select(
        "o_orderkey", F.col("o_totalprice_scaled_jittered").alias("o_totalprice"))
    return round_doubles(profile.augmentation_quality(o, aug, "o_orderkey", ["o_totalprice"]))


# ---------------------------------------------------------------------------
# J04, J05 partners and neighbours
# ---------------------------------------------------------------------------


def _emb(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


@plan("partner_rows", (
    "WITH n AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY " + sql_unit_hash("vec_id::VARCHAR", "'partner'") + ") - 1 AS i, "
    "count(*) OVER (PARTITION BY label) AS n, ('0x' || substr(md5(concat_ws(':', vec_id::VARCHAR, 'partner:pick')), 1, 12))::UBIGINT::BIGINT AS r "
    "FROM embeddings), p AS (SELECT *, CASE WHEN n > 1 THEN (i + 1 + r % (n - 1)) % n END AS pi FROM n) "
    "SELECT a.vec_id, a.label, b.vec_id AS partner_key FROM p a LEFT JOIN p b ON a.label = b.label AND a.pi = b.i"), ("J05", "W06"))
def q_partner(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return G.partner_rows(e, "vec_id", "label").select("vec_id", "label", "partner_key")


_SQL_DIST = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


@plan("knn_within_class", (
    "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), "
    f"d AS (SELECT a.vec_id AS key, b.vec_id AS neighbour, {_SQL_DIST} AS distance FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY distance, neighbour) AS rank FROM d) "
    "SELECT key, neighbour, round(distance, 6) AS distance, rank::INTEGER AS rank FROM r WHERE rank <= 5"), ("J04",))
def q_knn(spark, sf):
    out = G.knn_within_class(_emb(spark, sf), "vec_id", "label", "vec", 5)
    return round_doubles(out.select("key", "neighbour", "distance", "rank"))


# ---------------------------------------------------------------------------
# G05 / G06 SMOTE on document features with the quality label
# ---------------------------------------------------------------------------

_SMOTE_SRC = ("SELECT d.doc_id, l.quality, d.n_chars::DOUBLE AS n_chars, len(list_filter(regexp_split_to_array(coalesce(d.text, ''), '\\s+'), "
              "lambda x: x <> ''))::DOUBLE AS words FROM documents d JOIN labels l ON d.doc_id = l.doc_id")


def _smote_base(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", "quality", F.col("n_chars").cast("double").alias("n_chars"),
                    F.size(T.tokenize_whitespace("text")).cast("double").alias("words"))


def _sql_smote(k=5):
    hs = lambda s: f"('0x' || substr(md5(concat_ws(':', concat_ws(':', quality::VARCHAR, j::VARCHAR), '{s}')), 1, 12))::UBIGINT::BIGINT"
    return (
        f"WITH b AS ({_SMOTE_SRC}), c AS (SELECT quality, count(*) AS n FROM b GROUP BY quality), "
        "m AS (SELECT max(n) AS mx FROM c), need AS (SELECT quality, n, mx - n AS need FROM c, m WHERE mx - n > 0), "
        "num AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY " + sql_unit_hash("doc_id::VARCHAR", "'smote:order'")
        + ") - 1 AS i FROM b WHERE quality IN (SELECT quality FROM need)), "
        f"d AS (SELECT x.doc_id AS key, y.doc_id AS nb, sqrt((x.n_chars - y.n_chars) ^ 2 + (x.words - y.words) ^ 2) AS dist FROM num x JOIN num y "
        "ON x.quality = y.quality AND x.doc_id <> y.doc_id), "
        "nn AS (SELECT key, nb, row_number() OVER (PARTITION BY key ORDER BY dist, nb) AS rk FROM d), "
        f"kk AS (SELECT quality, least(count(*) - 1, {k}) AS k FROM num GROUP BY quality), "
        "syn AS (SELECT need.quality, j, n, k FROM need JOIN kk ON need.quality = kk.quality, range(1, need + 1) t(j)), "
        f"pick AS (SELECT quality, j, {hs('smote:base')} % n AS i, {hs('smote:nn')} % k + 1 AS r, "
        + sql_unit_hash("concat_ws(':', quality::VARCHAR, j::VARCHAR)", "'smote:gap'") + " AS u FROM syn), "
        "pts AS (SELECT p.quality, p.j, p.u, x.n_chars AS x1, x.words AS x2, y.n_chars AS y1, y.words AS y2 FROM pick p "
        "JOIN num x ON x.quality = p.quality AND x.i = p.i JOIN nn ON nn.key = x.doc_id AND nn.rk = p.r JOIN num y ON y.doc_id = nn.nb) "
        "SELECT doc_id::VARCHAR AS doc_id, quality, round(n_chars, 6) AS n_chars, round(words, 6) AS words, false AS synthetic FROM b "
        "UNION ALL SELECT concat_ws(':', 'syn', quality::VARCHAR, j::VARCHAR), quality, round(x1 + u * (y1 - x1), 6), "
        "round(x2 + u * (y2 - x2), 6), true FROM pts"
    )


@plan("smote", _sql_smote(), ("G05", "J04", "D13", "D14"))
def q_smote(spark, sf):
    return round_doubles(G.smote(_smote_base(spark, sf), "doc_id", "quality", ["n_chars", "words"], 5))


@plan("smote_class_balance", (
    "WITH s AS (" + _sql_smote() + ") SELECT coalesce(a.quality, b.quality) AS class, coalesce(a.n, 0)::BIGINT AS before_count, "
    "coalesce(b.n, 0)::BIGINT AS after_count FROM (SELECT quality, count(*) AS n FROM (" + _SMOTE_SRC + ") GROUP BY 1) a "
    "FULL OUTER JOIN (SELECT quality, count(*) AS n FROM s GROUP BY 1) b ON a.quality = b.quality"), ("A24", "G05"))
def q_smote_balance(spark, sf):
    base = _smote_base(spark, sf)
    return profile.class_balance(base, G.smote(base, "doc_id", "quality", ["n_chars", "words"], 5), "quality")


@plan("smote_validate", (
    "SELECT count(*)::BIGINT AS rows, count_if(quality IS NULL)::BIGINT AS null_targets, count(DISTINCT quality)::BIGINT AS classes, "
    "(SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))::BIGINT AS smallest_class, "
    "(SELECT max(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))::BIGINT AS largest_class, "
    "count_if(quality IS NULL) = 0 AND count(DISTINCT quality) / count(*) <= 0.5 AND count(DISTINCT quality) >= 2 "
    "AND (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) >= 2 AS valid FROM labels"), ("G06",))
def q_smote_validate(spark, sf):
    return G.smote_validate(table(spark, sf, "labels"), "quality")


# ---------------------------------------------------------------------------
# G08-G11, G13 text augmentation
# ---------------------------------------------------------------------------

FIXTURE_SYNONYMS = {"le": ["la", "les"], "der": ["die", "das"], "que": ["qui"], "eau": ["eaux"], "tion": ["sion"],
                    "good": ["fine", "great"]}


def _sql_detok(arr: str) -> str:
    return f"regexp_replace(array_to_string({arr}, ' '), ' ([.,!?:;])', '\\1', 'g')"


def _sql_syn_map() -> str:
    return "MAP {" + ", ".join(f"{sq(k)}: [{', '.join(sq(x) for x in v)}]" for k, v in FIXTURE_SYNONYMS.items()) + "}"


def _sql_content(t: str) -> str:
    from tessera.functions import dictionaries as D
    from tessera.plans.q_text import sql_list
    return f"(regexp_full_match({t}, '\\pL+') AND NOT list_contains({sql_list(D.STOPWORDS_EN)}, lower({t})))"


@plan("synonym_replace", (
    "SELECT conv_id, turn, " + _sql_detok(
        "list_transform(tk, lambda t, i: CASE WHEN " + _sql_content("t")
        + f" AND len(coalesce(list_filter({_sql_syn_map()}[lower(t)], lambda s: s <> lower(t)), [])) > 0 AND "
        + sql_unit_hash("concat_ws(':', concat_ws(':', conv_id::VARCHAR, turn::VARCHAR), (i - 1)::VARCHAR)", "'syn:p'") + " < 0.3 "
        + f"THEN list_filter({_sql_syn_map()}[lower(t)], lambda s: s <> lower(t))[(floor("
        + sql_unit_hash("concat_ws(':', concat_ws(':', conv_id::VARCHAR, turn::VARCHAR), (i - 1)::VARCHAR)", "'syn:c'")
        + f" * len(list_filter({_sql_syn_map()}[lower(t)], lambda s: s <> lower(t)))) + 1)::INTEGER] ELSE t END)")
    + f" AS text_augmented FROM (SELECT conv_id, turn, {sql_word_tokens('text')} AS tk FROM conversations)"), ("G08", "G12"))
def q_synonym(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    out = G.synonym_replace(c, ["conv_id", "turn"], "text", 0.3, FIXTURE_SYNONYMS)
    return out.select("conv_id", "turn", "text_augmented")


def _key_sql() -> str:
    return "concat_ws(':', conv_id::VARCHAR, turn::VARCHAR)"


@plan("random_deletion", (
    "WITH a AS (SELECT conv_id, turn, tk, list_filter(list_transform(tk, lambda t, i: CASE WHEN " + _sql_content("t")
    + f" THEN i END), lambda x: x IS NOT NULL) AS c0 FROM (SELECT conv_id, turn, {sql_word_tokens('text')} AS tk FROM conversations)), "
    "b AS (SELECT *, CASE WHEN len(c0) > 0 THEN c0 ELSE generate_series(1, greatest(len(tk), 1)) END AS cand FROM a), "
    "c AS (SELECT *, cand[(floor(" + sql_unit_hash(_key_sql(), "'delete'") + " * len(cand)) + 1)::INTEGER] AS pick FROM b) "
    "SELECT conv_id, turn, " + _sql_detok("CASE WHEN len(tk) <= 1 THEN tk ELSE list_filter(tk, lambda t, i: i <> pick) END")
    + " AS text_augmented FROM c"), ("G10", "G12"))
def q_deletion(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return G.random_deletion(c, ["conv_id", "turn"], "text").select("conv_id", "turn", "text_augmented")


@plan("random_swap", (
    "WITH a AS (SELECT conv_id, turn, tk, list_filter(list_transform(tk, lambda t, i: CASE WHEN regexp_full_match(t, '\\pL+') THEN i END), "
    f"lambda x: x IS NOT NULL) AS al FROM (SELECT conv_id, turn, {sql_word_tokens('text')} AS tk FROM conversations)), "
    "b AS (SELECT *, floor(" + sql_unit_hash(_key_sql(), "'swap:a'") + " * len(al))::INTEGER AS ia, "
    + sql_unit_hash(_key_sql(), "'swap:b'") + " AS u2 FROM a), "
    "c AS (SELECT *, ((ia + 1 + floor(u2 * (len(al) - 1))::INTEGER) % len(al))::INTEGER AS ib FROM b WHERE len(al) >= 2), "
    "d AS (SELECT *, al[ia + 1] AS pa, al[ib + 1] AS pb FROM c) "
    "SELECT conv_id, turn, " + _sql_detok("list_transform(tk, lambda t, i: CASE WHEN i = pa THEN tk[pb] WHEN i = pb THEN tk[pa] ELSE t END)")
    + " AS text_augmented FROM d UNION ALL SELECT conv_id, turn, " + _sql_detok("tk") + " FROM a WHERE len(al) < 2"), ("G11", "G12"))
def q_swap(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return G.random_swap(c, ["conv_id", "turn"], "text").select("conv_id", "turn", "text_augmented")


def _sql_insertion():
    u = lambda salt: sql_unit_hash(_key_sql(), f"'{salt}'")
    m = _sql_syn_map()
    return (
        "WITH a AS (SELECT conv_id, turn, tk, list_filter(list_transform(tk, lambda t, i: CASE WHEN " + _sql_content("t")
        + f" AND {m}[lower(t)] IS NOT NULL THEN i END), lambda x: x IS NOT NULL) AS has FROM "
        f"(SELECT conv_id, turn, {sql_word_tokens('text')} AS tk FROM conversations)), "
        f"b AS (SELECT *, lower(tk[has[(floor({u('ins:word')} * len(has)) + 1)::INTEGER]]) AS w FROM a), "
        f"c AS (SELECT *, {m}[w][(floor({u('ins:syn')} * len({m}[w])) + 1)::INTEGER] AS s, "
        f"floor({u('ins:pos')} * (len(tk) + 1))::INTEGER AS pos FROM b) "
        "SELECT conv_id, turn, " + _sql_detok("CASE WHEN len(tk) > 1 AND len(has) > 0 THEN list_concat(tk[1:pos], [s], tk[pos + 1:]) ELSE tk END")
        + " AS text_augmented FROM c"
    )


@plan("random_insertion", _sql_insertion(), ("G09", "G12"))
def q_insertion(spark, sf):
    """Synonym insertion over conversations (R: one more token where a synonym exists)."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return G.random_insertion(c, ["conv_id", "turn"], "text", FIXTURE_SYNONYMS).select("conv_id", "turn", "text_augmented")


@plan("masked_word_replace", None, ("G13",))
def q_mlm(spark, sf):
    """Context-count masked-word replacement over conversations (R: same token count)."""
    c = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("k"), "text")
    return G.masked_word_replace(c, "k", "text", 5).select("k", "text_augmented")


@plan("context_candidates", (
    "WITH t AS (SELECT " + sql_word_tokens("lower(coalesce(text, ''))") + " AS tk FROM documents), "
    "g AS (SELECT tk[i] AS l, tk[i + 1] AS w, tk[i + 2] AS r FROM (SELECT tk, unnest(generate_series(1, len(tk) - 2)) AS i FROM t WHERE len(tk) >= 3)), "
    "c AS (SELECT l AS \"left\", r AS \"right\", w AS word, count(*)::BIGINT AS count FROM g WHERE regexp_full_match(w, '\\pL+') GROUP BY ALL) "
    "SELECT * EXCLUDE (rk), rk::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY \"left\", \"right\" ORDER BY count DESC, word) AS rk "
    "FROM c) WHERE rk <= 5"), ("G13",))
def q_ctx(spark, sf):
    return G.context_candidates(table(spark, sf, "documents"), "text", 5)


# ---------------------------------------------------------------------------
# G08 with synonyms learned from the corpus
# ---------------------------------------------------------------------------


def _sql_content_words(table_name: str, keys: str) -> str:
    return (f"SELECT {keys}list_transform(list_filter({sql_word_tokens('text')}, lambda t: " + _sql_content("t")
            + f"), lambda t: lower(t)) AS w FROM {table_name}")


_SYNONYMS_SQL = (
    "WITH t AS (" + _sql_content_words("documents", "") + "), "
    "p AS (SELECT w[i] AS a, w[i + d] AS b FROM (SELECT w, unnest(generate_series(1, len(w))) AS i FROM t), (VALUES (1), (2)) AS v(d) WHERE i + d <= len(w)), "
    "c AS (SELECT word, context, count(*) AS n FROM (SELECT a AS word, b AS context FROM p UNION ALL SELECT b, a FROM p) WHERE word <> context GROUP BY ALL), "
    "s AS (SELECT word, sum(n) AS own FROM c GROUP BY word), "
    "v AS (SELECT * FROM (SELECT c.word, c.context, ln(c.n::DOUBLE * (SELECT sum(own) FROM s)::DOUBLE / (s.own::DOUBLE * o.own::DOUBLE)) AS weight "
    "FROM c JOIN s ON s.word = c.word JOIN s o ON o.word = c.context WHERE c.n >= 2) WHERE weight > 0), "
    "u AS (SELECT v.word, context, weight / nrm AS x FROM v JOIN (SELECT word, sqrt(sum(weight * weight)) AS nrm FROM v GROUP BY word) z ON z.word = v.word), "
    "q AS (SELECT DISTINCT unnest(w) AS word FROM (" + _sql_content_words("benchmark", "") + ")), "
    "m AS (SELECT y.word, u.word AS synonym, round(sum(u.x * y.x), 9) AS cosine FROM u JOIN u y ON y.context = u.context AND y.word <> u.word "
    "WHERE y.word IN (SELECT word FROM q) GROUP BY ALL), "
    "syn AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY cosine DESC, synonym)::INTEGER AS rank FROM m WHERE cosine > 0 "
    "QUALIFY row_number() OVER (PARTITION BY word ORDER BY cosine DESC, synonym) <= 5) "
)


def _learned(spark, sf):
    from tessera.operators import synonyms as S

    words = table(spark, sf, "benchmark").select(F.explode(S.content_words("text")).alias("word"))
    return S.synonym_candidates(table(spark, sf, "documents"), "text", words)


@plan("synonym_candidates", _SYNONYMS_SQL + "SELECT word, synonym, rank, round(cosine, 6) AS cosine FROM syn", ("G08", "G09"))
def q_synonym_candidates(spark, sf):
    """For each content word of the benchmark items, the five words of the documents of most like use."""
    return _learned(spark, sf).withColumn("cosine", F.round("cosine", 6))


_ITEM_SQL = sql_unit_hash("concat_ws(':', item_id::VARCHAR, (i - 1)::VARCHAR)", "'syn:p'"), sql_unit_hash("concat_ws(':', item_id::VARCHAR, (i - 1)::VARCHAR)", "'syn:c'")


@plan("synonym_replace_learned", _SYNONYMS_SQL + (
    ", l AS (SELECT word, list(synonym ORDER BY rank) AS c FROM syn GROUP BY word), "
    f"tk AS (SELECT item_id, unnest({sql_word_tokens('text')}) AS t, generate_subscripts({sql_word_tokens('text')}, 1) AS i FROM benchmark), "
    "r AS (SELECT item_id, i, CASE WHEN " + _sql_content("t") + f" AND l.c IS NOT NULL AND {_ITEM_SQL[0]} < 0.3 "
    f"THEN l.c[(floor({_ITEM_SQL[1]} * len(l.c)) + 1)::INTEGER] ELSE t END AS t FROM tk LEFT JOIN l ON l.word = lower(t)) "
    "SELECT b.item_id, coalesce(x.s, '') AS text_augmented FROM benchmark b LEFT JOIN (SELECT item_id, "
    + _sql_detok("list(t ORDER BY i)") + " AS s FROM r GROUP BY item_id) x ON x.item_id = b.item_id"), ("G08", "G12"))
def q_synonym_learned(spark, sf):
    """Words of the benchmark items replaced by words of like use, from the learned table."""
    items = table(spark, sf, "benchmark").select("item_id", "text")
    return G.synonym_replace(items, "item_id", "text", 0.3, _learned(spark, sf)).select("item_id", "text_augmented")
