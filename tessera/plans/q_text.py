"""Plans for text cleaning, tokenising and text analysis over documents / pages /
conversations / labels (F01-F06, X01-X04, X06-X07, X09-X10, X12-X20, X23-X24)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tessera import core
from tessera.functions import dictionaries as D
from tessera.functions import text as T
from tessera.operators import language as L
from tessera.operators import text as X
from tessera.plans.common import round_doubles, sql_unit_hash
from tessera.plans.registry import plan, table

# ---------------------------------------------------------------------------
# DuckDB twins of the text expressions (RE2: \w is ASCII, so spell out [\pL\pN_])
# ---------------------------------------------------------------------------
W = r"[\pL\pN_]"


def sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(sq(w) for w in words) + "]"


def sql_clean_basic(t: str) -> str:
    x = f"regexp_replace(lower(coalesce({t}, '')), '\\s+', ' ', 'g')"
    x = f"regexp_replace({x}, '[^\\pL\\pN_\\s.!?,;:]', '', 'g')"
    return f"trim({x})"


def sql_clean_advanced(t: str) -> str:
    x = f"lower(coalesce({t}, ''))"
    x = f"regexp_replace({x}, 'http\\S+|www\\S+|https\\S+', '', 'g')"
    x = f"regexp_replace({x}, '\\S+@\\S+', '', 'g')"
    x = f"regexp_replace({x}, '\\d+', '', 'g')"
    x = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    x = f"regexp_replace({x}, '[[:punct:]]', '', 'g')"
    return f"trim({x})"


def sql_clean_html(t: str) -> str:
    x = f"regexp_replace({t}, '(?is)<script[^>]*>.*?</script>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?is)<style[^>]*>.*?</style>', ' ', 'g')"
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    x = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    return f"trim({x})"


def sql_ws_tokens(t: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({t}, ''), '\\s+'), lambda x: x <> '')"


SQL_WORD_RE = f"{W}+(?:''{W}+)?|[^\\pL\\pN_\\s]"


def sql_word_tokens(t: str) -> str:
    return f"regexp_extract_all(coalesce({t}, ''), '{SQL_WORD_RE}', 0)"


def sql_alpha(x: str) -> str:
    return f"regexp_full_match({x}, '\\pL+')"


def sql_freq_tokens(t: str) -> str:
    return (f"list_filter(list_transform(list_filter({sql_ws_tokens(t)}, lambda w: {sql_alpha('w')}), lambda w: lower(w)), "
            f"lambda w: NOT list_contains({sql_list(D.STOPWORDS_EN)}, w))")


def sql_ngram_tokens(t: str) -> str:
    return (f"list_filter({sql_word_tokens(f"lower(coalesce({t}, ''))")}, "
            f"lambda w: {sql_alpha('w')} AND NOT list_contains({sql_list(D.STOPWORDS_EN)}, w))")


def sql_ngrams(toks: str, n: int) -> str:
    if n == 1:
        return toks
    parts = " || ' ' || ".join(f"{toks}[i + {k}]" for k in range(n))
    return f"CASE WHEN len({toks}) >= {n} THEN [{parts} for i in range(1, len({toks}) - {n - 2})] ELSE [] END"


# ---------------------------------------------------------------------------
# F01-F05 cleaning and lengths
# ---------------------------------------------------------------------------


@plan("clean_basic", f"SELECT doc_id, {sql_clean_basic('text')} AS cleaned FROM documents", ("F01",))
def q_clean_basic(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_basic("text").alias("cleaned"))


@plan("clean_advanced", f"SELECT doc_id, {sql_clean_advanced('text')} AS cleaned FROM documents", ("F02",))
def q_clean_advanced(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_advanced("text").alias("cleaned"))


@plan("clean_html", f"SELECT page_id, {sql_clean_html('html')} AS text FROM pages", ("F03",))
def q_clean_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.clean_html("html").alias("text"))


@plan("normalize_text", (
    "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[[:punct:]]', '', 'g'), "
    "'\\d+', '', 'g'), '\\s+', ' ', 'g')) AS normalized FROM documents"), ("F04",))
def q_normalize(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.normalize_text("text", True, True, True).alias("normalized"))


@plan("text_lengths", (
    f"SELECT doc_id, length(text)::INTEGER AS char_count, len({sql_ws_tokens('text')})::INTEGER AS word_count FROM documents"),
    ("F05",))
def q_lengths(spark, sf):
    return X.text_lengths(table(spark, sf, "documents"), "text").select("doc_id", "char_count", "word_count")


@plan("text_length_stats", (
    "WITH l AS (SELECT length(text) AS char_count, len(" + sql_ws_tokens("text") + ") AS word_count FROM documents) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS measure, count({c})::BIGINT AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        f"min({c})::DOUBLE AS min, " + ", ".join(f"round(quantile_cont({c}, {p / 100}), 6) AS p{p}" for p in (5, 25, 50, 75, 95))
        + f", max({c})::DOUBLE AS max FROM l" for c in ("char_count", "word_count"))), ("X14",))
def q_length_stats(spark, sf):
    return round_doubles(X.text_length_stats(table(spark, sf, "documents"), "text"))


# ---------------------------------------------------------------------------
# X01-X04, X07 tokenizers
# ---------------------------------------------------------------------------


@plan("tokenize_words", (
    f"SELECT doc_id, len(t)::INTEGER AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {sql_word_tokens('text')} AS t FROM documents)"),
    ("X01",))
def q_tok_words(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.tokenize_words("text").alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@plan("tokenize_sentences", (
    "SELECT doc_id, len(s)::INTEGER AS n_sentences, array_to_string(s, '|') AS sentences FROM (SELECT doc_id, "
    "string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents)"),
    ("X02",))
def q_tok_sent(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.tokenize_sentences("text").alias("s"))
    return d.select("doc_id", F.size("s").alias("n_sentences"), F.array_join("s", "|").alias("sentences"))


_SQL_TWEET = (f"https?://\\S+|www\\.\\S+|@{W}+|#{W}+|[:;=8][-o*'']?[)(\\]\\[dDpP/\\\\|]|<3|{W}+(?:''{W}+)?|[^\\pL\\pN_\\s]")


@plan("tokenize_tweet", (
    f"SELECT conv_id, turn, len(t)::INTEGER AS n_tokens, array_to_string(t, ' ') AS tokens FROM "
    f"(SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '{_SQL_TWEET}', 0) AS t FROM conversations)"), ("X03",))
def q_tok_tweet(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", T.tokenize_tweet("text").alias("t"))
    return c.select("conv_id", "turn", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@plan("tokenize_whitespace", (
    f"SELECT doc_id, len(t)::INTEGER AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {sql_ws_tokens('text')} AS t FROM documents)"),
    ("X04",))
def q_tok_ws(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.tokenize_whitespace("text").alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@plan("remove_stopwords", (
    f"SELECT doc_id, len(t)::INTEGER AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, "
    f"list_filter({sql_word_tokens('text')}, lambda w: NOT list_contains({sql_list(D.STOPWORDS_EN)}, lower(w))) AS t FROM documents)"),
    ("X07", "F08"))
def q_stop(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.remove_stopwords(T.tokenize_words("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


# ---------------------------------------------------------------------------
# X15-X17, X23 frequencies
# ---------------------------------------------------------------------------


@plan("word_frequency", (
    f"SELECT word, count(*)::BIGINT AS count FROM (SELECT unnest({sql_freq_tokens('text')}) AS word FROM documents) "
    "GROUP BY word ORDER BY count DESC, word LIMIT 20"), ("X15", "T01"))
def q_word_freq(spark, sf):
    return X.word_frequency(core.spread(table(spark, sf, "documents").select("text")), "text", 20)


@plan("word_frequency_summary", (
    f"SELECT count(*)::BIGINT AS total_words, count(DISTINCT word)::BIGINT AS distinct_words FROM "
    f"(SELECT unnest({sql_freq_tokens('text')}) AS word FROM documents)"), ("X15",))
def q_word_summary(spark, sf):
    return X.word_frequency_summary(table(spark, sf, "documents"), "text")


@plan("word_cloud_weights", (
    f"WITH wf AS (SELECT word, count(*)::BIGINT AS count FROM (SELECT unnest({sql_freq_tokens('text')}) AS word FROM documents) "
    "GROUP BY word ORDER BY count DESC, word LIMIT 100) SELECT word, count, round(count / (SELECT max(count) FROM wf), 12) AS weight FROM wf"),
    ("X15",))
def q_cloud(spark, sf):
    # 12 places: shares such as 0.0640625 are ties at 6, which the engines round differently
    cloud = X.word_cloud_weights(table(spark, sf, "documents"), "text", 100)
    return cloud.withColumn("weight", F.round("weight", 12))


def _sql_ngram_counts(n: int, top: int) -> str:
    toks = sql_ngram_tokens("text")
    return (f"SELECT ngram, count(*)::BIGINT AS count FROM (SELECT unnest({sql_ngrams('tk', n)}) AS ngram FROM "
            f"(SELECT {toks} AS tk FROM documents)) GROUP BY ngram ORDER BY count DESC, ngram LIMIT {top}")


@plan("bigram_frequency", _sql_ngram_counts(2, 20), ("X16", "F08"))
def q_bigrams(spark, sf):
    return X.ngram_frequency(core.spread(table(spark, sf, "documents").select("text")), "text", 2, 20)


@plan("trigram_frequency", _sql_ngram_counts(3, 10), ("X16",))
def q_trigrams(spark, sf):
    return X.ngram_frequency(table(spark, sf, "documents"), "text", 3, 10)


@plan("bigram_network", (
    f"SELECT least(split_part(ngram, ' ', 1), split_part(ngram, ' ', 2)) AS node_1, "
    f"greatest(split_part(ngram, ' ', 1), split_part(ngram, ' ', 2)) AS node_2, sum(count)::BIGINT AS weight "
    f"FROM ({_sql_ngram_counts(2, 20)}) GROUP BY 1, 2"), ("X17",))
def q_bigram_net(spark, sf):
    return X.bigram_network(table(spark, sf, "documents"), "text", 20)


@plan("keyword_in_class", (
    f"SELECT quality, word, count(*)::BIGINT AS count FROM (SELECT l.quality, unnest({sql_freq_tokens('d.text')}) AS word "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id) GROUP BY quality, word"), ("X23",))
def q_kw_class(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return X.keyword_in_class(d, "text", "quality")


# ---------------------------------------------------------------------------
# X06, X09, X10, X12, X13 token attributes
# ---------------------------------------------------------------------------


def _sql_map(d) -> str:
    return "MAP {" + ", ".join(f"{sq(k)}: {sq(v) if isinstance(v, str) else v}" for k, v in d.items()) + "}"


def _sql_pos(tok: str) -> str:
    lw = f"lower({tok})"
    return (f"coalesce({_sql_map(D.POS_LEXICON)}[{lw}], CASE "
            f"WHEN regexp_full_match({tok}, '[0-9]+([.,][0-9]+)?') THEN 'CD' "
            f"WHEN regexp_full_match({tok}, '[^\\pL\\pN_\\s]+') THEN '.' "
            f"WHEN ends_with({lw}, 'ing') THEN 'VBG' WHEN ends_with({lw}, 'ed') THEN 'VBD' WHEN ends_with({lw}, 'ly') THEN 'RB' "
            f"WHEN ends_with({lw}, 'ous') OR ends_with({lw}, 'ful') OR ends_with({lw}, 'able') OR ends_with({lw}, 'ive') THEN 'JJ' "
            f"WHEN ends_with({lw}, 'tion') OR ends_with({lw}, 'ment') OR ends_with({lw}, 'ness') THEN 'NN' "
            f"WHEN ends_with({lw}, 's') AND NOT ends_with({lw}, 'ss') THEN 'NNS' "
            f"WHEN regexp_full_match(substr({tok}, 1, 1), '\\p{{Lu}}') THEN 'NNP' ELSE 'NN' END)")


@plan("token_attributes", (
    "SELECT conv_id, turn, (i - 1)::INTEGER AS position, t AS text, coalesce(" + _sql_map(D.LEMMAS) + "[lower(t)], lower(t)) AS lemma, "
    + _sql_pos("t") + " AS pos, regexp_full_match(t, '\\pL+') AS is_alpha, "
    f"list_contains({sql_list(D.STOPWORDS_EN)}, lower(t)) AS is_stop, regexp_full_match(t, '[^\\pL\\pN_\\s]+') AS is_punct "
    f"FROM (SELECT conv_id, turn, unnest(tk) AS t, unnest(generate_series(1, len(tk))) AS i FROM "
    f"(SELECT conv_id, turn, {sql_word_tokens('text')} AS tk FROM conversations))"), ("X06", "X09", "X10", "F06"))
def q_token_attrs(spark, sf):
    c = table(spark, sf, "conversations").withColumn("k", F.struct("conv_id", "turn"))
    out = X.token_attributes(c, "k", "text")
    return out.select("k.conv_id", "k.turn", *[x for x in out.columns if x != "k"])


@plan("tokenize_postprocess", (
    "SELECT doc_id, array_to_string(fin, ' ') AS tokens_str, len(raw)::INTEGER AS original_token_count, "
    "len(fin)::INTEGER AS token_count, (len(cl) - len(fin))::INTEGER AS stopwords_removed FROM ("
    f"SELECT doc_id, raw, cl, list_transform(list_filter(cl, lambda w: NOT list_contains({sql_list(D.STOPWORDS_EN)}, lower(w))), "
    f"lambda w: coalesce({_sql_map(D.LEMMAS)}[lower(w)], lower(w))) AS fin FROM ("
    "SELECT doc_id, raw, list_filter(list_transform(raw, lambda w: regexp_replace(w, '^(##|Ġ)', '')), "
    "lambda w: length(w) > 1 AND NOT regexp_full_match(w, '\\[(CLS|SEP|PAD|UNK|MASK)\\]')) AS cl FROM ("
    f"SELECT doc_id, {sql_word_tokens('text')} AS raw FROM documents)))"), ("X12",))
def q_tok_post(spark, sf):
    out = X.tokenize_and_postprocess(table(spark, sf, "documents").select("doc_id", "text"), "text", "word")
    return out.select("doc_id", "tokens_str", "original_token_count", "token_count", "stopwords_removed")


# ---------------------------------------------------------------------------
# X18, X19 sentiment
# ---------------------------------------------------------------------------

# fixture lexicon: a few real sentiment words plus frequent corpus words so scores are non-trivial
FIXTURE_LEXICON = dict(D.LEXICON)
FIXTURE_LEXICON.update({"le": (0.3, 0.4), "der": (-0.2, 0.5), "que": (0.1, 0.9), "with": (0.4, 0.2), "from": (-0.6, 0.7)})


def _sql_sentiment(src: str, key: str, text: str, lex=FIXTURE_LEXICON) -> str:
    lexv = ", ".join(f"({sq(k)}, {v[0]}, {v[1]})" for k, v in lex.items())
    intv = ", ".join(f"({sq(k)}, {v})" for k, v in D.INTENSIFIERS.items())
    neg = sql_list(D.NEGATIONS)
    return (
        f"WITH toks AS (SELECT {key}, unnest(tk) AS t, unnest(generate_series(1, len(tk))) AS i FROM "
        f"(SELECT {key}, {sql_word_tokens(f'lower({text})')} AS tk FROM {src})), "
        f"ctx AS (SELECT {key}, t, lag(t, 1) OVER w AS p1, lag(t, 2) OVER w AS p2 FROM toks WINDOW w AS (PARTITION BY {key} ORDER BY i)), "
        f"lx(w, pol, sub) AS (VALUES {lexv}), it(w, m) AS (VALUES {intv}), "
        f"sc AS (SELECT c.{key}, greatest(least(lx.pol * coalesce(it.m, 1.0) * CASE WHEN coalesce(list_contains({neg}, c.p1), false) "
        f"OR (it.m IS NOT NULL AND coalesce(list_contains({neg}, c.p2), false)) THEN -0.5 ELSE 1.0 END, 1.0), -1.0) AS p, "
        f"greatest(least(lx.sub * coalesce(it.m, 1.0), 1.0), 0.0) AS s FROM ctx c JOIN lx ON c.t = lx.w LEFT JOIN it ON c.p1 = it.w), "
        f"agg AS (SELECT {key}, avg(p) AS polarity, avg(s) AS subjectivity FROM sc GROUP BY {key}) "
        f"SELECT d.{key}, round(coalesce(a.polarity, 0.0), 6) AS polarity, round(coalesce(a.subjectivity, 0.0), 6) AS subjectivity "
        f"FROM {src} d LEFT JOIN agg a ON d.{key} = a.{key}"
    )


@plan("sentiment", _sql_sentiment("documents", "doc_id", "text"), ("X18",))
def q_sentiment(spark, sf):
    d = core.spread(table(spark, sf, "documents").select("doc_id", "text"))
    return round_doubles(X.sentiment(d, "text", lexicon=FIXTURE_LEXICON).select("doc_id", "polarity", "subjectivity"))


@plan("sentiment_summary", (
    "WITH s AS (" + _sql_sentiment("documents", "doc_id", "text") + ") "
    + " UNION ALL ".join(
        f"SELECT {t}::DOUBLE AS threshold, count(*)::BIGINT AS documents, round(avg(polarity), 6) AS avg_polarity, "
        f"round(avg(subjectivity), 6) AS avg_subjectivity, count_if(polarity > {t}::DOUBLE)::BIGINT AS positive, "
        f"count_if(polarity < -{t}::DOUBLE)::BIGINT AS negative, (count(*) - count_if(polarity > {t}::DOUBLE) - count_if(polarity < -{t}::DOUBLE))::BIGINT AS neutral, "
        f"round(count_if(polarity > {t}::DOUBLE) * 100.0 / count(*), 6) AS positive_pct, round(count_if(polarity < -{t}::DOUBLE) * 100.0 / count(*), 6) AS negative_pct FROM s"
        for t in (0.2, 0.05))), ("X19", "D22"))
def q_sent_summary(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    # scores rounded to 6 dp before thresholding, so engines agree on values at a threshold
    scored = round_doubles(X.sentiment(d, "text", lexicon=FIXTURE_LEXICON).select("doc_id", "polarity", "subjectivity"))
    return round_doubles(X.sentiment_summary(scored))


# ---------------------------------------------------------------------------
# X20 TF-IDF, X24 language
# ---------------------------------------------------------------------------


def _sql_tfidf(min_df=2, max_df=0.95, max_features=None):
    toks = (f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '{W}{W}+', 0), "
            f"lambda w: NOT list_contains({sql_list(D.STOPWORDS_EN)}, w))")
    return (
        f"WITH b AS (SELECT doc_id, {toks} AS tk FROM documents), "
        f"t AS (SELECT doc_id, unnest(list_concat(tk, {sql_ngrams('tk', 2)})) AS term FROM b), "
        "tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents), "
        f"st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term), "
        f"v AS (SELECT term, ln((n + 1.0) / (df + 1.0)) + 1 AS idf FROM st, n WHERE df >= {min_df} AND df <= {max_df} * n "
        f"{f'ORDER BY cf DESC, term LIMIT {max_features}' if max_features else ''}), "
        "w AS (SELECT doc_id, tf.term, tf * idf AS w FROM tf JOIN v ON tf.term = v.term), "
        "nm AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY doc_id) "
        "SELECT w.doc_id, term, round(w / nrm, 6) AS tfidf FROM w JOIN nm ON w.doc_id = nm.doc_id"
    )


@plan("tfidf", _sql_tfidf(), ("X20", "D19"))
def q_tfidf(spark, sf):
    d = core.spread(table(spark, sf, "documents").select("doc_id", "text"))
    return round_doubles(X.tfidf_long(d, "doc_id", "text", (1, 2), 2, 0.95))


@plan("tfidf_top_terms", _sql_tfidf(max_features=1000), ("X20", "D19"))
def q_tfidf_top(spark, sf):
    """Only the 1,000 commonest terms, which is the variant's feature."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return round_doubles(X.tfidf_long(d, "doc_id", "text", (1, 2), 2, 0.95, max_features=1000))


def _sql_lang():
    toks = f"list_transform({sql_ws_tokens('text')}, lambda w: lower(regexp_replace(w, '[^\\pL\\pN_'']', '', 'g')))"
    hits = [f"struct_pack(n := len(list_filter(tk, lambda w: list_contains({sql_list(ws)}, w))), lang := '{lang}')"
            for lang, ws in sorted(D.STOPWORDS.items())]
    return (
        f"WITH b AS (SELECT doc_id, lang, {toks} AS tk FROM documents), h AS (SELECT doc_id, lang, [{', '.join(hits)}] AS hs FROM b), "
        "e AS (SELECT doc_id, lang, unnest(hs) AS s FROM h), "
        "best AS (SELECT doc_id, lang, s.n AS n, s.lang AS cand, row_number() OVER (PARTITION BY doc_id ORDER BY s.n DESC, s.lang) AS rk FROM e) "
        "SELECT doc_id, lang, CASE WHEN n > 0 THEN cand ELSE 'unknown' END AS detected_lang, n::INTEGER AS profile_hits FROM best WHERE rk = 1"
    )


@plan("language_detection", _sql_lang(), ("X24",))
def q_lang(spark, sf):
    d = core.spread(table(spark, sf, "documents").select("doc_id", "lang", "text"))
    return X.detect_language(d, "text").select("doc_id", "lang", "detected_lang", "profile_hits")


@plan("language_accuracy", (
    "WITH p AS (" + _sql_lang() + ") SELECT lang, count(*)::BIGINT AS documents, count_if(lang = detected_lang)::BIGINT AS correct "
    "FROM p GROUP BY lang"), ("X24",))
def q_lang_acc(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    p = X.detect_language(d, "text")
    return p.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"),
                                 F.count_if(F.col("lang") == F.col("detected_lang")).alias("correct"))


def _sql_ranked_ngrams(src: str, key: str, top: int) -> str:
    """DuckDB twin of language.ranked_ngrams over (key, text)."""
    return (
        f"SELECT {key}, gram, rank FROM (SELECT {key}, gram, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, gram) AS rank FROM ("
        f"SELECT {key}, substr(p, i, s) AS gram, sum(n) AS n FROM (SELECT {key}, p, n, s, unnest(range(1, length(p) + 2 - s)) AS i FROM ("
        f"SELECT {key}, ' ' || w || ' ' AS p, count(*) AS n FROM (SELECT {key}, unnest(string_split(regexp_replace(lower(coalesce(text, '')), "
        f"'[^\\pL]+', ' ', 'g'), ' ')) AS w FROM {src}) WHERE w <> '' GROUP BY {key}, w), (VALUES (1), (2), (3)) z(s)) "
        f"GROUP BY {key}, gram HAVING gram <> ' ')) WHERE rank <= {top}"
    )


LEARNED = 0.8  # share of the documents that profiles are learned from
_LEARN_SQL = f"(SELECT lang, text FROM documents WHERE {sql_unit_hash('doc_id', chr(39) + 'profiles' + chr(39))} < {LEARNED})"


def _held_out(d):
    return core.hash_uniform(F.col("doc_id"), "profiles") >= LEARNED


@plan("language_profiles", _sql_ranked_ngrams(_LEARN_SQL, "lang", L.TOP), ("X24",))
def q_profiles(spark, sf):
    """The n-gram profile of each language, learned from four fifths of the documents."""
    d = table(spark, sf, "documents")
    return L.learn_profiles(d.where(~_held_out(d)), "lang", "text")


@plan("language_detection_ngrams", (
    f"WITH p AS MATERIALIZED ({_sql_ranked_ngrams(_LEARN_SQL, 'lang', L.TOP)}), o AS MATERIALIZED ({_sql_ranked_ngrams('documents', 'doc_id', L.TOP)}), "
    f"m AS (SELECT doc_id, count(*) * {L.TOP} AS most FROM o GROUP BY doc_id), "
    f"s AS (SELECT o.doc_id, p.lang, sum({L.TOP} - abs(o.rank - p.rank)) AS s FROM o JOIN p USING (gram) GROUP BY ALL), "
    "b AS (SELECT doc_id, lang, most - s AS d, row_number() OVER (PARTITION BY doc_id ORDER BY most - s, lang) AS k FROM s JOIN m USING (doc_id)) "
    f"SELECT d.doc_id, d.lang, {sql_unit_hash('d.doc_id', chr(39) + 'profiles' + chr(39))} >= {LEARNED} AS held_out, "
    "coalesce(b.lang, 'unknown') AS detected_lang, b.d::BIGINT AS out_of_place FROM documents d LEFT JOIN (SELECT * FROM b WHERE k = 1) b USING (doc_id)"), ("X24",))
def q_lang_ngrams(spark, sf):
    """All documents by the learned profiles; ``held_out`` marks those not learned from."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    found = L.detect_by_profiles(d, "doc_id", "text", L.learn_profiles(d.where(~_held_out(d)), "lang", "text"))
    return found.select("doc_id", "lang", _held_out(found).alias("held_out"), "detected_lang", "out_of_place")


# ---------------------------------------------------------------------------
# J03 dictionary joins, X08 stems (E01), X11 pipeline
# ---------------------------------------------------------------------------


@plan("vocabulary_without_stopwords", (
    f"WITH v AS (SELECT w AS word, count(*)::BIGINT AS count FROM (SELECT unnest(list_transform(list_filter({sql_word_tokens('text')}, "
    f"lambda t: {sql_alpha('t')}), lambda t: lower(t))) AS w FROM documents) GROUP BY w) "
    f"SELECT word, count FROM v WHERE NOT list_contains({sql_list(D.STOPWORDS_EN)}, word)"), ("J03", "X07"))
def q_vocab_anti(spark, sf):
    vocab = X.vocabulary(table(spark, sf, "documents"), "text")
    stop = X.dictionary_table(spark, D.STOPWORDS_EN)
    return X.dictionary_join(vocab, stop, "word", "left_anti")


@plan("lemma_lookup", (
    f"WITH v AS (SELECT DISTINCT w AS word FROM (SELECT unnest(list_transform(list_filter({sql_word_tokens('text')}, "
    f"lambda t: {sql_alpha('t')}), lambda t: lower(t))) AS w FROM documents)) "
    f"SELECT word, {_sql_map(D.LEMMAS)}[word] AS lemma FROM v"), ("J03", "X09"))
def q_lemma_lookup(spark, sf):
    vocab = X.vocabulary(table(spark, sf, "documents"), "text").select("word")
    lem = X.dictionary_table(spark, D.LEMMAS, "lemma")
    return X.dictionary_join(vocab, lem, "word", "left")


@plan("porter_stems", None, ("X08", "E01"))
def q_stems(spark, sf):
    """Porter stems of the corpus vocabulary, one UDF call per distinct word (R)."""
    from tessera.operators.stem import stem_vocabulary

    return stem_vocabulary(X.vocabulary(table(spark, sf, "documents"), "text"))


@plan("stemmed_tokens", None, ("X08",))
def q_stem_tokens(spark, sf):
    """Stop-word-free conversation tokens stemmed in order (R: same length as the input)."""
    from tessera.operators.stem import stem_tokens

    c = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("k"),
                                                 T.remove_stopwords(T.tokenize_words("text")).alias("toks"))
    return stem_tokens(c, "k", "toks").select("k", F.size("stems").alias("n"), F.array_join("stems", " ").alias("stems"))


@plan("tokenization_pipeline", None, ("X11",))
def q_tok_pipeline(spark, sf):
    """All tokenisations per document, all rows (R: one row per document)."""
    out = X.tokenization_pipeline(table(spark, sf, "documents"), "doc_id", "text")
    return out.select("doc_id", "basic_clean", "advanced_clean", "tweet_tokens", "pos_tags", F.size("word_tokens").alias("n_words"), F.size("sentence_tokens").alias("n_sentences"),
                      F.size("no_stopwords").alias("n_content"), F.array_join("lemmas", " ").alias("lemmas"))


@plan("subword_bpe", None, ("X05",))
def q_bpe(spark, sf):
    """BPE merges learned on the conversation vocabulary (30 rounds), pieces of every whole
    turn (R: pieces re-join to the words)."""
    from tessera.operators.subword import learn_bpe, subword_tokens

    conv = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("k"), "text")
    vocab = X.vocabulary(conv, "text")
    merges = learn_bpe(vocab, merges=30)
    out = subword_tokens(conv, "k", "text", merges)
    return out.select("k", F.size("pieces").alias("n_pieces"), F.array_join("pieces", " ").alias("pieces"))


# ---------------------------------------------------------------------------
# X05 WordPiece with the pieces of a public vocabulary file
# ---------------------------------------------------------------------------
_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

_WORDPIECE_SQL = (
    "WITH RECURSIVE ranks AS (SELECT TRY(decode(from_base64(b))) AS p FROM read_csv(" + sq(_RANKS) + ", delim=' ', header=false, "
    "quote='', escape='', columns={'b': 'VARCHAR', 'r': 'BIGINT'})), "
    "pieces AS (SELECT DISTINCT CASE WHEN p[1] = ' ' THEN p[2:] ELSE '##' || p END AS piece FROM ranks "
    "WHERE p IS NOT NULL AND NOT regexp_matches(CASE WHEN p[1] = ' ' THEN p[2:] ELSE p END, '\\s') AND p NOT IN ('', ' ')), "
    "toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pM\\pN]+|[^\\pL\\pM\\pN\\s\\pZ]')) AS word, "
    "generate_subscripts(regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pM\\pN]+|[^\\pL\\pM\\pN\\s\\pZ]'), 1) AS pos FROM documents), "
    "words AS (SELECT word, count(*) AS n FROM toks GROUP BY word), "
    "starts AS (SELECT word, unnest(range(1, length(word) + 1)) AS s FROM words WHERE length(word) <= 100), "
    "spans AS (SELECT word, s, unnest(range(1, length(word) - s + 2)) AS len FROM starts), "
    "best AS (SELECT word, s, max(len) AS len FROM spans JOIN pieces ON piece = CASE WHEN s > 1 THEN '##' ELSE '' END || substr(word, s, len) GROUP BY word, s), "
    "walk(word, nxt, out) AS (SELECT word, 1::BIGINT, []::VARCHAR[] FROM words UNION ALL "
    "SELECT w.word, w.nxt + b.len, list_append(w.out, CASE WHEN b.s > 1 THEN '##' ELSE '' END || substr(b.word, b.s, b.len)) FROM walk w JOIN best b ON b.word = w.word AND b.s = w.nxt), "
    "seg AS (SELECT w.word, w.n, coalesce(f.out, ['[UNK]']) AS out FROM words w LEFT JOIN walk f ON f.word = w.word AND f.nxt = length(w.word) + 1) ")


def _pieces(spark):
    from tessera.operators.wordpiece import pieces_of_ranks

    return pieces_of_ranks(spark, _RANKS)


@plan("subword_wordpiece", _WORDPIECE_SQL + "SELECT word, n AS \"count\", len(out)::INTEGER AS n_pieces, array_to_string(out, ' ') AS pieces FROM seg", ("X05",))
def q_wordpiece(spark, sf):
    """Every distinct word of the documents in WordPiece pieces, longest match first."""
    from tessera.operators.wordpiece import segment_words, wordpiece_words

    words = table(spark, sf, "documents").select(F.explode(wordpiece_words("text")).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    return counts.join(segment_words(counts, _pieces(spark)), "word").select("word", "count", F.size("pieces").alias("n_pieces"), F.array_join("pieces", " ").alias("pieces"))


@plan("wordpiece_documents", _WORDPIECE_SQL + (
    ", docs AS (SELECT t.doc_id, flatten(list(s.out ORDER BY t.pos)) AS out FROM toks t JOIN seg s ON s.word = t.word GROUP BY t.doc_id) "
    "SELECT d.doc_id, coalesce(len(out), 0)::INTEGER AS n_pieces, coalesce(len(list_filter(out, lambda x: x = '[UNK]')), 0)::INTEGER AS n_unknown, "
    "md5(coalesce(array_to_string(out, ' '), '')) AS pieces_md5 FROM documents d LEFT JOIN docs o ON o.doc_id = d.doc_id"), ("X05",))
def q_wordpiece_documents(spark, sf):
    """Every document in WordPiece pieces, in order."""
    from tessera.operators.wordpiece import UNKNOWN, wordpiece_tokens

    out = wordpiece_tokens(table(spark, sf, "documents"), "doc_id", "text", _pieces(spark))
    return out.select("doc_id", F.size("pieces").alias("n_pieces"), F.size(F.filter("pieces", lambda p: p == UNKNOWN)).alias("n_unknown"),
                      F.md5(F.array_join("pieces", " ")).alias("pieces_md5"))


_METHODS_SQL = (
    f"u AS (SELECT 'word' AS method, len({sql_word_tokens('text')}) AS n, length(text) AS len FROM documents UNION ALL "
    f"SELECT 'whitespace', len({sql_ws_tokens('text')}), length(text) FROM documents UNION ALL "
    f"SELECT 'tweet', len(regexp_extract_all(coalesce(text, ''), '{_SQL_TWEET}', 0)), length(text) FROM documents UNION ALL "
    "SELECT 'sentence', len(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))), length(text) FROM documents UNION ALL "
    f"SELECT unnest(['no_stopwords', 'stemmed', 'lemmatized']), len(list_filter({sql_word_tokens('text')}, lambda w: NOT list_contains({sql_list(D.STOPWORDS_EN)}, lower(w)))), length(text) FROM documents UNION ALL "
    "SELECT 'wordpiece', coalesce(o.n, 0), length(d.text) FROM documents d LEFT JOIN (SELECT t.doc_id, sum(len(s.out)) AS n FROM toks t JOIN seg s ON s.word = t.word GROUP BY t.doc_id) o ON o.doc_id = d.doc_id) "
    "SELECT method, round(avg(n), 6) AS avg_tokens, min(n)::INTEGER AS min_tokens, max(n)::INTEGER AS max_tokens, "
    "round(stddev_samp(n), 6) AS std_tokens, sum(n)::BIGINT AS total_tokens, round(corr(len, n), 6) AS length_token_corr, "
    "round(sum(n) * 100.0 / (SELECT sum(n) FROM u WHERE method = 'word'), 6) AS retention_pct FROM u GROUP BY method")


@plan("tokenization_stats", _WORDPIECE_SQL + ", " + _METHODS_SQL, ("X13",))
def q_tok_stats(spark, sf):
    """Token counts of every document by eight methods, and what share of the words each keeps."""
    d = core.spread(table(spark, sf, "documents").select("doc_id", "text"))
    return round_doubles(X.tokenization_stats(d, "text", "doc_id", _pieces(spark)))
