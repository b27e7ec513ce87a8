"""Text analysis operators.

Per-document work stays inside array expressions (no shuffle); corpus statistics explode
tokens once and aggregate by term with map-side combining, so a very frequent word costs
one partial row per partition.  Dictionaries are literal arrays / maps (bounded, fixed)
applied inside expressions rather than joined.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import core
from tessera.functions import dictionaries as D
from tessera.functions import text as T
from tessera.session import cut_lineage


def _lit_map(d: Mapping[str, object]) -> Column:
    keys = list(d)
    return F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.lit(d[k]) for k in keys]))


# ---------------------------------------------------------------------------
# frequencies
# ---------------------------------------------------------------------------


def frequency_tokens(text: Column, stopwords: Iterable[str] = D.STOPWORDS_EN) -> Column:
    """X15 token rule: whitespace split, alphabetic only, lower-cased, stop words removed."""
    return T.remove_stopwords(T.alpha_lower(T.tokenize_whitespace(text)), stopwords)


def word_frequency(df: DataFrame, text_col: str, top: int | None = 20,
                   stopwords: Iterable[str] = D.STOPWORDS_EN) -> DataFrame:
    """(word, count) most frequent first, ties by word."""
    words = df.select(F.explode(frequency_tokens(F.col(text_col), stopwords)).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "word")
    return counts.limit(top) if top else counts


def word_frequency_summary(df: DataFrame, text_col: str, stopwords: Iterable[str] = D.STOPWORDS_EN) -> DataFrame:
    """Total and distinct words after the token rule."""
    words = df.select(F.explode(frequency_tokens(F.col(text_col), stopwords)).alias("word"))
    return words.agg(F.count(F.lit(1)).alias("total_words"), F.count_distinct("word").alias("distinct_words"))


def word_cloud_weights(df: DataFrame, text_col: str, top: int = 100) -> DataFrame:
    """Top words with weight count / max count."""
    wf = word_frequency(df, text_col, top)
    mx = wf.agg(F.max("count").alias("__mx"))
    return wf.crossJoin(F.broadcast(mx)).select("word", "count", (F.col("count") / F.col("__mx")).alias("weight"))


def ngram_tokens(text: Column, stopwords: Iterable[str] = D.STOPWORDS_EN) -> Column:
    """X16 token rule: word tokens of the lower-cased text, alphabetic, not stop words."""
    toks = T.tokenize_words(F.lower(F.coalesce(text, F.lit(""))))
    sw = list(stopwords)
    return F.filter(toks, lambda t: t.rlike(r"(?U)^\p{L}+$") & ~t.isin(*sw))


def ngram_frequency(df: DataFrame, text_col: str, n: int = 2, top: int | None = 20,
                    stopwords: Iterable[str] = D.STOPWORDS_EN) -> DataFrame:
    """(ngram, count) inside each document (D10), most frequent first, ties by n-gram."""
    if n < 1:
        raise ValueError("n must be >= 1")
    # tokens materialised in their own projection so the n-gram lambda reads a column
    toks = df.select(ngram_tokens(F.col(text_col), stopwords).alias("__tk"))
    grams = toks.select(F.explode(T.safe_ngrams(F.col("__tk"), n)).alias("ngram"))
    counts = grams.groupBy("ngram").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "ngram")
    return counts.limit(top) if top else counts


def bigram_network(df: DataFrame, text_col: str, top: int = 20) -> DataFrame:
    """Undirected weighted edges of the top bigrams; a reversed pair adds its weight."""
    top_bi = ngram_frequency(df, text_col, 2, top)
    parts = F.split("ngram", " ")
    a, b = parts.getItem(0), parts.getItem(1)
    return top_bi.groupBy(F.least(a, b).alias("node_1"), F.greatest(a, b).alias("node_2")).agg(
        F.sum("count").alias("weight")
    )


def bigram_degrees(edges: DataFrame) -> DataFrame:
    """Node degree and weighted degree of the bigram graph."""
    ends = edges.select(F.col("node_1").alias("node"), "weight").unionByName(
        edges.select(F.col("node_2").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted_degree"))


def keyword_in_class(df: DataFrame, text_col: str, label_col: str, stopwords: Iterable[str] = D.STOPWORDS_EN) -> DataFrame:
    """(label, word, count) term counts per class."""
    words = df.select(label_col, F.explode(frequency_tokens(F.col(text_col), stopwords)).alias("word"))
    return words.groupBy(label_col, "word").agg(F.count(F.lit(1)).alias("count"))


# ---------------------------------------------------------------------------
# lengths (X13, X14)
# ---------------------------------------------------------------------------


def text_lengths(df: DataFrame, text_col: str) -> DataFrame:
    """'Character Count' and 'Word Count' per row."""
    return df.select("*", T.char_length(F.col(text_col)).alias("char_count"), T.word_count(F.col(text_col)).alias("word_count"))


def text_length_stats(df: DataFrame, text_col: str) -> DataFrame:
    """Per measure (char_count, word_count): count, mean, std, min, p5, p25, p50, p75, p95, max."""
    lens = text_lengths(df, text_col).select("char_count", "word_count")
    cols = ["char_count", "word_count"]
    q = core.quantile_row(lens, cols, [0.05, 0.25, 0.5, 0.75, 0.95])
    m = lens.agg(*[e for c in cols for e in (F.count(c).alias(f"{c}__n"), F.avg(c).alias(f"{c}__mean"),
                                             F.stddev_samp(c).alias(f"{c}__std"), F.min(c).alias(f"{c}__min"),
                                             F.max(c).alias(f"{c}__max"))])
    row = m.crossJoin(q)
    structs = [F.struct(
        F.lit(c).alias("measure"), F.col(f"{c}__n").alias("count"), F.col(f"{c}__mean").alias("mean"),
        F.col(f"{c}__std").alias("std"), F.col(f"{c}__min").cast("double").alias("min"),
        *[F.col(f"{c}__q{i}").alias(f"p{p}") for i, p in enumerate([5, 25, 50, 75, 95])],
        F.col(f"{c}__max").cast("double").alias("max"),
    ) for c in cols]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


# ---------------------------------------------------------------------------
# token attributes, lemmas, POS
# ---------------------------------------------------------------------------


def lemmatize(tokens: Column, lemmas: Mapping[str, str] = D.LEMMAS) -> Column:
    """Lower-cased lemma from the lemma table; unknown words unchanged (lower-cased)."""
    m = _lit_map(lemmas)
    return F.transform(tokens, lambda t: F.coalesce(F.element_at(m, F.lower(t)), F.lower(t)))


def pos_tag_expr(tok: Column, lexicon: Mapping[str, str] = D.POS_LEXICON) -> Column:
    """Lexicon tag, else suffix rules for unknown words."""
    m = _lit_map(lexicon)
    lw = F.lower(tok)
    rule = (
        F.when(tok.rlike(r"^[0-9]+([.,][0-9]+)?$"), F.lit("CD"))
        .when(tok.rlike(r"(?U)^[^\w\s]+$"), F.lit("."))
        .when(lw.endswith("ing"), F.lit("VBG"))
        .when(lw.endswith("ed"), F.lit("VBD"))
        .when(lw.endswith("ly"), F.lit("RB"))
        .when(lw.endswith("ous") | lw.endswith("ful") | lw.endswith("able") | lw.endswith("ive"), F.lit("JJ"))
        .when(lw.endswith("tion") | lw.endswith("ment") | lw.endswith("ness"), F.lit("NN"))
        .when(lw.endswith("s") & ~lw.endswith("ss"), F.lit("NNS"))
        .when(F.substring(tok, 1, 1).rlike(r"(?U)^\p{Lu}$"), F.lit("NNP"))
        .otherwise(F.lit("NN"))
    )
    return F.coalesce(F.element_at(m, lw), rule)


def pos_tag(tokens: Column) -> Column:
    """X10 over an array: array<struct<token, tag>>."""
    return F.transform(tokens, lambda t: F.struct(t.alias("token"), pos_tag_expr(t).alias("tag")))


def token_attributes(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """One row per token: (key, position, text, lemma, pos, is_alpha, is_stop, is_punct)."""
    toks = df.select(key, F.posexplode(T.tokenize_words(F.col(text_col))).alias("position", "text"))
    lm = _lit_map(D.LEMMAS)
    return toks.select(
        key, "position", "text",
        F.coalesce(F.element_at(lm, F.lower("text")), F.lower("text")).alias("lemma"),
        pos_tag_expr(F.col("text")).alias("pos"),
        T.is_alpha(F.col("text")).alias("is_alpha"),
        T.is_stop(F.col("text")).alias("is_stop"),
        T.is_punct(F.col("text")).alias("is_punct"),
    )


TOKENIZERS = {
    "word": T.tokenize_words,
    "whitespace": T.tokenize_whitespace,
    "tweet": T.tokenize_tweet,
    "sentence": T.tokenize_sentences,
}


def tokenize_and_postprocess(df: DataFrame, text_col: str, method: str = "word",
                             stopwords: Iterable[str] = D.STOPWORDS_EN, lemmas: Mapping[str, str] | None = D.LEMMAS) -> DataFrame:
    """Tokens after dropping special tokens / subword marks / 1-char pieces, stop words
    and lemmatising; original_token_count, token_count, stopwords_removed, tokens_str."""
    raw = TOKENIZERS[method](F.col(text_col))
    cleaned = F.transform(raw, lambda t: F.regexp_replace(t, r"^(##|Ġ)", ""))
    cleaned = F.filter(cleaned, lambda t: (F.length(t) > 1) & ~t.rlike(r"^\[(CLS|SEP|PAD|UNK|MASK)\]$"))
    no_stop = T.remove_stopwords(cleaned, stopwords)
    final = lemmatize(no_stop, lemmas) if lemmas else no_stop
    out = df.select("*", raw.alias("__raw"), cleaned.alias("__clean"), final.alias("tokens"))
    return out.select(
        *df.columns, "tokens",
        F.size("__raw").alias("original_token_count"), F.size("tokens").alias("token_count"),
        (F.size("__clean") - F.size("tokens")).alias("stopwords_removed"),
        F.array_join("tokens", " ").alias("tokens_str"),
    )


def tokenization_stats(df: DataFrame, text_col: str, key: str | None = None, pieces: DataFrame | None = None) -> DataFrame:
    """Per method: average / min / max / std / total tokens and corr(text length, tokens), and
    ``retention_pct``, the total as a share of the method 'word'.

    Methods: the tokenizers, and 'no_stopwords', 'stemmed' and 'lemmatized' words, whose stems and
    lemmas stand one for one; with ``pieces`` (and a ``key`` that names a row) 'wordpiece' too.
    The texts are read once, and the keys once more for 'wordpiece'.  Null and empty texts have no tokens
    but one empty sentence; an empty table gives no rows."""
    kept = F.size(T.remove_stopwords(F.col("__words")))
    d = df.withColumn("__words", T.tokenize_words(F.col(text_col)))
    counts = {"word": F.size("__words"), **{m: F.size(t(F.col(text_col))) for m, t in TOKENIZERS.items() if m != "word"},
              "no_stopwords": kept, "stemmed": kept, "lemmatized": kept}
    if pieces is not None:
        if key is None:
            raise ValueError("pieces need a key that names a row")
        from tessera.operators.wordpiece import wordpiece_in_place, wordpiece_tokens

        def shared(rows: DataFrame) -> DataFrame:
            return rows.join(wordpiece_tokens(rows, key, text_col, pieces).select(key, F.size("pieces").alias("__n_pieces")), key)

        in_place = wordpiece_in_place(text_col, pieces)
        d = shared(d) if in_place is None else by_own_key(
            d, key, lambda rows: rows.where(F.col(key).isNotNull()).withColumn("__n_pieces", F.size(in_place)), shared)
        counts["wordpiece"] = F.col("__n_pieces")
    each = F.array(*[F.struct(F.lit(m).alias("method"), n.alias("n")) for m, n in counts.items()])
    rows = d.select(F.length(text_col).cast("double").alias("len"), F.explode(each).alias("m")).select("len", "m.method", "m.n")
    done = rows.groupBy("method").agg(
        F.avg("n").alias("avg_tokens"), F.min("n").alias("min_tokens"), F.max("n").alias("max_tokens"),
        F.stddev_samp("n").alias("std_tokens"), F.sum("n").alias("total_tokens"),
        F.corr(F.col("len"), F.col("n").cast("double")).alias("length_token_corr"),
    )
    # one row a method
    words = F.max(F.when(F.col("method") == "word", F.col("total_tokens"))).over(Window.partitionBy(F.lit(0)))
    return done.withColumn("retention_pct", F.when(words > 0, F.col("total_tokens") * 100.0 / words))


# ---------------------------------------------------------------------------
# sentiment
# ---------------------------------------------------------------------------


def sentiment_expr(text: Column, lexicon: Mapping[str, tuple[float, float]] = D.LEXICON,
                   intensifiers: Mapping[str, float] = D.INTENSIFIERS,
                   negations: Sequence[str] = D.NEGATIONS) -> Column:
    """X18 per document, no shuffle: struct(polarity, subjectivity) from a token-array column.

    Mean over lexicon words of their scores; an intensifier right before scales the word,
    a negation right before (or before the intensifier) multiplies polarity by -0.5.
    Documents without lexicon words score 0.  Values clipped to [-1, 1] / [0, 1].
    Positions of lexicon words are found first with a hash-set test (``isin``), so the map
    lookups and context checks run only for the few sentiment words."""
    toks = text
    words = list(lexicon)
    pol = _lit_map({k: v[0] for k, v in lexicon.items()})
    sub = _lit_map({k: v[1] for k, v in lexicon.items()})
    inten = _lit_map(dict(intensifiers))
    neg = list(negations)
    hits = F.filter(F.sequence(F.lit(1), F.greatest(F.size(toks), F.lit(1))),
                    lambda i: F.coalesce(F.try_element_at(toks, i).isin(*words), F.lit(False)))

    def score(i):
        t = F.element_at(toks, i)
        prev = F.when(i > 1, F.element_at(toks, i - 1))
        prev2 = F.when(i > 2, F.element_at(toks, i - 2))
        mult = F.coalesce(F.element_at(inten, prev), F.lit(1.0))
        negated = F.coalesce(prev.isin(*neg), F.lit(False)) | (
            F.element_at(inten, prev).isNotNull() & F.coalesce(prev2.isin(*neg), F.lit(False)))
        p = F.element_at(pol, t) * mult * F.when(negated, F.lit(-0.5)).otherwise(F.lit(1.0))
        s = F.element_at(sub, t) * mult
        return F.struct(F.greatest(F.least(p, F.lit(1.0)), F.lit(-1.0)).alias("p"),
                        F.greatest(F.least(s, F.lit(1.0)), F.lit(0.0)).alias("s"))

    scored = F.transform(hits, score)
    n = F.size(scored)
    psum = F.aggregate(scored, F.lit(0.0), lambda acc, x: acc + x["p"])
    ssum = F.aggregate(scored, F.lit(0.0), lambda acc, x: acc + x["s"])
    return F.struct(
        F.when(n > 0, psum / n).otherwise(F.lit(0.0)).alias("polarity"),
        F.when(n > 0, ssum / n).otherwise(F.lit(0.0)).alias("subjectivity"),
    )


def sentiment(df: DataFrame, text_col: str, **kw) -> DataFrame:
    """Adds polarity and subjectivity columns."""
    tok = df.withColumn("__tok", T.tokenize_words(F.lower(F.coalesce(F.col(text_col), F.lit("")))))
    s = sentiment_expr(F.col("__tok"), **kw)
    return tok.withColumn("__s", s).select(*df.columns, F.col("__s.polarity").alias("polarity"),
                                          F.col("__s.subjectivity").alias("subjectivity"))


def sentiment_summary(scored: DataFrame, thresholds: Sequence[float] = (0.2, 0.05)) -> DataFrame:
    """X19 (D22): averages and positive / negative / neutral counts and shares per threshold."""
    n = F.count(F.lit(1))
    aggs = [n.alias("documents"), F.avg("polarity").alias("avg_polarity"), F.avg("subjectivity").alias("avg_subjectivity")]
    rows = []
    for t in thresholds:
        tag = str(t).replace(".", "_")
        aggs += [F.count_if(F.col("polarity") > t).alias(f"pos_{tag}"), F.count_if(F.col("polarity") < -t).alias(f"neg_{tag}")]
        rows.append((t, tag))
    row = scored.agg(*aggs)
    structs = [F.struct(
        F.lit(t).alias("threshold"), F.col("documents"), F.col("avg_polarity"), F.col("avg_subjectivity"),
        F.col(f"pos_{tag}").alias("positive"), F.col(f"neg_{tag}").alias("negative"),
        (F.col("documents") - F.col(f"pos_{tag}") - F.col(f"neg_{tag}")).alias("neutral"),
        (F.col(f"pos_{tag}") * 100.0 / F.col("documents")).alias("positive_pct"),
        (F.col(f"neg_{tag}") * 100.0 / F.col("documents")).alias("negative_pct"),
    ) for t, tag in rows]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


# ---------------------------------------------------------------------------
# rows that no other row is judged with
# ---------------------------------------------------------------------------


def by_own_key(df: DataFrame, key: str, own: Callable[[DataFrame], DataFrame], shared: Callable[[DataFrame], DataFrame],
               nulls_meet: bool = False) -> DataFrame:
    """``own`` of the rows whose key no other row has, with ``shared`` of the rows that share one; rows
    with a NULL key count as sharing it only if ``nulls_meet``.  One pass over the keys alone finds
    these; without any, rows stay where they are."""
    again = (df if nulls_meet else df.where(F.col(key).isNotNull())).groupBy(F.col(key).alias("__again")).agg(
        F.count(F.lit(1)).alias("__rows")).where("__rows > 1").select("__again")
    if again.isEmpty():
        return own(df)
    same = F.col(key).eqNullSafe(F.col("__again"))
    return own(df.join(again, same, "left_anti")).unionByName(shared(df.join(again, same, "left_semi")))


def row_term_counts(df: DataFrame, terms: str, *keep: str) -> DataFrame:
    """(kept columns, term, tf): the distinct elements of an array column and how often each occurs in its row.

    A row's terms are sorted in place and counted from one start of equal ones to the next, so that a
    task holds the terms of one row, however many rows it reads."""
    rows = df.select(*keep, F.sort_array(terms).alias("__s"))
    places = F.when(F.size("__s") > 0, F.sequence(F.lit(0), F.size("__s") - 1))
    first = lambda i: (i == 0) | ~F.get("__s", i).eqNullSafe(F.get("__s", i - 1))
    rows = rows.select(*keep, "__s", F.filter(places, first).alias("__first"))
    # the outer form, as Spark pushes a test of the array below the other, where the array is made anew for each element
    runs = rows.select(*keep, "__s", "__first", F.posexplode_outer("__first").alias("__k", "__at")).where("__at IS NOT NULL")
    upto = F.coalesce(F.get("__first", F.col("__k") + 1), F.size("__s"))
    return runs.select(*keep, F.get("__s", F.col("__at")).alias("term"), (upto - F.col("__at")).cast("long").alias("tf"))


# ---------------------------------------------------------------------------
# TF-IDF (X20)
# ---------------------------------------------------------------------------

#: Terms that are sent to all tasks; a larger vocabulary is shuffled.
TERMS_SENT = 1 << 17



def tfidf_long(df: DataFrame, key: str, text_col: str, ngram_range: tuple[int, int] = (1, 2),
               min_df: float | int = 2, max_df: float | int = 0.95, max_features: int | None = None,
               stopwords: Iterable[str] = D.STOPWORDS_EN) -> DataFrame:
    """X20 in long form (key, term, tfidf), scikit-learn TfidfVectorizer semantics (D19):
    lower-cased word tokens (2+ word chars), stop words removed, n-grams, document
    frequency limits (ints are counts, floats are shares), only if asked the top ``max_features``
    terms by corpus frequency (ties by term), idf = ln((1 + n) / (1 + df)) + 1, L2-normalised rows.
    Term statistics are aggregates by term; the vocabulary filter is a join on term, without a
    shuffle for up to ``TERMS_SENT`` features.

    Without ``max_features`` the kept cells of the n-grams of each n are written in order of their terms, one n
    after the other, so that only one n's counts are shuffled at a time."""
    sw = list(stopwords)
    toks = F.filter(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"(?U)\w\w+"), 0),
                    lambda t: ~t.isin(*sw))
    base = df.select(key, toks.alias("__t"))
    grams = [T.safe_ngrams(F.col("__t"), n) if n > 1 else F.col("__t") for n in range(ngram_range[0], ngram_range[1] + 1)]
    ndocs = df.agg(F.count(F.lit(1)).alias("__n"))
    sent = max_features is not None and max_features <= TERMS_SENT

    def own(rows: DataFrame) -> DataFrame:
        return row_term_counts(rows, "__g", key)

    def shared(rows: DataFrame) -> DataFrame:
        return rows.select(key, F.explode_outer("__g").alias("term")).where("term IS NOT NULL").groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))

    def kept(terms: Column) -> DataFrame:
        """(key, term, tf, df) of the terms that are kept."""
        # a row's terms are counted in place, unless other rows have its key
        tf = by_own_key(base.select(key, terms.alias("__g")), key, own, shared, nulls_meet=True)
        if not sent:  # dealt by term once, for the statistics and the weights
            tf = tf.repartition("term")
        # the tests of cf and of the key keep both in this branch too, so that both read the same shuffled counts
        stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), *([] if sent else [F.max(F.hash(key)).alias("__any")])).where(
            "cf > 0" if sent else "cf > 0 AND __any IS NOT NULL").crossJoin(F.broadcast(ndocs))
        lo = F.lit(float(min_df)) * F.col("__n") if isinstance(min_df, float) else F.lit(min_df)
        hi = F.lit(float(max_df)) * F.col("__n") if isinstance(max_df, float) else F.lit(max_df)
        vocab = stats.where((F.col("df") >= lo) & (F.col("df") <= hi))
        if max_features:
            vocab = vocab.orderBy(F.desc("cf"), "term").limit(max_features)
        vocab = vocab.select("term", "df")
        # the counts are many times what Spark estimates from the texts: they are never broadcast
        return tf.join(F.broadcast(vocab) if sent else vocab.hint("shuffle_hash"), "term").select(key, "term", "tf", "df")

    if max_features:
        cells = kept(functools.reduce(F.concat, grams))
    else:  # rows of a term next to each other take few bytes, written and shuffled
        cells = functools.reduce(DataFrame.unionByName, [cut_lineage(kept(g).sortWithinPartitions("term")) for g in grams])
    # dealt as whole numbers, which are shuffled in fewer bytes than weights
    cells = cells.repartition(key).crossJoin(F.broadcast(ndocs))
    idf = F.ln((F.col("__n") + 1) / (F.col("df") + 1)) + 1
    w = cells.select(key, "term", (F.col("tf") * idf).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.select(key, "term", (F.col("w") / norm).alias("tfidf"))


# ---------------------------------------------------------------------------
# language detection
# ---------------------------------------------------------------------------


def _member_of(words: Sequence[str]):
    ws = list(words)
    return lambda t: t.isin(*ws)


def detect_language(df: DataFrame, text_col: str, profiles: Mapping[str, Sequence[str]] = D.STOPWORDS) -> DataFrame:
    """Language whose stop-word profile covers most tokens (ties by language code);
    'unknown' when no profile word occurs.  Adds ``detected_lang`` and ``profile_hits``."""
    toks = F.col("__tok")
    df0 = df
    df = df.withColumn("__tok", F.transform(T.tokenize_whitespace(F.col(text_col)), lambda t: F.lower(F.regexp_replace(t, r"(?U)[^\w']", ""))))
    hits = [
        F.struct(F.size(F.filter(toks, _member_of(ws))).alias("n"),
                 F.lit(lang).alias("lang"))
        for lang, ws in sorted(profiles.items())
    ]
    # best: max n, then smallest lang -> sort descending by n, ascending by lang
    best = F.array_sort(F.array(*hits), lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1)
                        .when(a["lang"] < b["lang"], -1).when(a["lang"] > b["lang"], 1).otherwise(0))[0]
    return df.withColumn("__best", best).select(
        *df0.columns,
        F.when(F.col("__best.n") > 0, F.col("__best.lang")).otherwise(F.lit("unknown")).alias("detected_lang"),
        F.col("__best.n").alias("profile_hits"),
    )


# ---------------------------------------------------------------------------
# dictionary tables (J03), vocabulary-level UDF work (E01, X08), pipelines (X11)
# ---------------------------------------------------------------------------

def dictionary_join(vocab: DataFrame, dictionary: DataFrame, on: str = "word", how: str = "left") -> DataFrame:
    """Join a (distinct) vocabulary with a dictionary table (stop words, lemmas,
    synonyms, lexicon).  Spark broadcasts the dictionary if its measured bytes allow it."""
    return vocab.join(dictionary, on, how)


def dictionary_table(spark, words: Mapping[str, object] | Sequence[str], value: str = "value") -> DataFrame:
    """Small dictionary as a table (word[, value]) built JVM-side."""
    if isinstance(words, Mapping):
        rows = [(k, str(v) if not isinstance(v, (list, tuple)) else ",".join(v)) for k, v in words.items()]
        return core.lit_table(spark, rows, f"word string, {value} string")
    return core.lit_table(spark, [(w,) for w in words], "word string")


#: Parts into which the occurrences of one word are dealt when they are joined with its row.
WORD_PARTS = 32
#: Words whose pieces a task keeps.
WORDS_KEPT = 1 << 16


def pieces_of_words(words: str | Column, of_word: Callable[[str], list[str]]) -> Column:
    """The pieces of all words of an array column, in order, one after the other.  ``of_word`` is
    called once for a word in a task, as long as the task keeps its pieces."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept = functools.lru_cache(WORDS_KEPT)(of_word)
        for rows in batches:
            yield rows.map(lambda row: None if row is None else [p for w in row for p in kept(w)])

    # once for a row, wherever the array is used
    return run.asNondeterministic()(F.col(words) if isinstance(words, str) else words)


def pieces_by_row(df: DataFrame, key: str, words: str, of_word: Callable[[str], list[str]], table: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, pieces) of the array column ``words``: in place for a row whose key is its own; rows that
    share a key are joined with ``table`` (word, pieces) of their words by ``values_by_word``."""
    none = F.array().cast("array<string>")

    def own(rows: DataFrame) -> DataFrame:
        held = F.when(F.col(key).isNotNull(), F.col(words))
        return rows.select(key, F.coalesce(pieces_of_words(held, of_word), none).alias("pieces"))

    def shared(rows: DataFrame) -> DataFrame:
        found = values_by_word(rows, key, words, table(rows.select(F.explode(words).alias("word"))), "pieces")
        return found.select(key, F.flatten("pieces").alias("pieces"))

    return by_own_key(df, key, own, shared)


def values_by_word(df: DataFrame, key: str, words: str, values: DataFrame, value: str) -> DataFrame:
    """(key, value array): for each word of the array column ``words``, in order, its ``value`` from the
    table ``values`` (one row a word; null where there is none).  ``key`` names a row; every row is
    kept, one without words has an empty array.

    A row's occurrences of a word go as one row with their places.  A word that most rows hold is
    dealt over ``WORD_PARTS`` parts, each with a copy of the word's one row in ``values``."""
    spots = df.select(F.col(key).alias("__key"), F.posexplode(words).alias("__pos", "word")).groupBy("__key", "word").agg(
        F.collect_list("__pos").alias("__pos"))
    spots = spots.withColumn("__part", F.pmod(F.xxhash64("__key"), F.lit(WORD_PARTS)).cast("int"))
    copies = values.select("word", F.col(value).alias("__value"), F.explode(F.sequence(F.lit(0), F.lit(WORD_PARTS - 1))).alias("__part"))
    # equal copies look small when they are shuffled, but not on the driver: never broadcast
    found = spots.join(copies.hint("merge"), ["word", "__part"], "left")
    # arrays of a word's places, not single tokens, go through the shuffle back to the row
    rows = found.groupBy("__key").agg(F.collect_list(F.struct("__pos", F.struct(F.col("__value").alias("v")).alias("x"))).alias("__found"))
    flat = F.flatten(F.transform("__found", lambda f: F.transform(f["__pos"], lambda at: F.struct(at.alias("at"), f["x"].alias("x")))))
    ordered = F.transform(F.array_sort(flat, lambda a, b: a["at"] - b["at"]), lambda t: t["x"]["v"])
    rows = rows.select("__key", ordered.alias("__out"))
    kind = values.schema[value].dataType.simpleString()
    return df.select(F.col(key)).join(rows, F.col(key) == F.col("__key"), "left").select(
        key, F.coalesce("__out", F.array().cast(f"array<{kind}>")).alias(value))


def vocabulary(df: DataFrame, text_col: str) -> DataFrame:
    """Distinct lower-cased alphabetic words with their corpus counts (map-side combined)."""
    toks = T.alpha_lower(T.tokenize_words(F.col(text_col)))
    return df.select(F.explode(toks).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def tokenization_pipeline(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """X11: the per-document tokenisations side by side (all rows, D12): basic and advanced
    cleaning, word / sentence / tweet tokens, stop-word-free, lemmatised and POS-tagged
    tokens (subword and stem columns come from the vocabulary-level operators)."""
    words = T.tokenize_words(F.col(text_col))
    d = df.select(key, text_col, words.alias("word_tokens"))
    no_stop = T.remove_stopwords(F.col("word_tokens"))
    return d.select(
        key,
        T.clean_basic(text_col).alias("basic_clean"),
        T.clean_advanced(text_col).alias("advanced_clean"),
        "word_tokens",
        T.tokenize_sentences(text_col).alias("sentence_tokens"),
        T.tokenize_tweet(text_col).alias("tweet_tokens"),
        no_stop.alias("no_stopwords"),
        lemmatize(no_stop).alias("lemmas"),
        F.transform("word_tokens", lambda t: pos_tag_expr(t)).alias("pos_tags"),
    )
