"""Text scalar functions as Catalyst expressions.

All are per-row, whole-stage-codegen friendly, and work unchanged on streaming frames.
``(?U)`` makes Java's \\w, \\s and \\p{..} Unicode-aware so accented letters survive.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import dictionaries as D


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------------------
# cleaning (F01-F04)
# ---------------------------------------------------------------------------


def clean_basic(text: str | Column) -> Column:
    """NULL -> ''; lower; whitespace runs -> ' '; keep word chars, whitespace, . ! ? , ; : ; trim."""
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    t = F.regexp_replace(t, r"(?U)[^\w\s.!?,;:]", "")
    return F.trim(t)


def clean_advanced(text: str | Column) -> Column:
    """lower; drop URLs, e-mail addresses and digits; collapse whitespace; drop ASCII punctuation; trim."""
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    t = F.regexp_replace(t, r"http\S+|www\S+|https\S+", "")
    t = F.regexp_replace(t, r"\S+@\S+", "")
    t = F.regexp_replace(t, r"(?U)\d+", "")
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    t = F.regexp_replace(t, r"\p{Punct}", "")
    return F.trim(t)


def clean_html(html: str | Column) -> Column:
    """drop script and style blocks, then tags; collapse whitespace; trim."""
    t = F.regexp_replace(_c(html), r"(?is)<script[^>]*>.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    return F.trim(t)


def normalize_text(text: str | Column, lowercase: bool = True, remove_punctuation: bool = True,
                   remove_numbers: bool = False) -> Column:
    """optional lower-casing, ASCII punctuation removal, digit removal; whitespace collapsed."""
    t = F.coalesce(_c(text), F.lit(""))
    if lowercase:
        t = F.lower(t)
    if remove_punctuation:
        t = F.regexp_replace(t, r"\p{Punct}", "")
    if remove_numbers:
        t = F.regexp_replace(t, r"(?U)\d+", "")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


# ---------------------------------------------------------------------------
# lengths and predicates
# ---------------------------------------------------------------------------


def char_length(text: str | Column) -> Column:
    return F.length(_c(text))


def word_count(text: str | Column) -> Column:
    """len(text.split()): whitespace-separated pieces, empty text -> 0."""
    return F.size(tokenize_whitespace(text))


def is_alpha(tok: str | Column) -> Column:
    return _c(tok).rlike(r"(?U)^\p{L}+$")


def is_punct(tok: str | Column) -> Column:
    return _c(tok).rlike(r"(?U)^[^\w\s]+$")


def is_stop(tok: str | Column, stopwords: Iterable[str] = D.STOPWORDS_EN) -> Column:
    return F.lower(_c(tok)).isin(*list(stopwords))


# ---------------------------------------------------------------------------
# tokenizers
# ---------------------------------------------------------------------------

WORD_RE = r"(?U)\w+(?:'\w+)?|[^\w\s]"
TWEET_RE = (r"(?U)https?://\S+|www\.\S+|@\w+|#\w+|[:;=8][-o*']?[)(\]\[dDpP/\\|]|<3|\w+(?:'\w+)?|[^\w\s]")


def tokenize_words(text: str | Column) -> Column:
    """Words (with inner apostrophe), numbers and single punctuation marks."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(WORD_RE), 0)


def tokenize_sentences(text: str | Column) -> Column:
    """Split after . ! ? followed by whitespace."""
    return F.split(F.coalesce(_c(text), F.lit("")), r"(?<=[.!?])\s+")


def tokenize_tweet(text: str | Column) -> Column:
    """Keeps URLs, @handles, #tags and emoticons as single tokens."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(TWEET_RE), 0)


def tokenize_whitespace(text: str | Column) -> Column:
    """Str.split(): whitespace runs, no empty pieces."""
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), r"(?U)\s+"), lambda x: x != "")


# ---------------------------------------------------------------------------
# token-array helpers
# ---------------------------------------------------------------------------


def remove_stopwords(tokens: str | Column, stopwords: Iterable[str] = D.STOPWORDS_EN) -> Column:
    """Case-insensitive stop-word filter on a token array (literal array, no join)."""
    sw = list(stopwords)
    return F.filter(_c(tokens), lambda t: ~F.lower(t).isin(*sw))


def alpha_lower(tokens: str | Column) -> Column:
    """Lower-cased alphabetic tokens only."""
    return F.transform(F.filter(_c(tokens), lambda t: t.rlike(r"(?U)^\p{L}+$")), lambda t: F.lower(t))


def detokenize(tokens: str | Column) -> Column:
    """Join by space, no space before . , ! ? : ;"""
    return F.regexp_replace(F.array_join(_c(tokens), " "), r" ([.,!?:;])", "$1")


def ngrams(tokens: str | Column, n: int = 2, sep: str = " ") -> Column:
    """n-grams inside one token array (D10), joined by ``sep`` (n element reads and one
    concat per position; no intermediate slice arrays)."""
    t = _c(tokens)
    if n <= 0:
        return F.array()
    if n == 1:
        return t
    return F.transform(
        F.sequence(F.lit(1), F.size(t) - (n - 1)),
        lambda i: F.concat_ws(sep, *[F.element_at(t, i + k) for k in range(n)]),
    )


def safe_ngrams(tokens: str | Column, n: int = 2, sep: str = " ") -> Column:
    t = _c(tokens)
    return F.when(F.size(t) >= n, ngrams(t, n, sep)).otherwise(F.array().cast("array<string>"))


# ---------------------------------------------------------------------------
# file names
# ---------------------------------------------------------------------------


def file_extension(name: str | Column) -> Column:
    """'.jpg' style lower-case extension, '' when none."""
    return F.lower(F.regexp_extract(_c(name), r"(\.[^./]+)$", 1))


def add_suffix(name: str | Column, suffix: str | Column) -> Column:
    """x.jpg -> x{suffix}.jpg (suffix appended when there is no extension)."""
    suf = suffix if isinstance(suffix, Column) else F.lit(suffix)
    n = _c(name)
    return F.when(n.rlike(r"\.[^./]+$"), F.concat(F.regexp_extract(n, r"^(.*)(\.[^./]+)$", 1), suf,
                                                   F.regexp_extract(n, r"^(.*)(\.[^./]+)$", 2))).otherwise(F.concat(n, suf))
