"""Small dictionaries shipped as data (D11).  Operators take replacements; these are the
defaults.  Small enough to live inside expressions as literal arrays / maps, so no
join or shuffle is needed to apply them."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: the English stop-word list the reference filters with (the common
# 179-word list of the NLTK corpus), in its natural order.
# ---------------------------------------------------------------------------
STOPWORDS_EN = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've", "you'll", "you'd",
    "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "she's", "her", "hers",
    "herself", "it", "it's", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "that'll", "these", "those", "am", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if",
    "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out",
    "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "don't",
    "should", "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn",
    "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't",
    "isn", "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
]

# Short function-word lists of our own for the other corpus languages (language profiles, X24).
STOPWORDS_FR = ["le", "la", "les", "de", "des", "du", "un", "une", "et", "en", "que", "qui", "dans", "pour", "par",
                "sur", "avec", "est", "au", "aux", "ce", "pas", "ne", "se", "il", "elle", "nous", "vous", "ils", "sont"]
STOPWORDS_DE = ["der", "die", "das", "und", "in", "den", "von", "zu", "sich", "mit", "auf", "des", "für", "ist",
                "nicht", "im", "dem", "ein", "eine", "er", "als", "auch", "es", "an", "werden", "aus", "sie", "nach"]
STOPWORDS_ES = ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "por", "un", "no", "con", "su",
                "una", "es", "para", "al", "lo", "como", "más", "pero", "sus", "le", "ya", "o", "este"]

STOPWORDS = {"en": STOPWORDS_EN, "fr": STOPWORDS_FR, "de": STOPWORDS_DE, "es": STOPWORDS_ES}

# Sentiment lexicon of our own: word -> (polarity, subjectivity).
LEXICON = {
    "good": (0.7, 0.6), "great": (0.8, 0.75), "excellent": (1.0, 1.0), "best": (1.0, 0.3), "happy": (0.8, 1.0),
    "nice": (0.6, 1.0), "love": (0.5, 0.6), "wonderful": (1.0, 1.0), "positive": (0.23, 0.54), "fine": (0.42, 0.5),
    "bad": (-0.7, 0.67), "terrible": (-1.0, 1.0), "awful": (-1.0, 1.0), "worst": (-1.0, 1.0), "sad": (-0.5, 1.0),
    "poor": (-0.4, 0.6), "hate": (-0.8, 0.9), "wrong": (-0.5, 0.9), "negative": (-0.3, 0.4), "ugly": (-0.7, 1.0),
}
# Intensifiers scale the next sentiment word; negations flip it by -0.5.
INTENSIFIERS = {"very": 1.3, "really": 1.2, "extremely": 1.5, "so": 1.2, "quite": 1.1, "slightly": 0.7}
NEGATIONS = ["not", "never", "no", "n't", "nothing", "neither", "nor"]

# Lemmas of our own (WordNet-style noun lemmas for common plurals).
LEMMAS = {
    "cats": "cat", "dogs": "dog", "children": "child", "men": "man", "women": "woman", "mice": "mouse",
    "feet": "foot", "teeth": "tooth", "geese": "goose", "people": "person", "wolves": "wolf", "leaves": "leaf",
    "knives": "knife", "lives": "life", "wives": "wife", "analyses": "analysis", "data": "datum",
    "criteria": "criterion", "phenomena": "phenomenon", "indices": "index", "matrices": "matrix",
}

# Small part-of-speech lexicon (Penn tags) for frequent English function words.
POS_LEXICON = {
    "the": "DT", "a": "DT", "an": "DT", "this": "DT", "that": "DT", "these": "DT", "those": "DT",
    "and": "CC", "or": "CC", "but": "CC", "of": "IN", "in": "IN", "on": "IN", "at": "IN", "by": "IN",
    "for": "IN", "with": "IN", "from": "IN", "as": "IN", "to": "TO", "is": "VBZ", "was": "VBD", "are": "VBP",
    "were": "VBD", "be": "VB", "been": "VBN", "it": "PRP", "he": "PRP", "she": "PRP", "they": "PRP",
    "we": "PRP", "i": "PRP", "you": "PRP", "not": "RB", "very": "RB", "there": "EX",
}

# Synonyms of our own: word -> list of synonyms (pos n/v/a/r), for augmentation.
SYNONYMS = {
    "good": ["fine", "great", "nice"], "bad": ["poor", "awful"], "big": ["large", "huge"], "small": ["little", "tiny"],
    "fast": ["quick", "rapid"], "happy": ["glad", "cheerful"], "house": ["home", "dwelling"],
    "say": ["state", "tell"], "make": ["create", "build"], "see": ["view", "observe"],
}
