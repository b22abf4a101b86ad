"""Text normalisation, token sets, similarities and credit-scene scores.

White space is Unicode white space where Python's is; patterns carry (?U) for that.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# The following are fixed values: words that mark credit scenes.
CREDIT_WORDS = ("MAIN CAST", "ADDITIONAL VOICES", "CAST", "VOICE", "VOICES", "MAGYAR HANGOK", "TOVABBI MAGYAR HANGOK", "MAGYAR VALTOZAT", "VERSIONE ITALIANA", "ELENCO", "COMPOSITORS", "ANIMATORS", "PRODUCTION", "DIRECTOR", "WRITTEN BY", "EDITED BY", "SPECIAL EFFECTS", "VISUAL EFFECTS")
MORE_CREDIT_WORDS = ("EXECUTIVE PRODUCER", "PRODUCER", "SCREENPLAY", "STORY", "MUSIC", "DIRECTED BY", "CREATED BY", "STARRING", "WITH")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def normalize_lower(x: Column | str) -> Column:
    """Lower case; only a-z, 0-9 and single blanks stay."""
    return _squeezed(F.regexp_replace(F.lower(_c(x)), r"(?U)[^a-z0-9\s]", " "))


def normalize_upper(x: Column | str) -> Column:
    """Upper case; only Latin-1 letters, digits and single blanks stay."""
    return _squeezed(F.regexp_replace(F.upper(F.coalesce(_c(x), F.lit(""))), r"(?U)[^A-Z0-9À-ÖØ-Ý\s]", " "))


def normalize_markup(x: Column | str) -> Column:
    """Upper case without tags; Latin-1 letters, digits, apostrophes, hyphens and single blanks stay. Null is empty."""
    bare = _squeezed(F.regexp_replace(F.upper(F.coalesce(_c(x), F.lit(""))), "<[^>]+>", " "))
    return _squeezed(F.regexp_replace(bare, r"[^A-Z0-9À-ÿ'\- ]+", " "))


def ocr_clean(x: Column | str) -> Column:
    """Recognised text on one line; letters, digits and basic punctuation stay."""
    return _squeezed(F.regexp_replace(F.replace(F.coalesce(_c(x), F.lit("")), F.lit("\n"), F.lit(" ")), r"[^A-Za-z0-9 .,'!?():;\-]", " "))


def drop_short_tokens(x: Column | str, least: int = 2) -> Column:
    """The text's blank-separated tokens of at least ``least`` characters."""
    return F.array_join(F.filter(F.split(_c(x), " "), lambda t: F.length(t) >= least), " ")


def subtitle_clean(x: Column | str) -> Column:
    """Without <tags> and {directions}, white space collapsed."""
    return _squeezed(F.regexp_replace(F.regexp_replace(_c(x), "<[^>]+>", ""), r"\{[^}]+\}", ""))


def words(x: Column | str) -> Column:
    """Words between blanks, in order."""
    return F.filter(F.split(_c(x), " "), lambda t: t != "")


def token_set(x: Column | str) -> Column:
    """Distinct runs of at least two of a-z and 0-9, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit("[a-z0-9]{2,}"), 0))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared over all of two arrays' distinct elements; 0 if either is empty."""
    a, b = _c(a), _c(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def hashed_words(w: Column | str) -> Column:
    """The distinct words of an array, each by 64 bits of hash."""
    return F.array_distinct(F.transform(_c(w), lambda x: F.xxhash64(x)))


def hashed_pairs(w: Column | str) -> Column:
    """The distinct pairs of neighbouring words, each by 64 bits of hash."""
    w = _c(w)
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda p, q: F.xxhash64(p, q)))


def with_features(rows: DataFrame, **texts: Column) -> DataFrame:
    """``rows`` with the features of each of the ``texts``: its words and pairs of words by 64 bits of hash. Every step is
    a projection of its own, so that a text is normalised and split once, and not once for each use."""
    rows = rows.withColumns({f"_text_{n}": x for n, x in texts.items()})
    rows = rows.withColumns({f"_words_{n}": words(f"_text_{n}") for n in texts})
    features = {n: F.struct(F.coalesce(f"_text_{n}", F.lit("")).alias("text"), hashed_words(f"_words_{n}").alias("words"), hashed_pairs(f"_words_{n}").alias("bigrams")) for n in texts}
    return rows.withColumns(features).drop(*(f"_{part}_{n}" for n in texts for part in ("text", "words")))


def with_similarity(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``rows`` with the similarity of two columns of features: 0.70 of the words' Jaccard and 0.30 of their bigrams';
    1 for equal normalised texts, 0 if one is empty or missing."""
    both = rows.withColumns({f"_{name}_{part}": F.size(F.array_intersect(F.col(a)[part], F.col(b)[part])) for part in ("words", "bigrams")})

    def shared(part: str) -> Column:
        n = F.col(f"_{name}_{part}")
        return F.when(n == 0, 0.0).otherwise(n / (F.size(F.col(a)[part]) + F.size(F.col(b)[part]) - n))

    x, y = F.col(a)["text"], F.col(b)["text"]
    mixed = F.lit(0.70) * shared("words") + F.lit(0.30) * shared("bigrams")
    value = F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(mixed)
    return both.withColumn(name, F.coalesce(value, F.lit(0.0))).drop(f"_{name}_words", f"_{name}_bigrams")


@F.pandas_udf(T.DoubleType())
def ratcliff_obershelp(a: pd.Series, b: pd.Series) -> pd.Series:
    """Gestalt similarity of two strings; it depends on the order of the arguments."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def hybrid_similarity(a: Column | str, b: Column | str) -> Column:
    """0.65 gestalt and 0.35 words' Jaccard of normalised texts; 1 for equal, 0 if one is empty. No built-in
    function gives the gestalt ratio, so it runs as an Arrow-batched function."""
    a, b = _c(a), _c(b)
    mixed = F.lit(0.65) * ratcliff_obershelp(a, b) + F.lit(0.35) * jaccard(F.array_distinct(words(a)), F.array_distinct(words(b)))
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).when(a == b, 1.0).otherwise(mixed)


def keyword_hits(x: Column | str, keywords: Sequence[str] = CREDIT_WORDS) -> Column:
    """How many of the keywords occur anywhere in the text; those inside others count too."""
    x = _c(x)
    return sum((x.contains(k).cast("int") for k in keywords[1:]), x.contains(keywords[0]).cast("int"))


def has_keyword(x: Column | str, keywords: Sequence[str] = CREDIT_WORDS) -> Column:
    return keyword_hits(x, keywords) > 0


def credit_score_words(x: Column | str) -> Column:
    """(a) 0.70 by hits up to three, and 0.30 for ten words of four characters or more."""
    long_words = F.size(F.filter(words(x), lambda t: F.length(t) >= 4))
    return F.lit(0.70) * F.least(keyword_hits(x) / F.lit(3.0), F.lit(1.0)) + F.when(long_words >= 10, 0.30).otherwise(0.0)


def credit_score_steps(x: Column | str) -> Column:
    """(b) 0, 0.5333, 0.7667 or 1 for no, one, two, or three and more hits of the longer list."""
    n = keyword_hits(x, CREDIT_WORDS + MORE_CREDIT_WORDS)
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), F.lit(0.30) + F.lit(0.70) * F.least(n / F.lit(3.0), F.lit(1.0))))


def credit_score_thirds(x: Column | str) -> Column:
    """(c) a third for each hit, 1 at most."""
    return F.least(F.lit(1.0), keyword_hits(x) / F.lit(3.0))


def credit_score_tenths(x: Column | str) -> Column:
    """(d) a tenth for each hit, 1 at most."""
    return F.least(F.lit(1.0), F.lit(0.1) * keyword_hits(x))


#: From which score on a text counts as a credit scene, by score.
CREDIT_THRESHOLDS = {"a": 0.35, "b": 0.35, "c": 0.35, "d": 0.30}
