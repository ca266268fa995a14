"""The German stemmer of the Snowball family, written from its published description."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Fixed values of the published algorithm.
VOWELS = set("aeiouyäöü")
S_ENDING = set("bdfghklmnrt")
ST_ENDING = S_ENDING - {"r"}


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant behind a vowel, and again from there; R1 not before 3."""

    def after(start: int) -> int:
        for i in range(start + 1, len(word)):
            if word[i] not in VOWELS and word[i - 1] in VOWELS:
                return i + 1
        return len(word)

    first = after(0)
    return max(first, 3), after(first)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    marked = list(word.replace("ß", "ss"))
    for i in range(1, len(marked) - 1):
        if marked[i] in "uy" and marked[i - 1] in VOWELS and marked[i + 1] in VOWELS:
            marked[i] = marked[i].upper()
    w = "".join(marked)
    r1, r2 = _regions(w)

    def ends(region: int, *suffixes: str) -> str:
        """The longest of the suffixes at the word's end, if it stands in the region."""
        found = max((s for s in suffixes if w.endswith(s)), key=len, default="")
        return found if found and len(w) - len(found) >= region else ""

    if s := ends(r1, "em", "ern", "er", "e", "en", "es", "s"):
        if s != "s":
            w = w[: -len(s)]
            if s in ("e", "en", "es") and w.endswith("niss"):
                w = w[:-1]
        elif len(w) > 1 and w[-2] in S_ENDING:
            w = w[:-1]
    if s := ends(r1, "en", "er", "est", "st"):
        if s != "st":
            w = w[: -len(s)]
        elif len(w) >= 6 and w[-3] in ST_ENDING:
            w = w[:-2]
    if s := ends(r2, "end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"):
        if s in ("end", "ung"):
            w = w[: -len(s)]
            if w.endswith("ig") and not w.endswith("eig") and len(w) - 2 >= r2:
                w = w[:-2]
        elif s in ("ig", "ik", "isch"):
            if w[: -len(s)][-1:] != "e":
                w = w[: -len(s)]
        elif s in ("lich", "heit"):
            w = w[: -len(s)]
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = w[: -len(s)]
            if w.endswith("lich") and len(w) - 4 >= r2:
                w = w[:-4]
            elif w.endswith("ig") and len(w) - 2 >= r2:
                w = w[:-2]
    return w.lower().translate(str.maketrans("äöü", "aou"))


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    """The stems of arrays of lower-case words."""
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])


@lru_cache(maxsize=8)
def stop_words(language: str = "german") -> tuple[str, ...]:
    """The language's stop words, those that Spark has."""
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords(language))


def without_stop_words(words, language: str = "german"):
    """An array of words without the language's stop words."""
    return F.filter(words, lambda w: ~w.isin(*stop_words(language)))


def german(words):
    """The stems of an array of lower-case words, stop words left out: what a German text is searched by."""
    return stems(without_stop_words(words))


def german_terms(wanted: list[str]) -> list[str]:
    """The same of a query's terms, once each."""
    return list(dict.fromkeys(stem(t) for t in wanted if t not in stop_words()))
