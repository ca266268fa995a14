"""Search terms, weighted vectors, ranks, excerpts. The rank is our own and explicit: each occurrence of a
term counts its weight, A 1.0, B 0.4, C 0.2; ties are broken by id. All terms must occur."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenum.functions.text import col, tokens

#: Weights of the parts of a vector.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}


def terms(query: str) -> list[str]:
    """The lexemes of a query: what is neither ASCII letter, digit, German letter nor blank vanishes."""
    kept = "".join(c for c in " ".join(query.split()) if c == " " or c.isascii() and c.isalnum() or c in "äöüßÄÖÜ")
    return list(dict.fromkeys(kept.lower().split()))


def escaped(term: str) -> str:
    """A term for LIKE, wildcards as plain characters."""
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_term(c, term: str) -> Column:
    """Case-insensitive contains."""
    return col(c).ilike(f"%{escaped(term)}%")


def starts_with_term(c, term: str) -> Column:
    return col(c).ilike(f"{escaped(term)}%")


def vector(stem=None, **parts) -> Column:
    """Terms with weights of columns given by weight: vector(A="title", B="full_text").

    Null in part A or B makes the vector null, which matches nothing; C counts as empty. stem maps an array
    of words to an array of stems.
    """
    stem = stem or (lambda words: words)
    weigh = lambda w: lambda t: F.struct(t.alias("term"), F.lit(WEIGHTS[w]).alias("weight"))
    weighted = [F.transform(stem(tokens(c)), weigh(w)) for w, c in parts.items()]
    whole = F.lit(True)
    for w, c in parts.items():
        whole = whole & col(c).isNotNull() if w in "AB" else whole
    return F.when(whole, F.concat(*weighted))


def matches(v: Column, wanted: list[str]) -> Column:
    """Whether every wanted term is in the vector; no terms match nothing."""
    if not wanted:
        return F.lit(False)
    words = F.transform(v, lambda x: x["term"])
    out = F.lit(True)
    for t in wanted:
        out = out & F.array_contains(words, t)
    return F.coalesce(out, F.lit(False))


def rank(v: Column, wanted: list[str]) -> Column:
    """Sum of the weights of all occurrences of wanted terms."""
    hits = F.filter(v, lambda x: x["term"].isin(wanted))
    return F.round(F.aggregate(hits, F.lit(0.0), lambda s, x: s + x["weight"]), 6)


def excerpt(c, term: str, radius: int) -> Column:
    """The first hit of a term with `radius` characters around it, dots where something is cut; null without a hit."""
    text = col(c)
    at = F.locate(term.lower(), F.lower(text))
    start = F.greatest(at - radius, F.lit(1))
    end = at + len(term) + radius
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substr(text, start, end - start), F.when(end - 1 < F.length(text), "...").otherwise(""))
    return F.when(at > 0, cut)


def highlight(c, wanted: list[str]) -> Column:
    """Wanted terms marked, in any case."""
    if not wanted:
        return col(c)
    import re

    pattern = "|".join(re.escape(t) for t in wanted)
    return F.regexp_replace(col(c), f"(?iu)({pattern})", "<mark>$1</mark>")


def multi_excerpt(c, query: str, radius: int = 100) -> Column:
    """Excerpts around every word of a query, joined by a blank, with the words marked."""
    wanted = query.split()
    return highlight(F.concat_ws(" ", *[excerpt(c, t, radius) for t in wanted]), wanted)
