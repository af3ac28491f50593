"""Stemming, hashing and embedding functions in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fnv1a(s: str) -> int:
    """32-bit FNV-1a over UTF-16 code units."""
    h = 0x811C9DC5
    for i in range(0, len(b := s.encode("utf-16-le", "surrogatepass")), 2):
        h = ((h ^ (b[i] | b[i + 1] << 8)) * 0x01000193) & 0xFFFFFFFF
    return h


_slot = lru_cache(maxsize=500_000)(fnv1a)


def hash_vector(text: str | None, dim: int = 64) -> list[float]:
    """Normalised counts of a text's words by hash slot; all zero without words."""
    v = np.zeros(dim)
    for w in re.findall("[a-z0-9]+", (text or "").lower()):
        v[_slot(w) % dim] += 1.0
    n = np.sqrt((v * v).sum())
    return (v / n if n else v).tolist()


def hash_embed(text: Column | str, dim: int = 64) -> Column:
    """Column of hash vectors."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([hash_vector(t, dim) for t in texts], index=texts.index)

    return F.pandas_udf(run, "array<double>")(text)


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    kinds = "".join("v" if _vowel(stem, i) else "c" for i in range(len(stem)))
    return len(re.findall("v+c+", kinds))


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and not _vowel(w, n - 1) and _vowel(w, n - 2) and not _vowel(w, n - 3) and w[-1] not in "wxy"


# Suffix tables of Porter's algorithm (1980), steps 2, 3 and 4.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _replaced(w: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > 0 else w
    return w


@lru_cache(maxsize=500_000)
def porter(w: str) -> str:
    """Porter stem of a lower-case ASCII word."""
    if len(w) < 3 or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and _has_vowel(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, _STEP2), _STEP3)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in "st"):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if _measure(w) > 1 and w.endswith("ll"):
        w = w[:-1]
    return w


def index_tokens(text: str | None) -> list[str]:
    """Stemmed words of a text: Unicode letters and digits, accents folded, lower case."""
    flat = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))
    return [porter(t) for t in re.findall(r"[^\W_]+", flat)]


def stemmed(text: Column | str) -> Column:
    """Column of stemmed tokens."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([index_tokens(t) for t in texts], index=texts.index)

    return F.pandas_udf(run, "array<string>")(text)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays over their common length; 0 if either has no length."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, p: s + p.cast("double") * p.cast("double")))
    both = norm(x) * norm(y)
    return F.when(both > 0, dot / both).otherwise(0.0)
