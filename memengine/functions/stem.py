"""Suffix stripping of English words in five steps (Porter, 1980), for tokenisers that index stems."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_V, _C = "(?:[aeiou]|(?<=[^aeiou])y)", "(?:[^aeiouy]|(?<=[aeiou])y|^y)"
_MEASURE = re.compile(f"{_V}+{_C}+")
_VOWEL, _DOUBLE = re.compile(_V), re.compile(r"([^aeiouylsz])\1$")
_SHORT = re.compile(f"{_C}{_V}(?![wxy]){_C}$")

# fixed values: suffixes of steps 2, 3 and 4
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def measure(stem: str) -> int:
    return len(_MEASURE.findall(stem))


def _longest(word: str, suffixes) -> str | None:
    return next((s for s in sorted(suffixes, key=len, reverse=True) if word.endswith(s)), None)


@lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, and those with other characters, stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) else word
    elif cut := next((s for s in ("ed", "ing") if word.endswith(s) and _VOWEL.search(word[: -len(s)])), None):
        word = word[: -len(cut)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _DOUBLE.search(word):
            word = word[:-1]
        elif measure(word) == 1 and _SHORT.search(word):
            word += "e"
    if word.endswith("y") and _VOWEL.search(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if (s := _longest(word, table)) and measure(word[: -len(s)]):
            word = word[: -len(s)] + table[s]
    if (s := _longest(word, _STEP4)) and measure(word[: -len(s)]) > 1 and (s != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(s)]
    if word.endswith("e") and (measure(word[:-1]) > 1 or measure(word[:-1]) == 1 and not _SHORT.search(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    return words.map(lambda x: None if x is None else [stem(w) for w in x])
