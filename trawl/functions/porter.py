"""The stemmer of Porter (1980), over the distinct words of a corpus.

Words become patterns of v (vowels) and c (consonants), on which the measure
and the other conditions are regular expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the suffixes of the published algorithm, with what replaces them
_SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_FOURTH = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    out = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _restore(word: str) -> str:
    if word[-2:] in ("at", "bl", "iz"):
        return word + "e"
    if _doubled(word) and word[-1] not in "lsz":
        return word[:-1]
    return word + "e" if _measure(word) == 1 and _short(word) else word


def _replaced(word: str, table: dict[str, str]) -> str:
    for suffix in (s for s in table if word.endswith(s)):
        rest = word.removesuffix(suffix)
        return rest + table[suffix] if _measure(rest) else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    for suffix, less in (("sses", 2), ("ies", 2), ("ss", 0), ("s", 1)):
        if word.endswith(suffix):
            word = word[: len(word) - less]
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                word = _restore(word.removesuffix(suffix)) if "v" in _shape(word.removesuffix(suffix)) else word
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _SECOND), _THIRD)
    suffix = max((s for s in _FOURTH if word.endswith(s)), key=len, default="")
    if suffix:
        word = word.removesuffix(suffix) if _measure(word.removesuffix(suffix)) > 1 else word
    elif word.endswith(("sion", "tion")) and _measure(word[:-3]) > 1:
        word = word[:-3]
    if word.endswith("e"):
        rest = word[:-1]
        word = rest if _measure(rest) > 1 or (_measure(rest) == 1 and not _short(rest)) else word
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def with_stems(tokens: DataFrame, term: str = "term") -> DataFrame:
    """``tokens`` with ``term`` replaced by its stem; only distinct words go through Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(_stem=batch[term].map(stem))

    stems = tokens.select(term).distinct().mapInPandas(run, f"{term} string, _stem string")
    return tokens.join(stems, term).withColumn(term, F.col("_stem")).drop("_stem")
