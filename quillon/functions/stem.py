"""The Porter stemmer, in two sets of rules that differ in detail.

A word's letters are read as a string of 'c' and 'v' (a 'y' is a vowel behind
a consonant), on which the algorithm's conditions are plain string questions:
the measure of a stem is how often 'vc' stands in it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Suffixes with what stands in their place, and where the two rule sets differ."""

    second: tuple[tuple[str, str], ...]
    third: tuple[tuple[str, str], ...]
    fourth: tuple[str, ...]
    #: Suffixes of the fourth step that go only behind one of these letters.
    behind: tuple[tuple[str, str], ...]
    #: Whether the first suffix that fits ends a step though its condition fails.
    first_decides: bool
    plural_needs_vowel: bool
    #: Letters that don't close a consonant-vowel-consonant end.
    open_ends: str
    #: Least letters of a word whose last 'y' may become 'i'.
    least_y: int


DEFAULT = Rules(
    second=(
        ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
        ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
        ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
    ),
    third=(("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")),
    fourth=(
        "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous",
        "ive", "ize",
    ),
    behind=(("sion", "s"), ("tion", "t")),
    first_decides=True,
    plural_needs_vowel=False,
    open_ends="wxy",
    least_y=1,
)
JSON_DIALECT = replace(
    DEFAULT,
    second=(*(("abli", "able") if x == ("bli", "ble") else x for x in DEFAULT.second if x[0] != "logi"),),
    fourth=(*("ion" if x == "sion" else x for x in DEFAULT.fourth if x != "tion"),),
    behind=(("ion", "st"),),
    first_decides=False,
    plural_needs_vowel=True,
    open_ends="",
    least_y=3,
)


def shape(word: str) -> str:
    """'c' or 'v' for each letter."""
    out = ""
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def measure(stem: str) -> int:
    return shape(stem).count("vc")


class Porter:
    def __init__(self, rules: Rules):
        self.rules = rules

    def closed(self, stem: str) -> bool:
        """Ends in consonant, vowel, consonant."""
        return shape(stem).endswith("cvc") and stem[-1] not in self.rules.open_ends

    def swapped(self, word: str, pairs, least: int) -> str:
        for suffix, instead in pairs:
            if word.endswith(suffix):
                stem = word.removesuffix(suffix)
                if stem[-1:] not in dict(self.rules.behind).get(suffix, stem[-1:]) or (not stem and suffix in dict(self.rules.behind)):
                    continue
                if measure(stem) > least:
                    return stem + instead
                if self.rules.first_decides:
                    break
        return word

    def inflections(self, word: str) -> str:
        """Plurals, past tenses and participles, and a last 'y'."""
        if word.endswith(("sses", "ies")):
            word = word[:-2]
        elif word.endswith("s") and not word.endswith("ss") and (not self.rules.plural_needs_vowel or "v" in shape(word[:-1])):
            word = word[:-1]
        if word.endswith("eed"):
            if measure(word[:-3]):
                word = word[:-1]
        else:
            for suffix in ("ed", "ing"):
                stem = word.removesuffix(suffix)
                if stem != word and "v" in shape(stem):
                    word = self.mended(stem)
                    break
        if word.endswith("y") and len(word) >= self.rules.least_y and "v" in shape(word[:-1]):
            word = word[:-1] + "i"
        return word

    def mended(self, stem: str) -> str:
        """What is left of a word without -ed or -ing."""
        if stem.endswith(("at", "bl", "iz")):
            return stem + "e"
        if len(stem) > 1 and stem[-1] == stem[-2] and shape(stem)[-1] == "c":
            return stem if stem[-1] in "lsz" else stem[:-1]
        return stem + "e" if measure(stem) == 1 and self.closed(stem) else stem

    def stem(self, word: str) -> str:
        if len(word) < 3:
            return word
        word = self.inflections(word)
        word = self.swapped(word, self.rules.second, 0)
        word = self.swapped(word, self.rules.third, 0)
        word = self.swapped(word, [(x, "") for x in self.rules.fourth], 1)
        if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not self.closed(word[:-1]))):
            word = word[:-1]
        return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


STEMMERS = {"porter": Porter(DEFAULT), "porter_json": Porter(JSON_DIALECT)}


@lru_cache(maxsize=200_000)
def stem(word: str, kind: str) -> str:
    """A word's stem; the JSON dialect's rules look at bytes, not at letters."""
    if kind == "porter_json":
        return STEMMERS[kind].stem(word.encode().decode("latin-1")).encode("latin-1").decode("utf-8", "replace")
    return STEMMERS[kind].stem(word)


def stems(terms: Column, kind: str) -> Column:
    """The stems of array<string>, in batches; each worker keeps what it has stemmed."""

    def step(lists: pd.Series) -> pd.Series:
        return lists.map(lambda words: None if words is None else [stem(w, kind) for w in words])

    return F.pandas_udf(step, "array<string>")(terms)
