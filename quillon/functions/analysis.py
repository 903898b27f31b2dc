"""Text analysis as Column expressions: char filters, tokenizers, token filters.

All but the Porter stemmers stays in code generation; a configuration is composed once and
applied to a whole column. Positions are indices into the filtered term list.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.stem import STEMMERS, stems

# The 33 English stopwords of the analyzer.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or",
    "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
TOKENIZERS = {
    "standard": r"[\p{L}\p{N}]+(?:[-_.][\p{L}\p{N}]+)*",
    "whitespace": r"\S+",
    "letter": r"\p{L}+",
    "unicode": r"[\p{L}\p{Nd}]+",
}
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
SYMBOLS = {"&": " and ", "@": " at ", "%": " percent ", "+": " plus "}


def html_strip(text: Column) -> Column:
    out = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def map_symbols(text: Column) -> Column:
    for char, word in SYMBOLS.items():
        text = F.replace(text, F.lit(char), F.lit(word))
    return text


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{P}", " ")


CHAR_FILTERS = {"html_strip": html_strip, "map_symbols": map_symbols, "strip_punctuation": strip_punctuation}


def tokenize(text: Column, tokenizer: str) -> Column:
    """The raw tokens of a text as array<string>; null text has none."""
    text = F.coalesce(text, F.lit(""))
    if tokenizer == "keyword":
        return F.filter(F.array(text), lambda t: t != "")
    if tokenizer == "path":
        parts = F.filter(F.split(text, "/"), lambda p: p != "")
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
        return F.filter(every, lambda t: t != "")
    return F.regexp_extract_all(text, F.lit(TOKENIZERS[tokenizer]), F.lit(0))


# Latin letters and their ASCII forms.
FOLDS = ("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY")


def fold_ascii(term: Column) -> Column:
    out = F.translate(term, *FOLDS)
    for char, plain in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("Æ", "AE"), ("Œ", "OE")):
        out = F.replace(out, F.lit(char), F.lit(plain))
    return out


def edge_ngrams(terms: Column, least: int = 2, most: int = 10) -> Column:
    def of(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(least), F.least(F.lit(most), F.length(t))), lambda n: F.left(t, n))

    return F.flatten(F.transform(F.filter(terms, lambda t: F.length(t) >= least), of))


def split_inner(terms: Column) -> Column:
    return F.filter(F.flatten(F.transform(terms, lambda t: F.split(t, "[-_.]"))), lambda t: t != "")


# Suffixes of the light stemmer, tried in this order, with what stands in their place.
LIGHT_RULES = (("ings", ""), ("ing", ""), ("ies", "y"), ("es", ""), ("s", ""), ("ed", ""), ("ly", ""))


def stem_light(term: Column) -> Column:
    """The first suffix rule that leaves two letters or more; words under four letters stay."""
    out = term
    for suffix, instead in reversed(LIGHT_RULES):
        short = F.concat(F.left(term, F.length(term) - len(suffix)), F.lit(instead))
        out = F.when(term.endswith(suffix) & (F.length(short) >= 2), short).otherwise(out)
    return F.when(F.length(term) >= 4, out).otherwise(term)


@dataclass(frozen=True)
class AnalyzerConfig:
    """Which steps apply, in the order of the fields."""

    char_filters: tuple[str, ...] = ()
    tokenizer: str = "standard"
    lowercase: bool = True
    folding: bool = False
    split: bool = False
    stopwords: bool = False
    stemmer: str = "none"
    edge_ngram: tuple[int, int] | None = None

    def terms(self, text: Column) -> Column:
        """The index terms of a text as array<string>."""
        return self.stages(text)[-1][1]

    def stages(self, text: Column) -> list[tuple[str, Column]]:
        """(name, value) after each step, for display."""
        out: list[tuple[str, Column]] = []
        for name in self.char_filters:
            text = CHAR_FILTERS[name](text)
            out.append((name, text))
        terms = tokenize(text, self.tokenizer)
        out.append((self.tokenizer, terms))
        steps = (
            ("lowercase", self.lowercase, lambda a: F.transform(a, F.lower)),
            ("ascii_folding", self.folding, lambda a: F.transform(a, fold_ascii)),
            ("split", self.split, split_inner),
            ("stopwords", self.stopwords, lambda a: F.filter(a, lambda t: ~t.isin(*STOPWORDS))),
            ("stem_light", self.stemmer == "light", lambda a: F.transform(a, stem_light)),
            (f"stem_{self.stemmer}", self.stemmer in STEMMERS, lambda a: stems(a, self.stemmer)),
        )
        for name, on, step in steps:
            if on:
                terms = step(terms)
                out.append((name, terms))
        if self.edge_ngram:
            terms = edge_ngrams(terms, *self.edge_ngram)
            out.append(("edge_ngram", terms))
        return out


DEFAULT = AnalyzerConfig()
ENGLISH = replace(DEFAULT, stopwords=True, stemmer="porter")
ENGLISH_LIGHT = replace(ENGLISH, stemmer="light")
#: What the JSON dialect's English is.
ENGLISH_JSON = replace(ENGLISH, tokenizer="unicode", stemmer="porter_json")
KEYWORD = AnalyzerConfig(tokenizer="keyword", lowercase=False)
PRESETS = {"default": DEFAULT, "english": ENGLISH, "english_light": ENGLISH_LIGHT, "english_json": ENGLISH_JSON, "keyword": KEYWORD}
