"""Text analysis as Column expressions: text filters, a tokenizer, token filters.

Each piece is a function from Column to Column, so an analyzer is one expression that stays in
generated code. Any function of that shape can be used in place of the ones here.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = Callable[[Column], Column]

# fixed values: the characters that become spaces, the white space that ends a word, and all that goes at a text's ends
_PUNCTUATION = "\\]['\"!,.@#$%^&*()_+-={}|><`~±§?;:/"
_PUNCTUATION_CLASS = r"[\\\]\['\"!,.@#$%^&*()_+\-={}|><`~±§?;:/]"
_SPACE = " \t\n\x0b\f\r"  # \s
_BLANK = _SPACE + "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # [\s\p{Z}]
# between two words: white space or punctuation, with blanks that stand alone in it
_GAP = rf"[\s{_PUNCTUATION_CLASS[1:-1]}](?:[\s\p{{Z}}{_PUNCTUATION_CLASS[1:-1]}]*[\s{_PUNCTUATION_CLASS[1:-1]}])?"


def lower_case(text: Column) -> Column:
    return F.lower(text)


def elision(text: Column) -> Column:
    """Drop apostrophes, so that a contraction is one word."""
    return F.replace(F.replace(text, F.lit("'"), F.lit("")), F.lit("’"), F.lit(""))


def interpunction(text: Column) -> Column:
    """Each punctuation mark becomes one space; white space at the ends goes."""
    return F.btrim(F.regexp_replace(text, _PUNCTUATION_CLASS, " "), F.lit(_BLANK))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t.rlike(r"[^\s\p{Z}]"))


def _words(text: Column) -> Column:
    """``split_words(interpunction(text))`` in one pass over the text, and none over its words."""
    return F.array_remove(F.split(F.btrim(text, F.lit(_BLANK + _PUNCTUATION)), _GAP), "")


def keyword(text: Column) -> Column:
    """The whole text, empty or not, as one token."""
    return F.array(text)


def ngrams(n: int) -> Step:
    """Character n-grams of all tokens joined together, each once, in order."""

    def apply(tokens: Column) -> Column:
        joined = F.array_join(tokens, "")
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(joined) - (n - 1))), lambda i: F.substring(joined, i, F.lit(n)))
        return F.when(~joined.rlike(r"[^\s\p{Z}]"), F.array().cast("array<string>")).otherwise(F.array_distinct(grams))

    return apply


def edge_ngrams(least: int, most: int) -> Step:
    """Prefixes and suffixes of least to most characters of each token, each once, in order."""

    def of(t: Column) -> Column:
        sizes = F.sequence(F.lit(least), F.greatest(F.lit(least), F.least(F.lit(most), F.length(t))))
        both = F.flatten(F.transform(sizes, lambda k: F.array(F.substring(t, F.lit(1), k), F.substring(t, F.length(t) - k + 1, k))))
        return F.when(F.length(t) <= least, F.array(t)).otherwise(both)

    return lambda tokens: F.array_distinct(F.flatten(F.transform(tokens, of)))


@dataclass(frozen=True)
class Analyzer:
    text_filters: Sequence[Step] = (lower_case, elision, interpunction)
    tokenizer: Step = split_words
    token_filters: Sequence[Step] = ()

    def tokens(self, text: Column) -> Column:
        filters, split = tuple(self.text_filters), self.tokenizer
        if split is split_words and filters[-1:] == (interpunction,):
            filters, split = filters[:-1], _words
        for f in filters:
            text = f(text)
        out = split(text)
        for f in self.token_filters:
            out = f(out)
        return out


KEYWORD = Analyzer((), keyword)
