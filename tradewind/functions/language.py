"""A language detector of built-in functions: the language with most function words in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradewind.functions.text import let

#: Frequent function words by language, chosen so that few are shared; the first language of equals is taken.
FUNCTION_WORDS = {
    "en": ("the", "and", "of", "to", "in", "for", "with", "that", "is", "by"),
    "de": ("der", "die", "das", "und", "nicht", "mit", "von", "den", "ist", "für"),
    "fr": ("le", "les", "des", "et", "une", "pour", "dans", "que", "est", "sur"),
    "es": ("el", "los", "las", "y", "una", "por", "del", "con", "para", "como"),
    "it": ("il", "gli", "della", "che", "di", "non", "sono", "per", "nel", "alla"),
    "nl": ("het", "een", "van", "voor", "niet", "zijn", "op", "met", "dat", "ook"),
    "pt": ("o", "os", "da", "do", "em", "uma", "não", "com", "ao", "pelo"),
    "pl": ("w", "na", "się", "jest", "nie", "z", "do", "że", "oraz", "przez"),
    "cs": ("je", "že", "na", "se", "který", "pro", "však", "jako", "při", "také"),
    "sv": ("och", "att", "det", "som", "för", "inte", "på", "är", "av", "till"),
    "da": ("og", "det", "ikke", "til", "af", "som", "på", "er", "med", "blev"),
    "fi": ("ja", "on", "ei", "se", "että", "joka", "ovat", "myös", "kun", "mutta"),
}
LEAST_CHARACTERS = 10
SPLIT = "[^a-zà-öø-ÿąćęłńśźżčďěňřšťůž]+"


def detected(text: Column) -> Column:
    """The code of the language with most function words; null for a text under ten characters, or without any of them."""

    def best(words: Column) -> Column:
        count = lambda own: F.size(F.filter(words, lambda w: w.isin(*own)))
        return F.array_max(F.array(*(F.struct(count(own).alias("n"), F.lit(-k).alias("place"), F.lit(code).alias("code")) for k, (code, own) in enumerate(FUNCTION_WORDS.items()))))

    found = let(F.split(F.lower(text), SPLIT), best)
    return F.when((F.length(text) >= LEAST_CHARACTERS) & (found["n"] > 0), found["code"])


def gate(language: Column, title: Column, has_content: Column) -> Column:
    """Why an article's language is rejected, or null: not detected, not as stated, or not supported.

    An article without a description or a snippet is not looked at.
    """
    found = detected(title)
    return F.when(has_content, F.when(found.isNull(), "Language not detected").when(found != language, "Language mismatch").when(~language.isin(*FUNCTION_WORDS), "Unsupported language"))
