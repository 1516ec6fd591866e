"""Text expressions: phrases as literal alternations, ordered distinct lists, summaries. Built-in functions only."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quoted(term: str) -> str:
    """A term as a regular expression that Java and RE2 read alike."""
    return re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", term)


def alternation(terms: Iterable[str]) -> str:
    return "|".join(quoted(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))


#: White space of any script but the space; what Java's \s means with (?U).
_BLANKS = "\t\n\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.trim(c, F.lit(" " + _BLANKS))


def normal(c: Column) -> Column:
    """Lower case, runs of white space as one space, stripped."""
    return F.trim(F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", " "))


def shortest(terms: Iterable[str]) -> list[str]:
    """The terms that hold no other of them: a text that holds any term holds one of these."""
    terms = set(terms)
    return sorted(t for t in terms if not any(o in t for o in terms - {t}))


def contains_any(c: Column, terms: Iterable[str]) -> Column:
    """Whether the text holds any term; plain substring searches, which beat a pattern of alternatives by far."""
    return reduce(or_, (F.contains(c, F.lit(t)) for t in shortest(terms)), F.lit(False))


def has_phrase(c: Column, terms: Iterable[str]) -> Column:
    """Whether any term stands in the text with no letter a-z or digit at either side.

    The pattern, one literal for all terms, runs only over texts that hold one of them.
    """
    terms = sorted(set(terms))
    return let(c, lambda t: contains_any(t, terms) & t.rlike(f"(?<![a-z0-9])(?:{alternation(terms)})(?![a-z0-9])"))


def phrases_in(low: Column, terms: Iterable[str], letters: str = "0-9a-z") -> Column:
    """Which of the terms stand in a text in lower case with none of the letters at either side, in any order.

    The text is cut at its words (runs of letters) once. A term of one word is one of them; a longer one, whose first
    word is among them, is searched in the text: one pass for a whole dictionary, in place of a search for each term.
    """
    terms = sorted(set(terms))
    alone = [t for t in terms if re.fullmatch(f"[{letters}]+", t)]
    by_word: dict[str, list[str]] = {}
    for t in terms:
        if t not in alone:
            by_word.setdefault(re.match(f"[{letters}]*", t)[0], []).append(t)
    anywhere = by_word.pop("", [])
    texts = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    table = F.create_map(*(x for w, ts in by_word.items() for x in (F.lit(w), texts(ts)))) if by_word else None
    stands = lambda low, t: F.contains(low, t) & F.rlike(low, F.concat(F.lit(rf"(?<![{letters}])\Q"), t, F.lit(rf"\E(?![{letters}])")))

    def found(low: Column) -> Column:
        words = F.split(F.regexp_replace(low, f"[^{letters}]+", " "), " ")

        def among(met: Column) -> Column:
            longer = texts(anywhere) if table is None else F.concat(texts(anywhere), F.flatten(F.transform(F.array_intersect(met, texts(by_word)), lambda w: F.try_element_at(table, w))))
            return F.concat(F.array_intersect(met, texts(alone)), F.filter(longer, lambda t: stands(low, t)))

        return let(F.array_intersect(words, texts({*alone, *by_word})), among)

    return let(low, found)


def names(text: Column, name: Column, least: int = 3) -> Column:
    """Whether the text holds the name, case aside, with no letter a-z or digit at either side; a shorter name never counts."""
    n = F.lower(strip(F.coalesce(name, F.lit(""))))
    quoted_name = F.concat(F.lit("\\Q"), F.replace(n, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return (F.length(n) >= least) & F.rlike(F.lower(F.coalesce(text, F.lit(""))), F.concat(F.lit("(?<![0-9a-z])"), quoted_name, F.lit("(?![0-9a-z])")))


def union_distinct(*lists: Column) -> Column:
    """Stripped, non-blank values of all lists, each once, in order of first appearance."""
    every = F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists))
    return F.array_distinct(F.filter(F.transform(every, strip), lambda x: x != ""))


def distinct_ignoring_case(values: Column) -> Column:
    """Stripped, non-blank values, the first spelling of each kept."""
    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), strip), lambda x: x != "")
    folded = F.transform(clean, F.lower)
    return F.filter(clean, lambda x, i: F.array_position(folded, F.lower(x)) == i + 1)


def extractive_summary(description: Column, snippet: Column, title: Column, most: int) -> Column:
    """The first source with text, white space collapsed, cut at a word before `most` characters with an ellipsis.

    A source under ten characters is marked as unavailable.
    """
    squeeze = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))
    base = F.coalesce(squeeze(description), squeeze(snippet), squeeze(title), F.lit("No summary"))
    padded = F.length(base) < 10
    text = F.when(padded, F.concat(base, F.lit(" [summary unavailable]"))).otherwise(base)
    head = F.rtrim(F.substring(text, 1, most - 1))
    word = F.when(F.instr(head, " ") > 0, F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(head)
    word = F.when(F.length(word) + 1 < 10, F.substring(text, 1, most - 1)).otherwise(word)
    return F.when(F.length(text) <= most, text).when(padded, F.substring(text, 1, most)).otherwise(F.concat(word, F.lit("…")))


def plain_text(c: Column, most: int | None = None) -> Column:
    """Text of an HTML fragment: scripts and styles dropped, tags as spaces, common references decoded, spacing repaired.

    It is cut at `most` characters where a field's limit is given."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    t = F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    t = F.regexp_replace(t, r"\s+([.,;:!?])", "$1")
    return F.nullif(t if most is None else F.substring(t, 1, most), F.lit(""))
