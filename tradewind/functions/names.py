"""Supplier names: normal form, legal forms, accents, aliases."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tradewind.dictionaries import LEAST_DERIVED_ALIAS, LEGAL_FORMS, UNDECOMPOSABLE


@F.pandas_udf(StringType())
def _compatible_folded(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC").str.casefold()


@F.pandas_udf(StringType())
def _without_accents(s: pd.Series) -> pd.Series:
    bare = s.str.translate(str.maketrans(UNDECOMPOSABLE)).str.normalize("NFD").str.replace(r"[\u0300-\u036f\u0483-\u0487\u0591-\u05bd\u064b-\u065f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\ufe20-\ufe2f]", "", regex=True)
    return bare.str.normalize("NFC").str.split().str.join(" ")


def normal_name(name: Column, ascii_only: bool = False) -> Column:
    """Compatibility-composed, case-folded, all but letters and digits as one space, stripped.

    Spark has no Unicode normalisation, so names beyond ASCII need an Arrow function, which Spark runs for every row of
    the column it is in; with ascii_only the plan stays free of Python. supply.keyed runs it for distinct names alone.
    """
    folded = F.lower(F.coalesce(name, F.lit("")))
    if not ascii_only:
        folded = F.when(name.rlike(r"^[\x00-\x7F]*$"), folded).otherwise(_compatible_folded(F.coalesce(name, F.lit(""))))
    return F.trim(F.regexp_replace(folded, r"(?U)[\W_]+", " "))


def without_accents(normalized: Column) -> Column:
    return F.when(normalized.rlike(r"^[\x00-\x7F]*$"), normalized).otherwise(_without_accents(normalized))


def without_legal_form(normalized: Column) -> Column:
    """Trailing legal forms off, again and again, the longest of three, two or one joined tokens first; never to nothing."""
    forms = F.array(*map(F.lit, LEGAL_FORMS))

    def shed(parts: Column, _: Column) -> Column:
        size = F.size(parts)
        out = parts
        for n in (1, 2, 3):  # the last test, of most tokens, is the outermost and so comes first
            tail = F.array_join(F.slice(parts, F.greatest(size - n + 1, F.lit(1)), F.lit(n)), "")
            out = F.when((size > n) & F.array_contains(forms, tail), F.slice(parts, F.lit(1), F.greatest(size - n, F.lit(0)))).otherwise(out)
        return out

    parts = F.split(normalized, " ")
    return F.array_join(F.aggregate(F.sequence(F.lit(1), F.size(parts)), parts, shed), " ")


def alias_forms(name: Column, ascii_only: bool = False) -> Column:
    """The spellings that stand for a supplier: normal form, without legal form, and both without accents, each once."""
    whole = normal_name(name, ascii_only)
    short = without_legal_form(whole)
    long_enough = lambda c: F.when(F.length(c) >= LEAST_DERIVED_ALIAS, c)
    forms = [F.nullif(whole, F.lit("")), long_enough(short)]
    if not ascii_only:
        forms += [long_enough(without_accents(whole)), long_enough(without_accents(short))]
    return F.array_distinct(F.array_compact(F.array(*forms)))
