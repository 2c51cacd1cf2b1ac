"""Text functions shared by the operators."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFC; Spark has no builtin for it."""
    for s in values:
        yield s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def nfkc(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in values:
        yield s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def nfkc_text(text: Column) -> Column:
    """NFKC by the Unicode library that Spark's collations bring along: rows stay in the partitions where they lie.  ASCII is left alone."""
    compose = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(F.octet_length(text) > F.length(text), compose).otherwise(text)


def normal_text(text: Column) -> Column:
    """Line feeds for CR and CRLF, no byte order mark."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"^﻿", "")


def collapsed(text: Column) -> Column:
    """White space runs (Unicode) as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


#: Characters that NFC leaves as they are, whatever stands beside them: no marks, no jamo, none with another form.
STABLE = r"\x{0}-\x{2FF}\x{400}-\x{482}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}\x{2190}-\x{22FF}\x{2500}-\x{27BF}\x{3000}-\x{3029}\x{3041}-\x{3096}\x{30A1}-\x{30FE}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}\x{FF01}-\x{FF9D}\x{1F300}-\x{1F64F}"


def evidence_text(text: Column) -> Column:
    """NFC, then collapsed: the form in which a quotation is looked for.  Only texts that NFC may change go through Python."""
    other = (F.octet_length(text) > F.length(text)) & text.rlike(f"[^{STABLE}]")
    return collapsed(F.coalesce(nfc(F.when(other, text)), text))


def folded(text: Column) -> Column:
    """Collapsed and lower-cased; punctuation stays."""
    return F.lower(collapsed(text))


def tokens(text: Column) -> Column:
    """Lower-case word tokens: letters or digits, with one apostrophe part."""
    return F.regexp_extract_all(F.lower(F.translate(text, "’", "'")), F.lit(r"[\p{L}\p{N}]+(?:'\p{L}+)?"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays as sets; 0 if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def natural_key(text: Column, width: int = 12) -> Column:
    """A key that sorts digit runs by value: lower case, digit runs without leading zeros padded to width."""
    padded = F.regexp_replace(F.lower(text), r"0*(\d+)", "0" * width + "$1")
    return F.regexp_replace(padded, rf"0*(\d{{{width}}})(?!\d)", "$1")


def digits_masked(text: Column) -> Column:
    return F.regexp_replace(text, r"\d+", "#")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, the unit of stored offsets."""
    return (F.length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))


def has_text(value: Column) -> Column:
    """Whether a string holds anything but white space."""
    return F.coalesce(value.rlike(r"(?U)\S"), F.lit(False))


def answered(values: Column) -> Column:
    """Whether a list of answers holds a non-blank item."""
    return F.coalesce(F.exists(values, lambda x: F.coalesce(x.rlike(r"(?U)\S"), F.lit(False))), F.lit(False))
