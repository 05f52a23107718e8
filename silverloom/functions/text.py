"""Text helpers shared by the operators."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NON_ASCII = r"[^\x00-\x7F]"


@F.pandas_udf(T.StringType())
def _nfc_text(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfc_texts(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: [None if x is None else unicodedata.normalize("NFC", x) for x in xs], na_action="ignore")


def nfc(c: Column) -> Column:
    """NFC of a string column. Spark has no such function; only rows with non-ASCII text travel to Python."""
    return F.coalesce(_nfc_text(F.when(c.rlike(NON_ASCII), c)), c)


def nfc_all(c: Column) -> Column:
    """NFC of every element of an array of strings."""
    return F.coalesce(_nfc_texts(F.when(F.exists(c, lambda x: x.rlike(NON_ASCII)), c)), c)


@F.pandas_udf(T.StringType())
def _strip_marks(s: pd.Series) -> pd.Series:
    def strip(x: str) -> str:
        return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.category(c).startswith("M")))

    return s.map(strip, na_action="ignore")


def fold(c: Column) -> Column:
    """Lower case without diacritics; only non-ASCII text travels to Python."""
    low = F.lower(c)
    return F.coalesce(_strip_marks(F.when(low.rlike(NON_ASCII), low)), low)


def index_tokens(c: Column) -> Column:
    """Tokens of the full-text index: runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
