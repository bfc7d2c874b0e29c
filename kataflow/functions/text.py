"""Column functions on tokens and texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token: letters or digits with marks, joined inside by apostrophes and hyphens. U+02BC is a letter too, so it may also stand at an end.
JOINERS = "'ʼ‐‑’-"
#: Possessive, so that neither long words nor long chains recurse; nothing follows that could need backtracking.
TOKEN = rf"[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}]*+(?:[{JOINERS}][\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}]*+)*+"


def tokens(text: Column | str) -> Column:
    """Array of a text's tokens: exact slices, case kept; null has none."""
    return F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(TOKEN), F.lit(0))


def has_ascii_letter(token: Column | str) -> Column:
    return F.lower(token).rlike("[a-z]")


def capitalized(text: Column) -> Column:
    """The first character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.char_length(text)))


def trimmed(text: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^[\s﻿]++|[\s﻿]++\z", "")


def strip_marks(text: str) -> str:
    """Canonically decomposed, without combining marks U+0300 to U+036F."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ")


def without_diacritics(text: Column) -> Column:
    """strip_marks() of a column; ASCII texts stay in the JVM."""
    @F.pandas_udf("string")
    def strip(s: pd.Series) -> pd.Series:
        return s.map(strip_marks, na_action="ignore")

    return F.when(text.rlike(r"[^\x00-\x7F]"), strip(text)).otherwise(text)
