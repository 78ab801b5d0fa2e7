"""Text functions that need Unicode's tables or a parser: Arrow-batched, and only for the rows that need them.

Rows that are plain ASCII (or hold no entity) reach Python as nulls and are computed by Spark's own functions.
"""

from __future__ import annotations

import html
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters that decomposition leaves whole, and their plain spelling: fixed values.
LETTERS = str.maketrans({"œ": "oe", "æ": "ae", "ø": "o", "đ": "d", "ħ": "h", "ł": "l", "ŧ": "t", "ı": "i", "ð": "d", "þ": "th"})


def fold_text(text: str) -> str:
    """Case folded, compatibility decomposed, without combining marks, ligatures and barred letters spelled out."""
    plain = unicodedata.normalize("NFKD", text.casefold())
    return "".join(c for c in plain if not unicodedata.combining(c)).casefold().translate(LETTERS)


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(fold_text, na_action="ignore")


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    def one(text: str) -> str | None:
        try:
            return json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return texts.map(one, na_action="ignore")


def folded(text: Column) -> Column:
    return F.coalesce(_folded(F.when(text.rlike(r"[^\x00-\x7F]"), text)), F.lower(text))


def unescaped(text: Column) -> Column:
    return F.coalesce(_unescaped(F.when(text.contains("&"), text)), text)


def canonical(text: Column) -> Column:
    return _canonical(text)
