"""Canonical JSON: sorted keys, ', ' and ': ' between parts, ASCII only. An Arrow UDF, as no built-in sorts keys."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def _canon(text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(json.loads(text), sort_keys=True)
    except ValueError:
        return None


@pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """The canonical form of a JSON text; null for null and for what is no JSON."""
    return text.map(_canon)
