"""Columns whose values come from injected callables."""
from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def asked(answer: Callable[[str], object], prompt: Column, kind: str = "string", strict: bool = False) -> Column:
    """What ``answer`` gives for each prompt, an Arrow batch at a time. A null prompt is not
    asked and stays null; so does one whose call fails, unless ``strict``."""
    def one(text: str | None):
        if text is None:
            return None
        try:
            return answer(text)
        except Exception:
            if strict:
                raise
            return None

    def batch(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype="float64" if kind == "double" else "object")

    batch.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, kind)(prompt)
