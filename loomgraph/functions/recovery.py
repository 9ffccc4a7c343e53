"""Objects out of a model's answer: JSON as it is, in a fence, or somewhere in the text."""
from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"^```[A-Za-z]*\s*|\s*```$")


def parse_answer(answer: str | None) -> dict | None:
    """The object in an answer, or None. Tried in turn: the whole, the text within a fence,
    the widest braces, and those less trailing commas."""
    s = _FENCE.sub("", (answer or "").strip())
    braces = s[s.find("{") : s.rfind("}") + 1] if "{" in s else ""
    for candidate in (s, braces, re.sub(r",\s*([}\]])", r"\1", braces)):
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def _plain(answers: pd.Series) -> pd.Series:
    return answers.map(parse_answer).map(lambda d: None if d is None else json.dumps(d, ensure_ascii=False, sort_keys=True))


_plain.__annotations__ = {"answers": pd.Series, "return": pd.Series}


def recovered_json(answers: Column | str) -> Column:
    """The object of each answer as plain JSON, null where there is none."""
    return F.pandas_udf(_plain, "string")(answers)
