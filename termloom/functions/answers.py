"""Objects in the answers of text generators, in Arrow batches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, in the order in which they are looked for.
FINAL_MARKS = ("<|start|>assistant<|channel|>final<|message|>", "<|start|>assistant<|channel|>final", "<|end|><|start|>assistant<|channel|>final", "assistantfinal")
_FENCE = re.compile(r"```(?:json)?\s*\n?([^`]+)```")


def answer(text: str | None):
    """What an answer says in JSON: its whole final part, else the last object in it with descriptions, else the last object; None without any."""
    mark = next((m for m in FINAL_MARKS if m in (text or "")), None)
    part = (text or "").rpartition(mark)[2].strip() if mark else text or ""
    fenced = _FENCE.findall(part)
    part = fenced[-1].strip() if fenced else part
    try:
        return json.loads(part)
    except ValueError:
        pass
    found, decoder = [], json.JSONDecoder()
    for at in (m.start() for m in re.finditer("{", part)):
        try:
            found.append(decoder.raw_decode(part, at)[0])
        except ValueError:
            continue
    told = [x for x in found if isinstance(x.get("descriptions"), list) and x["descriptions"]]
    return (told or found or [None])[-1]


def answer_json(text: Column | str) -> Column:
    """answer() as JSON; null where there is none."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        found = (answer(t) for t in texts)
        return pd.Series([None if x is None else json.dumps(x) for x in found], dtype=object)

    return run(text)
