"""Canonical JSON: sorted keys, no spaces, other than ASCII kept. Spark's to_json doesn't sort keys, so this is an Arrow function."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Each JSON text in canonical form; what isn't JSON stays as it is, null stays null."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        try:
            return json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return x

    return text.map(one)


def nested_keys(text: str) -> list[str]:
    """All keys of a JSON text at any depth, in order of appearance; none for other texts."""
    try:
        todo, out = [json.loads(text)], []
    except ValueError:
        return []
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            out += list(x)
            todo += list(x.values())[::-1]
        elif isinstance(x, list):
            todo += x[::-1]
    return out
