"""Sinks. Spark's writers publish a folder only when every task has committed."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, fields: Sequence[str] | None = None) -> None:
    """``fields`` (default: all; one that ``df`` lacks is empty) as CSV with a header; null as an empty field."""
    fields = list(fields or df.columns)
    columns = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f) for f in fields]
    df.select(*columns).write.mode("overwrite").csv(path, header=True, emptyValue="", escape='"')


def split(df: DataFrame, path: str, public: Sequence[str]) -> None:
    """All columns under ``restricted``, the public ones under ``public``."""
    csv(df, f"{path}/restricted")
    csv(df, f"{path}/public", public)


def lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def summary(path: str, tables: Mapping[str, DataFrame], facts: Mapping, most_rows: int = 10_000) -> None:
    """Facts and small aggregates as one JSON file, put in place at once; a table of more rows is an error."""
    out = dict(facts)
    for name, df in tables.items():
        rows = df.limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{name} is no small aggregate")
        out[name] = [r.asDict(recursive=True) for r in rows]
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(out, f, indent=2, ensure_ascii=False, default=str)
        f.write("\n")
    os.replace(f"{path}.tmp", path)
