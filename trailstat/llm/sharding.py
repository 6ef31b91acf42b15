"""Jump consistent hashing of stable keys onto shards (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import documents, passing, slots, spool

MULTIPLIER = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each 64-bit key. No ring table: each key jumps forward through ln(n) candidate shards.

    From n to n + 1 shards a key either stays or goes to shard n; 1/(n+1) of the keys go.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    key = np.asarray(keys).astype(np.uint64)
    shard = np.zeros(len(key), np.int64)
    jump = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = jump[live]
        key[live] = key[live] * MULTIPLIER + np.uint64(1)
        slow = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[live] = ((shard[live] + 1).astype(np.float64) * (float(1 << 31) / slow)).astype(np.int64)
        live = live[jump[live] < n_shards]
    return shard.astype(np.int32)


def jump_udf(n_shards: int):
    @pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), n_shards))

    return shard


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``key``: the shard depends on doc_id and the number of shards alone, so repeated rows of an id
    (equal texts or not) share a shard, and with one more shard rows move only into it. Slots order a
    shard by doc_id, crc, size. Null text: size 1, crc 0; a null doc_id is keyed by -1; an empty table
    gives an empty result; other columns are ignored.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long"))
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_udf(n_shards)(key).alias("shard"),
        jump_udf(n_shards + 1)(key).alias("grown_shard"),
    )
    with passing(docs.sparkSession) as keep:
        placed = slots(spool(rows, "shard"), ["shard"], ["doc_id", "text_crc32", "size"], "slot", "shard-slots", keep)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), 16)
