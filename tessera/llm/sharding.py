"""Sharding: a keyed Feistel permutation with cycle walking over global row numbers.

A row's place in the reproducible shuffle is a pure function of (row number, row count, seed), so
its shard and slot are computed, never looked up, and the inverse gives the row for a slot.

Nulls: a null id sorts first, a null text has size 1 and the checksum of the empty text. Repeated
rows each get their own place; which of several identical rows gets which place can't be told apart.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, read_table

ROUNDS, SHARDS, SEED = 6, 16, 20_240_601


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _keys(seed: int) -> list[int]:
    return [int(k) for k in _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64), seed & 0xFFFFFFFFFFFFFFFF)]


def permute(numbers: np.ndarray, count: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """The image of each number of [0, count) under the permutation (or its inverse)."""
    half = np.uint64(max(1, ((max(count, 1) - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = _keys(seed)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left, k) & mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & mask)
        return (left << half) | right

    x = once(np.asarray(numbers).astype(np.uint64))
    while len(out := np.flatnonzero(x >= np.uint64(count))):  # the domain is under 4 x count: few steps
        x[out] = once(x[out])
    return x.astype(np.int64)


def shard_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row_no, position, shard, slot for every row of df.

    Shard counts differ by one at most; slots of a shard run from 0 without gaps.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, count = numbered(slim, [F.col("doc_id"), F.col("size"), F.col("text_crc32")], "shard-rows")

    @F.pandas_udf("long")
    def place(n: pd.Series) -> pd.Series:
        return pd.Series(permute(n.to_numpy(), count, seed))

    rows = rows.withColumn("position", place("row_no"))
    return rows.withColumn("shard", (F.col("position") % shards).cast("int")).withColumn("slot", F.expr(f"position div {int(shards)}"))


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
