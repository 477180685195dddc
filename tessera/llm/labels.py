"""The fold rule of labelled rows, shared by the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out. A null id has fold 0."""
    return F.coalesce((F.crc32(F.col(id_col).cast("string").cast("binary")) % 5).cast("int"), F.lit(0))


def training_ids(df: DataFrame, labels: DataFrame, label: str, id_col: str) -> DataFrame:
    """id, label (0 or 1) of the labelled ids of df outside fold 0; an id with two labels takes the larger. No text moves."""
    known = labels.where(f"{label} is not null").groupBy(F.col("doc_id").alias("id")).agg((F.max(label) > 0).cast("int").alias("label"))
    return known.where(fold("id") != 0).join(df.select(F.col(id_col).alias("id")), "id", "left_semi")
