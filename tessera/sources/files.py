"""File sources and sinks on any Hadoop file system."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "document_name string, url string, title string, source string, domain string, text string"


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, text of every .txt file (any case) directly under a folder; Spark's reader leaves out empty files, so their names are listed."""
    where, fs = _path(spark, folder)
    names = [(s.getPath().getName(), "") for s in fs.listStatus(where) if s.isFile() and s.getLen() == 0]
    empty = spark.createDataFrame([n for n in names if n[0].lower().endswith(".txt")], "file_name string, text string")
    rows = spark.read.option("pathGlobFilter", "*.[tT][xX][tT]").text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text")).unionByName(empty)


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _path(spark, path)
    return fs.exists(where)


def replace(spark: SparkSession, made: str, path: str) -> None:
    """Puts what was made in one folder at another place: the old one is moved aside, and deleted once the new one stands."""
    (new, fs), (at, _), (old, _) = _path(spark, made), _path(spark, path), _path(spark, f"{path}.{uuid.uuid4().hex}.old")
    had = fs.exists(at)
    if had and not fs.rename(at, old):
        raise OSError(f"cannot move {path}")
    if not fs.rename(new, at):
        if had:
            fs.rename(old, at)
        raise OSError(f"cannot move {made} to {path}")
    if had:
        fs.delete(old, True)


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> bool:
    """Writes rows as JSON lines, whole or not at all; leaves what is there unless overwrite. Tells whether it wrote."""
    spark = df.sparkSession
    if not overwrite and exists(spark, path):
        return False
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    df.write.json(temp)
    replace(spark, temp, path)
    return True


def write_manifest(documents: DataFrame, path: str) -> None:
    """One row for each URL, the last `crawled_at` of it, replacing the manifest at `path`."""
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    newest = documents.groupBy("url").agg(F.max_by(F.struct(*[n for n in names if n != "url"]), "crawled_at").alias("d")).select("url", "d.*")
    write_json(newest.select(*names), path, overwrite=True)


def with_manifest(local: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """document_name, text and metadata of local files(file_name, text), with the manifest's documents in their place where names meet."""
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    own = local.select(F.col("file_name").alias("document_name"), "text")
    own = own.select(*(F.col(n) if n in own.columns else F.lit(None).cast("string").alias(n) for n in names))
    if not exists(spark, path):
        return own
    crawled = spark.read.schema(MANIFEST).json(path)
    return own.join(crawled.select("document_name"), "document_name", "left_anti").select(*names).unionByName(crawled)


def write_report(spark: SparkSession, path: str, rows: DataFrame, title: str, metrics: Sequence[str]) -> None:
    """results.json, per_query (CSV) and report.md of an evaluation's summary rows (a few systems and categories)."""
    write_json(rows, f"{path}/results.json", overwrite=True)
    rows.select(*(c for c, t in rows.dtypes if not t.startswith("array"))).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/per_query.csv")
    keys = [c for c in rows.columns if c not in metrics]

    def cells(values: Sequence[Column]) -> Column:
        return F.concat(F.lit("| "), F.concat_ws(" | ", *values), F.lit(" |"))

    head = [f"# {title}", "", "| " + " | ".join([*keys, *metrics]) + " |", "|" + "---|" * (len(keys) + len(metrics))]
    body = rows.orderBy(*keys).select(cells([*(F.col(k).cast("string") for k in keys), *(F.format_number(m, 4) for m in metrics)]).alias("line"))
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(head)], "n long, line string").unionByName(body.withColumn("n", F.lit(len(head)).cast("long") + F.monotonically_increasing_id()))
    lines.coalesce(1).sortWithinPartitions("n").select("line").write.mode("overwrite").text(f"{path}/report.md")
