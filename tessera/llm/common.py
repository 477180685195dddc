"""Helpers that several corpus operators share: scratch tables, global numbering, components.

Every operator takes a DataFrame and the names of its id and text columns, selects only those, and
so is indifferent to other columns and to their names.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Low bits of monotonically_increasing_id() that count rows inside one partition.
ROW_BITS = 33


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share; a temporary one only in local mode with none set."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir"):
        return found
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        if not hasattr(shared_dir, "own"):
            shared_dir.own = "file://" + tempfile.mkdtemp(prefix="tessera-")
        return shared_dir.own
    return conf.get("spark.sql.warehouse.dir", "spark-warehouse") + "/_scratch"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def drop_stash(df: DataFrame) -> None:
    """Deletes what stash() wrote, once nothing reads it any more."""
    spark, path = df.sparkSession, df._tessera_path
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_holding: list = []


def hold_memo(owner: str, forget: Callable[[], None]) -> None:
    """To be called by a task before it uses what its Python worker remembers for `owner`: what it remembers for another goes.

    Workers are used again by the next stage, and would otherwise hold the words of all stages at once.
    """
    if _holding and _holding[0] != owner:
        _holding[1]()
    _holding[:] = owner, forget


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, whatever it has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def join_hot(left: DataFrame, right: DataFrame, keys: Sequence[str], count: str, most: int = 10_000) -> DataFrame:
    """The inner join of left with right (unique on keys; `count`: how many rows of left have the key).

    Keys with more than a tenth of a thousandth of the counted rows are at most `most`, so a broadcast of these is
    bounded; only the others are shuffled, and no key meets in one task.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = max(1000, total // most)
    keys, more = list(keys), [c for c in right.columns if c not in (*keys, count)]
    flag, value = spare(left, "hot", "value")
    often = right.where(F.col(count) > hot).select(*keys, F.struct(F.lit(1).alias(flag), *more).alias(value))
    both = left.join(F.broadcast(often), keys, "left")
    names = [c for c in left.columns if c not in keys]
    near = both.where(F.col(value).isNotNull()).select(*keys, *names, *(F.col(f"{value}.{c}") for c in more))
    far = both.where(F.col(value).isNull()).drop(value).join(right.where(F.col(count) <= hot).select(*keys, *more), keys)
    return near.union(far.select(*keys, *names, *more))


def numbered(df: DataFrame, order: Sequence[Column], name: str, total: str | None = None) -> tuple[DataFrame, int]:
    """df with `row_no`, its place (from 0) in the global order, and the row count.

    One range shuffle; rows are never gathered in one task. The driver sees one count per partition.
    With `total`, adds `before`: the sum of that column over all earlier rows. Give an order that
    leaves only identical rows tied.
    """
    spark = df.sparkSession
    placed = stash(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("_at", ROW_BITS)
    amount = F.coalesce(F.sum(total), F.lit(0)) if total else F.lit(0)
    rows = sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), amount.cast("long").alias("amount")).collect())
    offsets, seen, summed = [], 0, 0
    for r in rows:
        offsets.append((r["part"], seen, summed))
        seen, summed = seen + r["n"], summed + r["amount"]
    table = F.broadcast(spark.createDataFrame(offsets, "_part long, _rows long, _amount long"))  # a row per partition
    out = placed.withColumn("_part", part).join(table, "_part").withColumn("row_no", F.col("_at").bitwiseAND((1 << ROW_BITS) - 1) + F.col("_rows"))
    if total:
        from pyspark.sql import Window

        w = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", F.col("_amount") + F.coalesce(F.sum(total).over(w), F.lit(0)))
    return out.drop("_part", "_at", "_rows", "_amount"), seen


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges(u long, v long)`; root is the smallest node reachable.

    Alternating large-star and small-star steps, each a grouped minimum and a join; each round is a
    table in the shared folder. Stops when a round changes nothing.
    """
    spark = edges.sparkSession
    now = stash(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).where("n > 0").select("u", F.least("u", "m").alias("m"), "n")
        large = join_hot(both.where("v > u"), least, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stash(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_hot(large, low, ["u"], "n").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stash(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_stash(now)
        drop_stash(large)
        now, was = after, mark
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == was or not mark[0]:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
