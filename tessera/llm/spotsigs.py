"""Document fingerprints: SpotSigs, DataFrame functions only.

A signature is an anchor, a common word that stands right before a content word, with the chain of
CHAIN content words that starts there. The fingerprint of a text is its set of signature hashes (32
bits each), sorted, as hexadecimal text; likeness is the Jaccard coefficient of two sets. In every
text, chains without an anchor are signatures too if their hash is a multiple of SHARE, and so is the
chain of least hash: what is taken of a passage does not hang on whether the text has anchors. Texts
with fewer content words than a chain take all words as one signature; without words the set is empty.
Two empty sets are alike.

Near-duplicates: sets of length n can only reach likeness t with lengths from t n to n / t, so sets
are dealt over partitions of the length axis whose width grows with the length; within a partition
and the next, sets that share one of their first n - ceil(t n) + 1 signatures, rarest first, are
compared. Equal sets are first brought together, and copies are never paired. A signature that more
than HOT sets of a partition have among those is not paired at once: its sets meet the shortest HOT of
them, then the next ones, step by step, so every pair is met, by row and not in one group.

Null text counts as empty. Repeated rows each get their fingerprint; the next document of all but the
last of them is the text itself. A null id sorts first, rows of one id by the hash of the text. An empty
table gives an empty result, and other columns do not matter. Very long texts are read whole.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_hot, read_table, stash

CHAIN, SHARE, HOT = 3, 4, 64
#: Common function words of English, French, German and Spanish.
ANCHORS = tuple(
    "the of and to in is that with for on are as be was by or from a an it he this at not but his her they we you "
    "de la le les des et en un une du est que qui dans pour pas au ce il sur se par avec son sa "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei "
    "el los las del y por con para como más su al lo una".split()
)


def with_signatures(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """df with the sorted set of signature hashes of a text (array<long>, each below 2^32).

    One projection for each step, so that none is computed again inside another.
    """
    stop = list(dict.fromkeys(ANCHORS))
    low = F.lit(0xFFFFFFFF).cast("long")
    kept = df.columns
    out = df.withColumn("_words", F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    before = F.concat(F.array(F.lit("")), F.col("_words"))
    content = F.filter(F.zip_with(before, "_words", lambda a, w: F.struct(a.alias("a"), w.alias("w"))), lambda e: e["w"].isNotNull() & ~e["w"].isin(stop))
    out = out.select(*kept, "_words", content.alias("_e"))
    n = F.greatest(F.size("_e"), F.lit(1))
    two = F.zip_with("_e", F.slice("_e", 2, n), lambda x, y: F.struct(x["a"].alias("a"), x["w"].alias("w"), y["w"].alias("v")))
    chains = F.zip_with(two, F.slice("_e", 3, n), lambda x, y: F.when(y["w"].isNotNull(), F.struct(x["a"].isin(stop).alias("a"), F.xxhash64(x["a"], x["w"], x["v"], y["w"]).bitwiseAND(low).alias("h"))))
    out = out.select(*kept, "_words", chains.alias("_c"))
    out = out.select(*kept, "_words", F.filter("_c", lambda c: c.isNotNull()).alias("_c"))
    spots = F.transform(F.filter("_c", lambda c: c["a"] | (c["h"] % SHARE == 0)), lambda c: c["h"])
    least = F.array_min(F.transform("_c", lambda c: c["h"]))
    whole = F.when(F.size("_words") > 0, F.array(F.xxhash64(F.lit("*"), F.array_join("_words", " ")).bitwiseAND(low))).otherwise(F.expr("cast(array() as array<bigint>)"))
    chosen = F.when(F.size("_c") > 0, F.concat(spots, F.array(least))).otherwise(whole)
    return out.select(*kept, F.array_sort(F.array_distinct(chosen)).alias(name))


def hexed(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda h: F.lpad(F.hex(h), 8, "0")), "")


def jaccard(a: Column, b: Column) -> Column:
    """The likeness of two sets."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / F.greatest(union, F.lit(1))).cast("double")


def near_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", likeness: float = 0.8, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class_id) for every row, equal sets having one class, and (class_a, class_b, likeness) of near classes."""
    rows = with_signatures(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), "text", "sigs")
    rows = stash(rows.select("doc_id", "sigs"), "spot-sigs")
    member = rows.select("doc_id", F.xxhash64("sigs").alias("set_id"))
    sets = stash(rows.groupBy(F.xxhash64("sigs").alias("set_id")).agg(F.first("sigs").alias("sigs")).where(F.size("sigs") > 0), "spot-sets")
    each = sets.select("set_id", F.size("sigs").alias("n"), F.explode_outer("sigs").alias("sig"))
    df_of = each.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("set_id").orderBy("df", "sig")
    ranked = join_hot(each, df_of.withColumn("many", F.col("df")), ["sig"], "many").withColumn("rank", F.row_number().over(order))
    ranked = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.round(F.col("n") * likeness, 9)) + 1)
    part = F.floor(F.round(F.log(F.col("n")) / -math.log(likeness), 9)).cast("int")  # lengths within t of each other are at most one part away
    ranked = stash(ranked.select("set_id", "sig", "n", part.alias("part")), "spot-prefixes")
    # both parts a set may meet others in: its own, and that of the next shorter sets
    homes = ranked.select("sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("at"), "part", F.struct("n", "set_id").alias("one"))
    sized = homes.groupBy("sig", "at").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    homes = stash(homes.join(sized, ["sig", "at"]), "spot-homes")
    length = F.least("one.n", "other.n") >= F.round(F.greatest("one.n", "other.n") * likeness, 9)
    found, used = [], None
    while True:  # the next `hot` sets of each signature, shortest first; all others of it meet them
        left = homes if used is None else homes.join(used, ["sig", "at"]).where("one > last").drop("last")
        place = F.row_number().over(Window.partitionBy("sig", "at").orderBy("one"))
        some = stash(left.withColumn("place", place).where(F.col("place") <= hot).select("sig", "at", F.col("part").alias("other_part"), F.col("one").alias("other")), "spot-some")
        if not some.take(1):
            break
        pairs = left.join(some, ["sig", "at"]).where(F.col("other") < F.col("one")).where(length & ((F.col("part") == F.col("at")) | (F.col("other_part") == F.col("at"))))
        found.append(stash(pairs.select(F.least("one.set_id", "other.set_id").alias("a"), F.greatest("one.set_id", "other.set_id").alias("b")).distinct(), "spot-pairs"))
        used = some.groupBy("sig", "at").agg(F.max("other").alias("last"))
        hot *= 4
    pairs = functools.reduce(DataFrame.union, found).distinct() if found else sets.select(F.col("set_id").alias("a"), F.col("set_id").alias("b")).limit(0)
    both = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("sigs").alias("sa")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("sigs").alias("sb")), "b")
    near = both.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), jaccard(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= likeness)
    return member.withColumnRenamed("set_id", "class_id"), near


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, sigs of every row with next_text and next_sigs of the next by ascending id (after the last: the first).

    Ids are put in order without their texts; the driver sees the first key of each partition of that order. Texts then
    move once, straight to their part; the first row of a part is also sent to the part before.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.struct(F.col(id_col).isNotNull().alias("has"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("th")).alias("at"), F.col(id_col).alias("doc_id"), text.alias("text"))
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that small keys are not put together
    slim = rows.select("at").repartitionByRange(n_parts, "at").withColumn("part", F.spark_partition_id())
    firsts = sorted(r["low"] for r in slim.groupBy("part").agg(F.min("at").alias("low")).collect())  # one for each partition
    if not firsts:
        return with_signatures(with_signatures(rows.select("doc_id", "text", F.lit("").alias("next_text")), "text", "sigs"), "next_text", "next_sigs").select("doc_id", "text", "sigs", "next_text", "next_sigs")
    bounds = F.array(*(F.struct(F.lit(a.has).alias("has"), F.lit(a.id).cast("long").alias("id"), F.lit(a.th).cast("long").alias("th")) for a in firsts))
    part = F.size(F.filter(bounds, lambda b: b <= F.col("at"))) - 1
    sent = rows.withColumn("part", part)
    before = F.when(F.array_contains(bounds, F.col("at")), (F.col("part") + len(firsts) - 1) % len(firsts))
    runs = F.filter(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost")), F.struct(before.alias("part"), F.lit(True).alias("ghost"))), lambda x: x["part"].isNotNull())
    sent = sent.select("at", "doc_id", "text", F.explode(runs).alias("run")).select("at", "doc_id", "text", "run.part", "run.ghost")
    sent = with_signatures(sent.repartition(F.col("part")), "text", "sigs")
    w = Window.partitionBy("part").orderBy("ghost", "at")
    out = sent.withColumn("next_text", F.lead("text").over(w)).withColumn("next_sigs", F.lead("sigs").over(w))
    return out.where("not ghost").select("doc_id", "text", "sigs", "next_text", "next_sigs")


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last quarter of code points replaced by the start of the next."""
    n = F.char_length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(next_text, F.lit(1), cut))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(read_table(spark, sf_dir, "documents")).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "edited", "sigs", "next_sigs")
    rows = with_signatures(rows, "edited", "edited_sigs")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), hexed(F.col("sigs")).alias("fingerprint"), hexed(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
