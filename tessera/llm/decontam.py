"""Benchmark decontamination: spaced-seed hashing, DataFrame functions only.

Words are runs of letters and digits in lower case. A mask names the token offsets that count; the
hash of those words at every position of test items and training texts is joined, so a hit survives
substitutions at the offsets a mask skips. Every run of seven words or more at similarity 0.8 has a hit
of MASKS: with four equal words in a row nowhere, it has three substitutions at most, and then three
equal words stand beside two. Items of five or six words, if there are any, need SHORT_MASKS too.

A hit fixes a diagonal (place in the text less place in the item). A run along it is a leak at similarity
0.8 or more if it spans MIN_WORDS words, or all of a shorter item. Reported is the run with the largest
sum of 100 for an equal word and -399 for another, or, if that one is no leak, the longest at 0.8.

Null and empty texts and items have no words and no leaks; items of fewer words than the longest
mask reaches are compared by the one word sequence they have, exactly. Repeated rows (same id) are
one document: a leak in any of them is a leak. Null ids join nothing and are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stash

MASKS = ((0, 1, 2, 3), (0, 1, 2, 4, 5))
SHORT_MASKS = ((0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
MIN_WORDS, EQUAL, PENALTY, LIKENESS = 13, 100, 399, 0.8
#: Rows of test hashes (24 bytes each) up to which they are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _gram(hashes: Column, offsets: Sequence[int], *more: int) -> Callable[[Column], Column]:
    return lambda i: F.xxhash64(*map(F.lit, more), *(F.get(hashes, i + k) for k in offsets))


def seeds(hashes: Column, masks: Sequence[Sequence[int]] = MASKS) -> Column:
    """The hashes of all masks at all positions, mask after mask; see seeded."""
    each = []
    for m, mask in enumerate(masks):
        last = F.size(hashes) - mask[-1] - 1
        at = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), _gram(hashes, mask, m))
        each.append(F.when(last >= 0, at).otherwise(F.expr("cast(array() as array<bigint>)")))
    return F.concat(*each)


def seeded(df: DataFrame, id_name: str, place: str, masks: Sequence[Sequence[int]] = MASKS) -> DataFrame:
    """id, seed, place of every masked position, from df(id, hashes).

    The outer form of explode, as the filter that Spark infers for the other would compute the hashes twice.
    """
    rows = df.select(id_name, F.size("hashes").alias("_n"), seeds(F.col("hashes"), masks).alias("_seeds")).select(id_name, "_n", F.posexplode_outer("_seeds").alias("_at", "seed")).where("seed is not null")
    at, before = F.col("_at"), F.lit(0)
    for mask in masks[:-1]:
        before = before + F.greatest(F.col("_n") - mask[-1], F.lit(0))
        at = F.when(F.col("_at") >= before, F.col("_at") - before).otherwise(at)
    return rows.select(id_name, "seed", at.alias(place))


def best_run(item: Column, words: Column, diagonal: Column) -> Column:
    """struct(score, start, stop): the best run along a diagonal, counted from its first common place."""
    from_item, from_doc = F.greatest(-diagonal, F.lit(0)), F.greatest(diagonal, F.lit(0))
    n = F.least(F.size(item) - from_item, F.size(words) - from_doc)
    same = F.zip_with(F.slice(item, from_item + 1, n), F.slice(words, from_doc + 1, n), lambda a, b: F.when(a == b, EQUAL).otherwise(-PENALTY))
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("since"), F.lit(0).alias("at"), F.lit(0).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("stop"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["run"] > 0, acc["run"] + x).otherwise(x)
        since = F.when(acc["run"] > 0, acc["since"]).otherwise(acc["at"])
        better = run > acc["score"]
        return F.struct(
            run.alias("run"), since.alias("since"), (acc["at"] + 1).alias("at"), F.when(better, run).otherwise(acc["score"]).alias("score"),
            F.when(better, since).otherwise(acc["start"]).alias("start"), F.when(better, acc["at"] + 1).otherwise(acc["stop"]).alias("stop"),
        )

    return F.aggregate(same, start, step)


def longest_run(item: Column, words: Column, diagonal: Column) -> Column:
    """struct(score, start, stop): the longest run along a diagonal with four equal words or more for each other one; score as in best_run.

    With sums of 1 and -4 from the left, it is the widest pair of places with no fall between: one walk over the least
    sums up to a place and the greatest from a place on.
    """
    from_item, from_doc = F.greatest(-diagonal, F.lit(0)), F.greatest(diagonal, F.lit(0))
    n = F.least(F.size(item) - from_item, F.size(words) - from_doc)
    same = F.zip_with(F.slice(item, from_item + 1, n), F.slice(words, from_doc + 1, n), lambda a, b: F.when(a == b, 1).otherwise(-4))
    none = F.array(F.lit(0))
    sums = F.aggregate(same, none, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def walk(s: Column) -> Column:
        low = F.aggregate(F.slice(s, 2, F.size(s)), none, lambda acc, x: F.concat(acc, F.array(F.least(F.element_at(acc, -1), x))))
        back = F.reverse(s)
        high = F.reverse(F.aggregate(F.slice(back, 2, F.size(s)), F.slice(back, 1, 1), lambda acc, x: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), x)))))
        return F.struct(s.alias("s"), low.alias("low"), high.alias("high"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("start"), F.lit(0).alias("stop"))

    def widest(w: Column) -> Column:
        def step(acc: Column, _: Column) -> Column:
            fits = F.get(w["low"], acc["i"]) <= F.get(w["high"], acc["j"])  # null beyond the end
            better = fits & (acc["j"] - acc["i"] > acc["stop"] - acc["start"])
            return F.struct(
                F.when(~fits, acc["i"] + 1).otherwise(acc["i"]).alias("i"), F.when(fits, acc["j"] + 1).otherwise(acc["j"]).alias("j"),
                F.when(better, acc["i"]).otherwise(acc["start"]).alias("start"), F.when(better, acc["j"]).otherwise(acc["stop"]).alias("stop"),
            )

        def result(acc: Column) -> Column:
            gained, length = F.get(w["s"], acc["stop"]) - F.get(w["s"], acc["start"]), acc["stop"] - acc["start"]
            equal = ((gained + 4 * length) / 5).cast("int")
            return F.struct((equal * (EQUAL + PENALTY) - PENALTY * length).alias("score"), acc["start"].alias("start"), acc["stop"].alias("stop"))

        return F.aggregate(F.sequence(F.lit(0), 2 * F.size(w["s"])), start, step, result)

    # transform over one element: what stands in it is computed once
    return F.get(F.transform(F.transform(F.array(sums), walk), widest), F.lit(0))


def leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, n_words, n_equal, similarity: the best leak of each pair (places count words)."""
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), word_hashes(F.col(text_col)).alias("hashes"))
    tests = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), word_hashes(F.col(item_text)).alias("hashes")).where(F.size("hashes") > 0)
    tests = stash(tests, "test-items")
    reach = min(m[-1] for m in MASKS)
    masks = MASKS + (SHORT_MASKS if tests.where(F.size("hashes").isin(5, 6)).take(1) else ())
    keys = stash(seeded(tests, "item_id", "j", masks), "test-seeds")
    keyed = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    hits = seeded(docs, "doc_id", "i", masks).join(keyed, "seed").select("doc_id", "item_id", (F.col("i") - F.col("j")).cast("int").alias("diagonal")).distinct()

    short = tests.where(F.size("hashes") <= reach).select("item_id", F.col("hashes"), F.size("hashes").alias("k"))
    sizes = sorted(r["k"] for r in short.select("k").distinct().collect())  # at most five lengths
    for k in sizes:
        grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size("hashes") - k, F.lit(0))), _gram(F.col("hashes"), range(k)))
        own = short.where(F.col("k") == k).select("item_id", F.xxhash64(*(F.get(F.col("hashes"), F.lit(o)) for o in range(k))).alias("seed"))
        there = docs.where(F.size("hashes") >= k).select("doc_id", grams.alias("_g")).select("doc_id", F.posexplode_outer("_g").alias("diagonal", "seed")).where("seed is not null")
        hits = hits.union(there.join(own, "seed").select("doc_id", "item_id", F.col("diagonal").cast("int")).distinct())

    hits = stash(hits, "seed-hits")
    texts = docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    ends = F.col("item_hashes"), F.col("hashes"), F.col("diagonal")
    need = F.least(F.lit(min_words), F.col("item_words"))

    def is_leak(run: str) -> Column:
        n = F.col(f"{run}.stop") - F.col(f"{run}.start")
        return (n >= need) & (F.round((F.col(f"{run}.score") + PENALTY * n) / (PENALTY + EQUAL)) >= LIKENESS * n)

    rows = hits.join(tests.withColumnRenamed("hashes", "item_hashes"), "item_id").join(texts, "doc_id")
    rows = rows.select("doc_id", "item_id", "diagonal", F.size("item_hashes").alias("item_words"), "item_hashes", "hashes", best_run(*ends).alias("best"))
    rows = stash(rows.select("doc_id", "item_id", "diagonal", "item_words", F.when(is_leak("best"), F.struct("best.score", "best.start", "best.stop")).otherwise(longest_run(*ends)).alias("run")), "runs")
    n = F.col("run.stop") - F.col("run.start")
    equal = (F.col("run.score") + PENALTY * n) / (PENALTY + EQUAL)
    found = rows.select(
        "doc_id", "item_id", (F.greatest("diagonal", F.lit(0)) + F.col("run.start")).alias("doc_start"), (F.greatest(-F.col("diagonal"), F.lit(0)) + F.col("run.start")).alias("item_start"),
        n.alias("n_words"), F.round(equal).cast("int").alias("n_equal"), "item_words",
    ).where((F.col("n_words") >= F.least(F.lit(min_words), F.col("item_words"))) & (F.col("n_equal") >= LIKENESS * F.col("n_words")))
    best = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("doc_start", "item_start", "n_words", "n_equal"), F.struct("n_equal", -F.col("n_words"), -F.col("doc_start"), -F.col("item_start"))).alias("b"))
    return best.select("doc_id", "item_id", "b.*", (F.col("b.n_equal") / F.col("b.n_words")).alias("similarity"))


def clean(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows of documents that hold a leak."""
    bad = stash(leaks(df, items, id_col, text_col).select(F.col("doc_id").alias("_bad")).distinct(), "leaking")
    return df.join(bad, df[id_col] == bad["_bad"], "left_anti")


def op1_spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
