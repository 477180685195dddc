"""After the indexes: best chunks, fusion, reranking, context and evaluation of rankings, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

METRICS = ("recall_at_5", "recall_at_10", "reciprocal_rank")


def best_chunks(hits: DataFrame, by: str = "doc") -> DataFrame:
    """The first of hits(doc, chunk_id, score, rank, ...) of each document in rank order, with consecutive `doc_rank`s."""
    first = hits.groupBy(by).agg(F.min_by(F.struct(*[c for c in hits.columns if c != by]), "rank").alias("h")).select(by, "h.*")
    return first.withColumn("doc_rank", F.row_number().over(Window.orderBy("rank")))  # a candidate list, cut by its search


def fuse_chunks(bm25: DataFrame, semantic: DataFrame, k: float = 60) -> DataFrame:
    """Rank fusion of bm25(doc, score, bm25_rank) with best chunks (doc, chunk_id, text, score, doc_rank): every field of both."""
    if isinstance(k, bool) or not 0 <= k < float("inf"):
        raise ValueError("k must be a finite number of at least 0")
    a = bm25.select("doc", F.col("score").alias("bm25_score"), "bm25_rank")
    b = semantic.select("doc", "chunk_id", "text", F.col("score").alias("semantic_score"), F.col("doc_rank").alias("semantic_rank"))
    share = [F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0)) for r in ("bm25_rank", "semantic_rank")]
    return a.join(b, "doc", "full_outer").withColumn("rrf_score", share[0] + share[1])


def overlap_scorer(query: list[str]) -> Callable[[Column], Column]:
    """A reranking score without a model: the share of the query's words that a text holds. Any Column function or Pandas UDF may stand in."""
    words = list(dict.fromkeys(w.lower() for w in query))
    return lambda text: sum((F.lower(text).contains(w).cast("double") for w in words), F.lit(0.0)) / max(1, len(words))


def rerank(candidates: DataFrame, scorer: Callable[[Column], Column], candidate_k: int = 20, top_k: int = 5, order: tuple[Column, ...] = (), text: str = "text") -> DataFrame:
    """The first candidate_k rows by `order`, scored and cut to top_k; ties keep their place. A candidate without text is an error."""
    for k in (candidate_k, top_k):
        if isinstance(k, bool) or not isinstance(k, int) or k <= 0:
            raise ValueError("candidate_k and top_k must be positive integers")
    first = candidates.orderBy(*order).limit(candidate_k).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # candidate_k rows
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    checked = first.withColumn(text, F.when(blank, F.raise_error(F.lit("missing candidate text"))).otherwise(F.col(text)))
    return checked.withColumn("reranker_score", scorer(F.col(text))).orderBy(F.desc("reranker_score"), "place").limit(top_k)


def context(results: DataFrame, top_k: int = 5, one_per_document: bool = True) -> DataFrame:
    """source_id and the rows of results(rank, doc, chunk_id, url, text) that a prompt gets.

    Walks the ranked rows once: a row without text, with a text or chunk already taken, or (one_per_document) of a document
    or URL already taken is passed over. `results` is a candidate list of one query, so the walk is one small fold.
    """
    if type(top_k) is not int or top_k <= 0:
        raise ValueError("top_k must be a positive integer")
    rows = results.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    # the walk needs keys and hashes only; texts join at the end
    slim = rows.select("rank", F.col("doc").cast("string").alias("d"), F.col("chunk_id").cast("string").alias("c"), F.nullif(F.trim("url"), F.lit("")).alias("u"), F.sha2("text", 256).alias("t"))
    listed = slim.agg(F.array_sort(F.collect_list(F.struct("rank", "d", "c", "u", "t"))).alias("all"))
    item = "struct<rank:int,d:string,c:string,u:string,t:string>"

    def clash(a: Column, b: Column) -> Column:
        same = (a["t"] == b["t"]) | F.coalesce((a["d"] == b["d"]) & (a["c"] == b["c"]), F.lit(False))
        return same | (a["d"] == b["d"]) | F.coalesce(a["u"] == b["u"], F.lit(False)) if one_per_document else same

    def step(acc: Column, x: Column) -> Column:
        free = (F.size(acc) < top_k) & ~F.exists(acc, lambda y: clash(x, y))
        return F.when(free, F.concat(acc, F.array(x))).otherwise(acc)

    listed = listed.select(F.col("all").cast(f"array<{item}>").alias("all"))
    taken = listed.select(F.posexplode(F.aggregate("all", F.expr(f"cast(array() as array<{item}>)"), step)).alias("pos", "x"))
    return rows.join(F.broadcast(taken.select((F.col("pos") + 1).alias("source_id"), F.col("x.rank").alias("rank"))), "rank")  # top_k rows


def rendered(chosen: DataFrame) -> DataFrame:
    """source_id, excerpt: the text of each source as a prompt shows it."""

    def line(name: str, value: Column, none: str = "Unavailable") -> Column:
        return F.concat(F.lit(f"{name}: "), F.coalesce(T.one_line(value.cast("string")), F.lit(none)), F.lit("\n"))

    head = F.concat(F.lit("[Source "), F.col("source_id").cast("string"), F.lit("]\n"), line("Document", F.col("doc")), line("URL", F.col("url")), line("Chunk ID", F.col("chunk_id"), "Unavailable (document-level result)"), line("Retrieval rank", F.col("rank")))
    return chosen.select("source_id", F.concat(head, F.lit("Content:\n"), F.col("text")).alias("excerpt"))


def retrieval_metrics(rankings: DataFrame, relevant: DataFrame) -> DataFrame:
    """query_id, system, recall_at_5, recall_at_10, reciprocal_rank.

    rankings(query_id, system, doc, rank) may repeat documents: the first counts and ranks close up. relevant(query_id, doc)
    gives the judged documents; a system that returned nothing for a judged query has zeros.
    """
    first = rankings.groupBy("query_id", "system", "doc").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("query_id", "system").orderBy("rank", "doc"))
    judged = relevant.select("query_id", "doc").distinct()
    wanted = judged.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hits = first.withColumn("place", place).join(judged, ["query_id", "doc"])
    found = hits.groupBy("query_id", "system").agg(F.count_if(F.col("place") <= 5).alias("a"), F.count_if(F.col("place") <= 10).alias("b"), F.min("place").alias("p"))
    every = wanted.crossJoin(F.broadcast(rankings.select("system").distinct()))  # a handful of systems
    rows = every.join(found, ["query_id", "system"], "left")
    return rows.select("query_id", "system", (F.coalesce("a", F.lit(0)) / F.col("n")).alias(METRICS[0]), (F.coalesce("b", F.lit(0)) / F.col("n")).alias(METRICS[1]), F.coalesce(1 / F.col("p"), F.lit(0.0)).alias(METRICS[2]))


def macro_average(metrics: DataFrame, *by: str) -> DataFrame:
    return metrics.groupBy(*by).agg(*(F.avg(m).alias(m) for m in METRICS), F.count(F.lit(1)).alias("n_queries"))


def change_class(before: DataFrame, after: DataFrame) -> DataFrame:
    """query_id, category, ranking_changed and metric deltas of (query_id, metrics, ranking array) in two runs."""
    a, b = before.alias("a"), after.alias("b")
    both = a.join(b, F.col("a.query_id") == F.col("b.query_id"))
    deltas = [(F.col(f"b.{m}") - F.col(f"a.{m}")).alias(f"{m}_delta") for m in METRICS]
    rows = both.select(F.col("a.query_id").alias("query_id"), (F.col("a.ranking") != F.col("b.ranking")).alias("ranking_changed"), *deltas)
    up, down = (F.greatest(*(F.col(f"{m}_delta") for m in METRICS)) > 0), (F.least(*(F.col(f"{m}_delta") for m in METRICS)) < 0)
    category = F.when(up & down, "mixed").when(up, "improved").when(down, "decreased").when(F.col("ranking_changed"), "changed_without_metric_gain").otherwise("unchanged")
    return rows.withColumn("category", category)
