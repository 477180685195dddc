"""A crawl frontier as a table: discovery merge, next URLs, retry, statistics, and scope replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import urls as U

STATUSES = ("discovered", "queued", "crawling", "crawled", "failed", "skipped", "rejected")
FLAGS = ("eligible", "fetched", "extracted", "accepted", "indexed")
SCHEMA = (
    "normalized_url string, url string, domain string, depth int, discovery_source string, status string, attempts int, error_type string, "
    "eligible int, fetched int, extracted int, accepted int, indexed int, chunk_count int, crawl_seconds double, index_seconds double, seq long"
)


def with_reject_reason(found: DataFrame, known: DataFrame, domains: Sequence[str], max_depth: int) -> DataFrame:
    """found(url, depth, seq, ...) with normalized_url, domain and reason, the first of: invalid, domain, duplicate, asset, depth; null: take it.

    A URL found twice in one batch is a duplicate after its first place (by seq).
    """
    rows = found.withColumn("normalized_url", U.normalize(F.col("url"))).withColumn("domain", U.domain_of(F.col("normalized_url")))
    seen = known.select("normalized_url").distinct().withColumn("seen", F.lit(True))
    rows = rows.join(seen, "normalized_url", "left")
    place = F.row_number().over(Window.partitionBy("normalized_url").orderBy("seq"))
    rows = rows.withColumn("place", place)
    reason = (
        F.when(F.col("normalized_url").isNull(), "invalid").when(~U.allowed(F.col("normalized_url"), domains), "domain")
        .when(F.coalesce("seen", F.lit(False)) | (F.col("place") > 1), "duplicate").when(~U.is_page(F.col("normalized_url")), "asset").when(F.col("depth") > max_depth, "depth")
    )
    return rows.withColumn("reason", reason).drop("seen", "place")


def add(known: DataFrame, found: DataFrame, domains: Sequence[str], max_depth: int) -> DataFrame:
    """The frontier after discovery: new URLs queued or skipped with their reason; known ones keep the least depth, and one skipped for depth queues once it is within."""
    judged = with_reject_reason(found, known, domains, max_depth)
    fresh = judged.where("normalized_url is not null and (reason is null or reason <> 'duplicate')")
    ok = F.col("reason").isNull()
    values = {"status": F.when(ok, "queued").otherwise("skipped"), "attempts": F.lit(0), "error_type": F.col("reason"), "eligible": ok.cast("int"), **{c: F.lit(0) for c in (*FLAGS[1:], "chunk_count")}, "crawl_seconds": F.lit(0.0), "index_seconds": F.lit(0.0)}
    fresh = fresh.withColumns(values)
    least = judged.where(F.col("reason") == "duplicate").groupBy("normalized_url").agg(F.min("depth").alias("again"))
    old = known.join(least, "normalized_url", "left")
    nearer = F.col("again") < F.col("depth")
    queues = nearer & (F.col("error_type") == "depth") & (F.col("again") <= max_depth)
    old = old.withColumns({"status": F.when(queues, "queued").otherwise(F.col("status")), "error_type": F.when(queues, None).otherwise(F.col("error_type")), "depth": F.when(nearer, F.col("again")).otherwise(F.col("depth"))}).drop("again")
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return old.select(*names).unionByName(fresh.select(*names))


def next_urls(frontier: DataFrame, max_depth: int, retry_only: bool = False) -> DataFrame:
    """The next queued row of each domain: most attempts, then least depth, then first come."""
    rows = frontier.where((F.col("status") == "queued") & (F.col("depth") <= max_depth))
    if retry_only:
        rows = rows.where("attempts > 0")
    rest = [c for c in frontier.columns if c != "domain"]
    return rows.groupBy("domain").agg(F.min_by(F.struct(*rest), F.struct(-F.col("attempts"), F.col("depth"), F.col("seq"))).alias("r")).select("domain", "r.*")


def recovered(frontier: DataFrame) -> DataFrame:
    """After a crash: fetches that were under way are queued again."""
    return frontier.withColumn("status", F.when(F.col("status") == "crawling", "queued").otherwise(F.col("status")))


def retried(frontier: DataFrame) -> DataFrame:
    """Failed rows, and those kept out by an unreachable robots file, are queued again."""
    again = (F.col("status") == "failed") | F.coalesce(F.col("error_type") == "robots_unavailable", F.lit(False))
    return frontier.withColumn("status", F.when(again, "queued").otherwise(F.col("status")))


def status_counts(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("domain", "status").agg(F.count(F.lit(1)).alias("n"))


def indexed_by_domain(frontier: DataFrame) -> DataFrame:
    return frontier.where("indexed = 1").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


TOTALS = {
    "discovered_urls": "count(*)", "eligible_urls": "sum(eligible)", "fetched_urls": "sum(fetched)", "extracted_pages": "sum(extracted)", "successful_pages": "sum(accepted)",
    "rejected_pages": "sum(CASE WHEN status = 'rejected' THEN 1 END)", "soft_404_pages": "sum(CASE WHEN error_type = 'soft_404' THEN 1 END)", "robots_blocked_urls": "sum(CASE WHEN error_type = 'robots' THEN 1 END)",
    "failed_urls": "sum(CASE WHEN status = 'failed' THEN 1 END)", "successfully_indexed_documents": "sum(indexed)", "chunks": "sum(chunk_count)", "page_attempts": "sum(attempts)",
    "crawl_seconds": "sum(crawl_seconds)", "index_seconds": "sum(index_seconds)",
}


def totals(frontier: DataFrame) -> DataFrame:
    """One row with 14 conditional totals; nothing to add up gives 0."""
    return frontier.agg(*(F.expr(f"coalesce({e}, 0)").alias(n) for n, e in TOTALS.items()))


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a batch added to each total, with seconds for each attempt and document (0 where there was none)."""
    a, b = (d.select(F.struct("*").alias(n)) for d, n in ((before, "a"), (after, "b")))
    rows = a.crossJoin(b).select(*((F.col(f"b.{n}") - F.col(f"a.{n}")).alias(n) for n in TOTALS))  # one row each
    return rows.select("*", F.when(F.col("page_attempts") > 0, F.col("crawl_seconds") / F.col("page_attempts")).otherwise(0.0).alias("seconds_per_attempt"), F.when(F.col("successfully_indexed_documents") > 0, F.col("index_seconds") / F.col("successfully_indexed_documents")).otherwise(0.0).alias("seconds_per_document"))


def count_events(counters: DataFrame, events: DataFrame) -> DataFrame:
    """counters(name, value) with events(name, amount) added."""
    return counters.select("name", "value").unionByName(events.select("name", F.col("amount").alias("value"))).groupBy("name").agg(F.sum("value").alias("value"))


def replace_scopes(store: DataFrame, batch: DataFrame, scope: str = "source") -> DataFrame:
    """The store with all rows of the batch's scopes replaced by the batch; of an id given twice in a scope, one row of its last generation stays."""
    scopes = batch.select(scope).distinct()
    rest = [c for c in batch.columns if c not in (scope, "id")]
    newest = batch.groupBy(scope, "id").agg(F.max_by(F.struct(*rest), "generation").alias("r")).select(scope, "id", "r.*")
    return store.join(scopes, scope, "left_anti").unionByName(newest.select(*store.columns))
