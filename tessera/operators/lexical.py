"""Inverted, term-frequency, TF-IDF and BM25 indexes as postings rows, and the searches over them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import tokens as G

K1, B = 1.5, 0.75
#: Tasks by token for each part of the files of documents.
TASKS = 8


def dealt(docs: DataFrame) -> DataFrame:
    """docs over at least as many tasks as there are cores; moves rows only where the files give fewer."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def tokenized(docs: DataFrame, doc: str = "doc_id", text: str = "text", keep_stopwords: bool = False, composed: bool = False) -> DataFrame:
    """doc, tokens: one row per document. `composed`: the texts are known to be in NFC."""
    content = F.col(text) if composed else T.nfc(F.col(text))
    lex = docs.select(F.col(doc).alias("doc"), T.lexemes(content).alias("lex"))
    return lex.select("doc", T.tokens_of(F.col("lex"), keep_stopwords=keep_stopwords).alias("tokens"))


def postings(tokens: DataFrame) -> DataFrame:
    """token, doc, tf."""
    return tokens.select("doc", F.explode_outer("tokens").alias("token")).where("token is not null").groupBy("token", "doc").agg(F.count(F.lit(1)).alias("tf"))


def doc_stats(tokens: DataFrame) -> DataFrame:
    """doc, length; documents without tokens stay, with length 0."""
    return tokens.select("doc", F.size("tokens").cast("long").alias("length"))


def unique(docs: DataFrame, doc: str = "doc_id") -> bool:
    """Whether no two rows have the same id; reads the ids only."""
    return docs.groupBy(doc).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() == 0


def counted(docs: DataFrame, doc: str = "doc_id", text: str = "text", composed: bool = False) -> DataFrame:
    """token, doc, tf of a corpus, without a shuffle unless ids repeat (their rows are added up)."""
    rows = G.counts(dealt(docs.select(doc, text)), doc, text, composed).select("token", "doc", "tf")
    return rows if unique(docs, doc) else rows.groupBy("token", "doc").agg(F.sum("tf").alias("tf"))


def inverted_index(post: DataFrame, block: int = 1_000_000) -> DataFrame:
    """token, block, docs: the sorted documents of each token, by blocks of `block` ids, so that no array outgrows one."""
    return post.groupBy("token", F.expr(f"doc div {block}").alias("block")).agg(F.sort_array(F.collect_list("doc")).alias("docs"))


def inverted_of(docs: DataFrame, doc: str = "doc_id", text: str = "text", block: int = 1_000_000, composed: bool = False) -> DataFrame:
    """inverted_index of a corpus: lists of neighbouring documents are made where the texts are, and only these move."""
    rows = G.inverted(dealt(docs.where(F.col(doc).isNotNull()).select(doc, text)), block, doc, text, composed)
    known = G.merged(by_token(rows, docs).sortWithinPartitions("token", "block"))
    nameless = G.distinct(docs.where(F.col(doc).isNull()).select(doc, text), doc, text, composed).distinct()  # their tokens have no block and no list
    return known.union(nameless.select("token", *(F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("block", "docs"))))


def tfidf_index(post: DataFrame, n_docs: DataFrame) -> DataFrame:
    """token, doc, weight = tf ln((N + 1) / (1 + df)). Pass post through by_token where it is large."""
    return _with_df(post).crossJoin(F.broadcast(n_docs)).select("token", "doc", (F.col("tf") * F.log((F.col("n") + 1) / (F.col("df") + 1))).alias("weight"))


def by_token(post: DataFrame, docs: DataFrame) -> DataFrame:
    """post dealt out by token, over so many tasks that one's tokens fit in memory: in proportion to the files of docs."""
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return post.where("token is not null").repartition(max(shuffles, TASKS * docs.rdd.getNumPartitions()), "token")


def _figures(rows: DataFrame, *by: str, **figures: Column) -> DataFrame:
    """Figures of rows by some columns, and `most`, a hash's maximum: whoever compares it reads every column of the rows. So nothing is pruned,
    and figures and rows are read from one shuffle."""
    return rows.groupBy(*by).agg(*(f.alias(n) for n, f in figures.items()), F.max(F.xxhash64(*rows.columns)).alias("most"))


def _with_df(post: DataFrame) -> DataFrame:
    """post, dealt out by token, with df, the number of rows of its token: rows move once and are not sorted."""
    df = _figures(post, "token", df=F.count(F.lit(1))).withColumnRenamed("token", "of").hint("shuffle_hash")
    always = F.xxhash64(*post.columns) <= F.col("most")  # see _figures
    return post.join(df, (F.col("token") == F.col("of")) & always).drop("of", "most")


def _bm25_weights(rows: DataFrame, corpus: DataFrame, k1: float, b: float) -> DataFrame:
    """token, doc, weight of rows(token, doc, tf, df, length); corpus: one row of n and mean."""
    _check(k1, b)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.when(F.col("mean") > 0, 1 - b + b * F.col("length") / F.col("mean")).otherwise(1.0)
    both = rows.crossJoin(F.broadcast(corpus))
    return both.select("token", "doc", (idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * norm)).alias("weight"))


def bm25_index(post: DataFrame, stats: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """token, doc, weight."""
    corpus = stats.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean"))
    return _bm25_weights(_with_df(post).join(stats, "doc"), corpus, k1, b)


def bm25_of(docs: DataFrame, doc: str = "doc_id", text: str = "text", k1: float = K1, b: float = B, composed: bool = False) -> DataFrame:
    """bm25_index of a corpus. Lengths ride along with the postings, and the mean is that of their counts: texts are read once unless ids repeat."""
    rows = dealt(docs.select(doc, text))
    if not unique(docs, doc):
        return bm25_index(counted(docs, doc, text, composed), G.lengths(rows, doc, text, composed), k1, b)
    post = by_token(G.counts(rows, doc, text, composed), docs)
    corpus = docs.agg(F.count(F.lit(1)).alias("n")).crossJoin(_figures(post, sum=F.sum("tf")).where("most is not null")).select("n", (F.col("sum") / F.col("n")).alias("mean"))
    rows = _bm25_weights(_with_df(post), corpus, k1, b)
    return rows.withColumn("weight", F.when(F.col("doc").isNotNull(), F.col("weight"))).where("weight is not null")  # said so, it stays above the shuffle


def query_tokens(query: str, keep_stopwords: bool) -> list[str]:
    """The distinct tokens of a query, in order."""
    lex = SparkSession.getActiveSession().createDataFrame([(unicodedata.normalize("NFC", query),)], "q string").select(T.lexemes(F.col("q")).alias("lex"))
    return lex.select(F.array_distinct(T.tokens_of(F.col("lex"), keep_stopwords=keep_stopwords)).alias("t")).first().t


class Matches:
    """What one query needs of a corpus: each document's length and its count of every query token, from one scan.

    The rows are slim and kept (lost ones are computed again), so corpus figures and scores share one tokenization;
    no posting of another token is made, and nothing is shuffled but one row of figures.
    """

    def __init__(self, rows: DataFrame, query: list[str]) -> None:
        """rows: doc, length, tf (an array by query token)."""
        self.rows = rows.persist()
        self.query = query

    def _scored(self, term) -> DataFrame:
        """doc, score over documents with a query token; term(tf, df, n, mean, length) is one token's share."""
        figures = self.rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean"), F.array(*(F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(len(self.query)))).alias("df") if self.query else F.expr("cast(array() as array<bigint>)").alias("df"))
        both = self.rows.where(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(figures))  # one row
        shares = F.zip_with("tf", "df", lambda tf, df: F.when(tf > 0, term(tf, df, F.col("n"), F.col("mean"), F.col("length"))).otherwise(0.0))
        return both.select("doc", F.aggregate(shares, F.lit(0.0), lambda a, x: a + x).alias("score"))

    def documents(self) -> DataFrame:
        return self.rows.where(F.exists("tf", lambda x: x > 0)).select("doc")

    def tf(self) -> DataFrame:
        return self._scored(lambda tf, df, n, mean, length: tf.cast("double"))

    def tfidf(self) -> DataFrame:
        return self._scored(lambda tf, df, n, mean, length: tf * F.log((n + 1) / (df + 1)))

    def bm25(self, k1: float = K1, b: float = B) -> DataFrame:
        _check(k1, b)
        return self._scored(lambda tf, df, n, mean, length: F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * F.when(mean > 0, 1 - b + b * length / mean).otherwise(1.0)))


def _check(k1: float, b: float) -> None:
    if k1 < 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be >= 0 and b within [0, 1]")


def matches(docs: DataFrame, query: str, doc: str = "doc_id", text: str = "text", keep_stopwords: bool = False, composed: bool = False) -> Matches:
    """The documents' matches with a query; keep_stopwords is about the query, documents always lose theirs."""
    wanted = query_tokens(query, keep_stopwords)
    return Matches(G.query_counts(dealt(docs.select(doc, text)), wanted, doc, text, composed), wanted)


def ranked(weights: DataFrame, query: str, weight: str, keep_stopwords: bool) -> DataFrame:
    """doc, score from an index of weights: the sum over distinct query tokens."""
    hits = weights.where(F.col("token").isin(query_tokens(query, keep_stopwords)))
    return hits.groupBy("doc").agg(F.sum(weight).alias("score"))


def top(scores: DataFrame, k: int, name: str = "doc") -> DataFrame:
    return scores.orderBy(F.round("score", 9).desc(), name).limit(k)


def basic_search(docs: DataFrame, query: str, doc: str = "doc_id", text: str = "text", composed: bool = False) -> DataFrame:
    """Documents that share a token with the query; stopwords count here."""
    rows = G.query_counts(dealt(docs.select(doc, text)), query_tokens(query, True), doc, text, composed, stopwords=True)
    return rows.where(F.exists("tf", lambda x: x > 0)).select("doc")


def with_ranks(scores: DataFrame, name: str, parts: int = 64) -> DataFrame:
    """doc and its rank from 1 by falling score, then doc, in all of (doc, score).

    Rows are dealt out by about even bounds of the score, so that no task gets all of them; the ranks are exact for any bounds.
    """
    rows = scores.select("doc", F.round("score", 9).alias("score")).cache()
    bounds = sorted(set(rows.approxQuantile("score", [i / parts for i in range(1, parts)], 0.005)))
    part = sum((F.when(F.col("score") < b, 1).otherwise(0) for b in bounds), F.lit(0))
    dealt = rows.withColumn("part", part)
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per part
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("score"), "doc"))
    return dealt.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select("doc", (F.col("before") + own).cast("int").alias(name))


def fuse(bm25: DataFrame, semantic: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (doc, score) with (doc, score); ranks from 1 in each list."""
    lists = [with_ranks(d, n) for d, n in ((bm25, "bm25_rank"), (semantic, "semantic_rank"))]
    part = [F.coalesce(1.0 / (k + F.col(n)), F.lit(0.0)) for n in ("bm25_rank", "semantic_rank")]
    return lists[0].join(lists[1], "doc", "full_outer").select("doc", "bm25_rank", "semantic_rank", (part[0] + part[1]).alias("score"))
