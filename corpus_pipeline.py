"""A corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, SentencePiece ids.

Each stage is (spark, docs, sf_dir) -> DataFrame, written as Parquet and read again for the next.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, linededup, sentencepiece, simhash, toxicity
from tessera.llm.common import drop_stash, read_table, stash
from tessera.llm.unigram import model_bytes


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5, by a model fitted to a bounded sample of their own labels.

    Null and empty texts have the score of a text without words, and stay unless most labels are toxic. Repeated rows
    stay or go together; null ids train nothing. An empty table gives an empty one. All columns stay.
    """
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(model) < 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier in the corpus; documents left with none go.

    Null and blank texts stay as they are, rows with equal id and text lose the same lines, null ids come last. `n_chars`,
    where there is one, is that of the new text; other columns stay. An empty table gives an empty one.
    """
    out = linededup.dedup(docs, drop_empty=True, least=1)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: five-word shingles, Jaccard 0.8 or more.

    SimHash fingerprints and Golay keys link first; an exact prefix join finds the copies too many bits apart for them.

    Texts without words are one group. Of repeated rows one stays; of one id with several texts each is its own document.
    Null ids stay only where all of a group are null. All columns stay. An empty table gives an empty one.
    """
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null and empty texts, null ids and tables without rows have no leaks; repeated rows go together. All columns stay.
    """
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def to_piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip: the ids and whether they decode to the text. Other columns are not carried on.

    Null and empty texts have no ids; repeated rows and null ids have a row each; an empty table gives an empty one.
    """
    out = sentencepiece.encode(docs, model_bytes(), check=True)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("toxicity", keep_civil),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_each),
    ("decontamination", drop_benchmark_leaks),
    ("sentencepiece", to_piece_ids),
]
#: Trained weights and edit distances can't be told in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table of documents."""
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_stash(before)
        before = docs
    return docs
