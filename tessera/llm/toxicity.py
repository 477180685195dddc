"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its features: the word itself and its character 3- and 4-grams
with boundary marks, hashed into BUCKETS. A document is the mean of its words. A softmax over two
classes reads it. A misspelling never seen shares most n-grams with the word it comes from.

The fit takes at most SAMPLE labelled ids of class 1 and three times as many of class 0, those with
the smallest hash of the id. Ids are chosen without their texts; the texts of the chosen are turned
into bags (at most BUCKETS pairs each) where they lie, and only the bags go to the one task of the
fit. Averages are scaled by SCALE, and the bias starts at the rarer class's small odds, so that only
words that tell toxic rows apart move far. Scoring takes every whole text: as mean and softmax are
linear up to the last step, a word adds one number, which workers remember for up to MEMO words.

Null and empty texts have no words and score as the bias alone. Without labelled rows of both
classes every score is the share of class 1 (0 if there are none). Repeated rows score alike; in the
fit an id counts once, with the text of least hash. Null ids train nothing. Very long texts are read
whole. Ties of the id's hash go to the smaller id.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold_memo, read_table, stash
from .labels import fold, training_ids

BUCKETS, DIM, SAMPLE, EPOCHS, BATCH, RATE, SCALE, BIAS, MEMO = 1 << 18, 4, 1500, 5, 64, 0.3, 100.0, -4.0, 500_000
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(word: str) -> list[int]:
    """Buckets of a word and its n-grams."""
    w = f"<{word}>".encode("utf-8", "surrogatepass")
    n = len(w)
    crc, mask = zlib.crc32, BUCKETS - 1
    return [crc(w) & mask, *[crc(w[i : i + 3]) & mask for i in range(n - 2)], *[crc(w[i : i + 4]) & mask for i in range(n - 3)]]


@dataclass
class Model:
    """weight: of each bucket on the margin of class 1; bias: the margin of an empty document."""

    weight: np.ndarray
    bias: float


def bag(text: str | None, known: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text, ascending, and the weight of each."""
    known = {} if known is None else known
    counts = Counter(words_of(text or ""))
    total = sum(counts.values()) or 1
    at, much = [], []
    for w, c in counts.items():
        if (f := known.get(w)) is None:
            f = known[w] = np.array(features(w), dtype=np.int32)
        at.append(f)
        much.append(np.full(len(f), c / len(f) / total, dtype=np.float32))
    if not at:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    ids, where = np.unique(np.concatenate(at), return_inverse=True)
    return ids.astype(np.int32), (SCALE * np.bincount(where, weights=np.concatenate(much))).astype(np.float32)


def fit(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    return fit_bags([bag(t) for t in texts], labels, seed)


def fit_bags(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Model:
    """Adagrad on the cross entropy of the softmax, embeddings and output together."""
    labels = np.asarray(labels, dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), 30.0 * (2 * share - 1))
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((BUCKETS, DIM)) * 0.01).astype(np.float32)
    out, bias = (rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32), np.array([-BIAS / 2, BIAS / 2], np.float32)
    g_emb, g_out, g_bias = np.full(BUCKETS, 1e-2, np.float32), np.full(out.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for lo in range(0, len(docs), BATCH):
            batch = order[lo : lo + BATCH]
            ids = np.concatenate([docs[i][0] for i in batch])
            amount = np.concatenate([docs[i][1] for i in batch])
            which = np.repeat(np.arange(len(batch)), [len(docs[i][0]) for i in batch])
            part = emb[ids] * amount[:, None]
            mean = np.stack([np.bincount(which, weights=part[:, d], minlength=len(batch)) for d in range(DIM)], axis=1).astype(np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1.0
            back = (p @ out.T)[which] * amount[:, None]
            step = np.stack([np.bincount(ids, weights=back[:, d], minlength=BUCKETS) for d in range(DIM)], axis=1).astype(np.float32)
            d_out, d_bias = mean.T @ p, p.sum(axis=0)
            g_emb += (step**2).mean(axis=1)
            g_out += d_out**2
            g_bias += d_bias**2
            emb -= RATE * step / np.sqrt(g_emb)[:, None]
            out -= 0.1 * d_out / np.sqrt(g_out)
            bias -= 0.3 * d_bias / np.sqrt(g_bias)
    margin = out[:, 1] - out[:, 0]
    return Model(emb @ margin * np.float32(SCALE), float(bias[1] - bias[0]))


def train(df: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """The model from a bounded sample of labelled rows; the fit runs on an executor."""
    ids = training_ids(df, labels, label, id_col)

    def first(part: DataFrame, n: int) -> DataFrame:
        return part.orderBy(F.xxhash64("id"), "id").limit(n)

    chosen = F.broadcast(stash(first(ids.where("label = 1"), sample).union(first(ids.where("label = 0"), 3 * sample)), "toxic-ids"))  # at most 4 * sample rows
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id").withColumn("th", F.xxhash64("text"))
    one = F.broadcast(slim.groupBy("id").agg(F.min("th").alias("th")))  # a row for each chosen id

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for b in batches:
            for i in range(b.num_rows):
                if len(known) > MEMO:
                    known.clear()
                at, much = bag(b.column(2)[i].as_py(), known)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([at.tobytes()], pa.binary()), pa.array([much.tobytes()], pa.binary())], names=["id", "label", "at", "much"])

    id_type = slim.schema["id"].dataType.simpleString()
    made = slim.join(one, ["id", "th"]).select("id", "label", "text").mapInArrow(bags, f"id {id_type}, label int, at binary, much binary").dropDuplicates(["id"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        docs = [(np.frombuffer(a, np.int32), np.frombuffer(m, np.float32)) for a, m in zip(pdf["at"], pdf["much"], strict=True)]
        model = fit_bags(docs, pdf["label"].to_numpy())
        return pd.DataFrame({"weight": [model.weight.astype(np.float32).tobytes()], "bias": [model.bias]})

    got = made.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "weight binary, bias double").collect()
    return Model(np.frombuffer(got[0]["weight"], np.float32), got[0]["bias"]) if got else fit([], np.zeros(0))


_memo: dict[bytes, tuple[dict[str, float], list[float]]] = {}


def score_texts(model: Model, texts: Iterator[str | None]) -> list[float]:
    hold_memo("toxicity", _memo.clear)
    key = hashlib.sha256(model.weight.tobytes() + repr(model.bias).encode()).digest()
    if key not in _memo:
        _memo.clear()
        _memo[key] = {}, model.weight.tolist()
    memo, weight = _memo[key]
    out = []
    for text in texts:
        words = words_of(text or "")
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            f = features(w)
            memo[w] = sum([weight[k] for k in f]) / len(f)
        out.append(model.bias + (sum(map(memo.__getitem__, words)) / len(words) if words else 0.0))
    return (1.0 / (1.0 + np.exp(-np.clip(out, -50, 50)))).tolist()


def scorer(model: Model):
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(score_texts(model, text), dtype="float64")

    return lambda text_col: score(F.col(text_col).cast("string"))


def score_column(model: Model, text_col: str = "text") -> Column:
    return scorer(model)(text_col)


def op3_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", (fold() == 0).alias("held_out"), score_column(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
