"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Statistics of each whole text are standardised; FEATURES random cosines approximate a Gaussian
kernel over them. Each partition of training rows adds up its part of the normal equations; parts
are summed in two levels, so the driver receives one matrix whatever the row count. Ridge scores of
another fold, in BINS fixed bins, go through pool-adjacent-violators: a monotone map to the share of
class 1.

Folds (crc32 of the id mod 5): 1 to 3 fit the ridge, 4 the calibration, 0 is held out.

Null and empty texts have the statistics of an empty text. Without labelled rows every score is 0.5.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stash
from .labels import fold

FEATURES, GAMMA, RIDGE, BINS, SEED = 256, 0.05, 1e-3, 400, 11
_UPPER, _LOWER = (np.isin(np.arange(256), list(x.encode())) for x in (string.ascii_uppercase, string.ascii_lowercase))
_DIGIT, _PUNCT = (np.isin(np.arange(256), list(x.encode())) for x in (string.digits, string.punctuation))
NAMES = ("log_chars", "log_words", "log_lines", "upper", "digit", "punct", "other", "comma_stop", "unusual", "word_len", "word_len_sd", "distinct", "top_word", "pair_repeat", "line_repeat", "short_lines", "ends_plain", "entropy", "bar_brace", "capital_words")


def statistics(text: str | None) -> list[float]:
    """Numbers about one whole text, in the order of NAMES."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, len(raw))
    hist = np.bincount(raw, minlength=256).astype(np.float64)
    words = text.split()
    w = max(1, len(words))
    lens = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = text.split("\n")
    filled = [x for x in lines if x]
    share = hist[hist > 0] / n
    usual = hist[ord(",")] + hist[ord(".")]
    punct = hist[_PUNCT].sum()
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), hist[_UPPER].sum() / n, hist[_DIGIT].sum() / n, punct / n,
        hist[128:].sum() / n, usual / n, (punct - usual) / w, lens.mean(), lens.std(), len(counts) / w, max(counts.values(), default=0) / w,
        1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0, 1 - len(set(filled)) / max(1, len(filled)), sum(len(x) < 30 for x in filled) / max(1, len(filled)),
        sum(x[-1] in ".!?:;\"'" for x in filled) / max(1, len(filled)), float(-(share * np.log(share)).sum()), (hist[ord("|")] + hist[ord("{")] + hist[ord("<")]) / w, sum(map(str.isupper, counts)) / max(1, len(counts)),
    ]


def stats_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, stats (array) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([statistics(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), got], names=["doc_id", "stats"])

    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, stats array<double>")


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    edges: np.ndarray  # upper ends of bins on the ridge score, with the calibrated value of each
    values: np.ndarray

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.center, self.scale)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.fourier(stats) @ self.weight, 0, 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.edges, self.values) if len(stats) else np.zeros(0)


def fourier(stats: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    freq = rng.standard_normal((len(NAMES), FEATURES)) * np.sqrt(2 * GAMMA)
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((stats - center) / scale, -6, 6)
    return np.concatenate([np.sqrt(2.0 / FEATURES) * np.cos(z @ freq + phase), z, np.ones((len(z), 1))], axis=1)


def pool(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Isotonic regression of ordered groups (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for s, c in zip(sums, counts, strict=True):
        blocks.append([s, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s1, c1, k1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s1, blocks[-1][1] + c1, blocks[-1][2] + k1]
    return np.concatenate([np.full(int(k), s / c) for s, c, k in blocks]) if blocks else np.zeros(0)


def _summed(rows: DataFrame, make, width: int) -> np.ndarray:
    """The sum over rows(stats, label) of what make(stats, labels) returns, a (k, width) matrix: by partition, then in two levels by row of the matrix."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                got = make(np.stack(pdf["stats"].to_numpy()), pdf["label"].to_numpy().astype(float))
                total = got if total is None else total + got
        if total is not None:
            from pyspark import TaskContext

            yield pd.DataFrame({"i": np.arange(len(total)), "part": TaskContext.get().partitionId() % 16, "v": list(total)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "part": [0], "v": [np.sum(np.stack(pdf["v"].to_numpy()), axis=0)]})

    schema = "i int, part int, v array<double>"
    parts = rows.select("stats", "label").mapInPandas(part, schema)
    tens = F.floor(F.col("i") / 32)  # groups of matrix rows, so that few groups are made

    def add_many(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([add(g) for _, g in pdf.groupby("i")])

    got = parts.groupBy(tens, "part").applyInPandas(add_many, schema).groupBy(F.floor(F.col("i") / 32)).applyInPandas(add_many, schema).collect()
    out = np.zeros((max((r["i"] for r in got), default=-1) + 1, width))
    for r in got:
        out[r["i"]] = r["v"]
    return out


def train(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model | None:
    """The model from stats(doc_id, stats) and labels(doc_id, label); None without training rows."""
    known = labels.where(f"{label} is not null").groupBy(F.col("doc_id").alias("_id")).agg((F.max(label) > 0).cast("int").alias("label"))
    rows = stash(stats.join(known, stats["doc_id"] == known["_id"]).select(fold().alias("fold"), "stats", "label").where("fold <> 0"), "quality-training")
    ridge, rest = rows.where("fold <= 3"), rows.where("fold = 4")
    k = len(NAMES)
    moments = _summed(ridge, lambda s, y: np.stack([np.full(k, len(s), float), s.sum(axis=0), (s**2).sum(axis=0)]), k)
    if not len(moments):
        return None
    center = moments[1] / moments[0]
    scale = np.sqrt(np.maximum(moments[2] / moments[0] - center**2, 1e-12)) + 1e-6

    def normal(s: np.ndarray, y: np.ndarray) -> np.ndarray:
        x = fourier(s, center, scale)
        return np.concatenate([x.T @ x, (x.T @ y)[None]])

    d = FEATURES + k + 1
    eq = _summed(ridge, normal, d)
    weight = np.linalg.solve(eq[:-1] + RIDGE * moments[0][0] * np.eye(d), eq[-1])

    def binned(s: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.minimum((np.clip(fourier(s, center, scale) @ weight, 0, 1) * BINS).astype(int), BINS - 1)
        return np.stack([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)]).astype(float)

    bins = _summed(rest, binned, BINS)
    mids = (np.arange(BINS) + 0.5) / BINS
    if not len(bins):
        return Model(center, scale, weight, mids, mids)
    there = bins[0] > 0
    return Model(center, scale, weight, mids[there], pool(bins[1][there], bins[0][there]))


def op4_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stash(stats_of(read_table(spark, sf_dir, "documents")), "quality-stats")
    model = train(stats, read_table(spark, sf_dir, "labels"))

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(s.to_numpy())) if model and len(s) else [0.5] * len(s), dtype="float64")

    out = stats.select("doc_id", (fold() == 0).alias("held_out"), score("stats").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
