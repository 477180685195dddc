"""SentencePiece encoding and decoding: a max-plus scan over the chunks of giant documents.

Scores, pieces and ties are those of `unigram.Lattice`. A document of over CHUNK characters falls
into chunks. A boundary state is how far the last piece of earlier chunks reaches into a chunk; a
chunk's transfer matrix has the best score from each state at its start to each at its end, over
pieces that start in it. Matrices combine associatively in the (max, +) semiring, within blocks and
then over blocks. That gives each chunk the exact forward scores at its start, from which it tells
for each of its end states the start state of the best path, ties as in one pass; these maps are
combined from the last chunk to the first, and each chunk is then traced on its own between its two
states. The ids are those of one pass over the text whatever the chunk length. No piece crosses from
a letter into a meta symbol, so inside a chunk all paths meet at its cuts: a matrix is the part to
the first cut, the memo's sum, and the part from the last. A chunk without a cut runs the lattice
from every state.

Workers take texts in slices of SLICE characters and chunks one by one, and remember words of up to
LONG characters. Null and empty texts have no ids and decode to the empty text. A text with the meta
symbol itself decodes with a space there, as the library's does; `text_crc32` is of the text with
that change. Repeated rows are encoded each, null ids too. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold_memo, read_table, stash
from .unigram import META, Lattice, forget_lattices, lattice, model_bytes, pre_tokens

CHUNK, BLOCK, MEMO, NONE, SLICE, LONG = 32_768, 64, 200_000, -(1 << 60), 1 << 18, 200


class Encoder:
    """Ids and scores of words, remembered in two generations of MEMO words of at most LONG characters."""

    def __init__(self, lat: Lattice) -> None:
        self.lat, self.memo, self.old = lat, {}, {}

    def _found(self, texts: list[str]) -> list[list[tuple[bytes, int]]]:
        """(ids, score) of each pre-token of each text; the words that are new in any of them are learned at once."""
        if len(self.memo) > MEMO:
            self.old, self.memo = self.memo, {}
        memo, old = self.memo, self.old
        split = [pre_tokens(t) for t in texts]
        new = set().union(*split).difference(memo)
        long = {w for w in new if len(w) > LONG}
        known = {w: old[w] for w in new if w in old}  # intersection() would walk all of a dict
        memo.update(known)
        memo.update(self.lat.all_ids(new.difference(known, long)))
        memo.update({w: self.lat.best_bytes(w) for w in long})
        out = [list(map(memo.__getitem__, words)) for words in split]
        for w in long:  # not remembered
            del memo[w]
        return out

    def encode(self, *texts: str) -> list[bytes]:
        """The ids of normalized texts, as bytes."""
        return [b"".join([x[0] for x in words]) for words in self._found(list(texts))]

    def score(self, text: str) -> int:
        return sum([x[1] for x in self._found([text])[0]])


_encoders: dict[int, Encoder] = {}


def forget() -> None:
    _encoders.clear()
    forget_lattices()


def encoder(model: bytes) -> Encoder:
    """One for each Python worker."""
    hold_memo("sentencepiece", forget)
    if (key := hash(model)) not in _encoders:
        _encoders[key] = Encoder(lattice(model))
    return _encoders[key]


def _from(lat: Lattice, text: str, start: int, core: int) -> np.ndarray:
    """The best scores from `start` to core, core + 1, ... over pieces that start before core."""
    width = lat.longest
    out = np.full(width, NONE, dtype=np.int64)
    if start >= core:
        out[start - core] = 0
        return out
    n = min(len(text), core + width - 1)
    score, _ = lat.forward(text, n, {start: 0}, core)
    for j in range(core, n + 1):
        if score[j] is not None:
            out[j - core] = score[j]
    return out


def starts_of(enc: Encoder, text: str, core: int, entry: np.ndarray) -> np.ndarray:
    """For each end state of a chunk the start state of the best path, given the forward scores `entry` at its start.

    Ties as in one pass: a score that comes from before the chunk has the earlier start. -1: no path.
    """
    lat = enc.lat
    width = lat.longest
    first = _cut(text, 1, 1, core)
    n = first if first is not None else min(len(text), core + width - 1)
    own = {a: int(v) for a, v in enumerate(entry) if v > NONE and a <= n}
    score, back = lat.forward(text, n, own, n if first is not None else core)

    def origin(j: int) -> int:
        while back[j] >= 0:
            j = back[j]
        return j

    if first is not None:
        return np.full(width, origin(first), dtype=np.int32)
    return np.array([origin(core + z) if core + z <= n and score[core + z] is not None else -1 for z in range(width)], dtype=np.int32)


def transfer(enc: Encoder, text: str, core: int) -> np.ndarray:
    """(states, states) best scores over a chunk of `core` characters; text also has those that follow it."""
    lat = enc.lat
    width = lat.longest
    cuts = [i for i in (_cut(text, 1, 1, core), _cut(text, core - 1, -1, core)) if i is not None]
    if len(cuts) < 2:
        return np.stack([_from(lat, text, a, core) for a in range(width)])
    first, last = cuts
    out = np.full((width, width), NONE, dtype=np.int64)
    tail = _from(lat, text, last, core)
    middle = enc.score(text[first:last])
    for a in range(min(first, width - 1) + 1):
        out[a] = np.where(tail > NONE, enc.score(text[a:first]) + middle + tail, NONE)
    return out


def _cut(text: str, i: int, step: int, core: int) -> int | None:
    while 0 < i < core:
        if text[i] == META and text[i - 1] != META:
            return i
        i += step
    return None


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NONE)


def entries(matrices: list[np.ndarray], entry: np.ndarray) -> list[np.ndarray]:
    """The forward scores before each matrix, from those before the first."""
    out = [entry]
    for m in matrices[:-1]:
        out.append(np.maximum((out[-1][:, None] + m).max(axis=0), NONE))
    return out


def _ids_batch(ids: list, names: tuple[str, ...], raws: list[bytes], *more: pa.Array) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raws])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raws), "<i4")))
    return pa.RecordBatch.from_arrays([*ids, lists, *more], names=list(names))


def encode(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, check: bool = False) -> DataFrame:
    """doc_id, ids (array<int>), text_crc32 for every row.

    With `check` also round_trip: whether the ids decode to the text. The worker that made the ids decodes them, so a
    task has one Python worker and not one more for decode(); only giants are decoded after their chunks meet.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.crc32(F.translate(text, META, " ").cast("binary")).alias("text_crc32"))
    id_type = slim.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                texts, seen, hi = [], 0, lo
                while hi < b.num_rows and seen < SLICE:
                    texts.append(b.column(1)[hi].as_py())
                    seen, hi = seen + len(texts[-1]) + 64, hi + 1
                raws = enc.encode(*map(enc.lat.normalize, texts))
                more = [pa.array([decode_ids(enc.lat, np.frombuffer(r, "<i4")) == t.replace(META, " ") for r, t in zip(raws, texts, strict=True)], pa.bool_())] if check else []
                yield _ids_batch([b.column(0).slice(lo, hi - lo)], names, raws, b.column(2).slice(lo, hi - lo), *more)
                lo = hi

    names = ("doc_id", "ids", "text_crc32", *["round_trip"] * check)
    kinds = f"doc_id {id_type}, ids array<int>, text_crc32 long" + ", round_trip boolean" * check
    small = slim.where(F.char_length("text") <= chunk).mapInArrow(whole, kinds)

    width = lattice(model).longest
    giants = slim.where(F.char_length("text") > chunk).withColumn("uid", F.monotonically_increasing_id())

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t = Lattice.normalize(b.column(1)[i].as_py())
                for no, lo in enumerate(range(0, len(t), chunk)):
                    row = [pa.array([x], k) for x, k in ((no, pa.int32()), (min(chunk, len(t) - lo), pa.int32()), (t[lo : lo + chunk + width - 1], pa.string()))]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(2).slice(i, 1), b.column(3).slice(i, 1), *row], names=["doc_id", "text_crc32", "uid", "no", "core", "part"])

    # written once: uids stay as they are, and every later step reads chunks, never a whole giant
    parts = stash(giants.select("doc_id", "text", "text_crc32", "uid").mapInArrow(cut_up, f"doc_id {id_type}, text_crc32 long, uid long, no int, core int, part string").repartition("uid", "no"), "giant-chunks")
    named = parts.where("no = 0").select("uid", "doc_id", "text_crc32")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for b in batches:
            got = [transfer(enc, b.column(3)[i].as_py(), b.column(2)[i].as_py()).tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.binary())], names=["uid", "no", "m"])

    moves = stash(parts.select("uid", "no", "core", "part").mapInArrow(matrices, "uid long, no int, m binary"), "transfers")

    def load(pdf: pd.DataFrame) -> list[np.ndarray]:
        return [np.frombuffer(m, np.int64).reshape(width, width) for m in pdf["m"]]

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        total = None
        for m in load(pdf):
            total = m if total is None else times(total, m)
        return pd.DataFrame({"uid": pdf["uid"].iloc[:1], "block": pdf["block"].iloc[:1], "m": [total.tobytes()]})

    def block_entries(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        start = np.full(width, NONE, dtype=np.int64)
        start[0] = 0
        return pd.DataFrame({"uid": pdf["uid"].to_numpy(), "block": pdf["block"].to_numpy(), "entry": [e.tobytes() for e in entries(load(pdf), start)]})

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        got = entries(load(pdf), np.frombuffer(pdf["entry"].iloc[0], np.int64))
        return pd.DataFrame({"uid": pdf["uid"].to_numpy(), "no": pdf["no"].to_numpy(), "entry": [e.tobytes() for e in got]})

    blocks = moves.withColumn("block", F.floor(F.col("no") / BLOCK).cast("int"))
    products = blocks.groupBy("uid", "block").applyInPandas(product, "uid long, block int, m binary")
    block_starts = products.groupBy("uid").applyInPandas(block_entries, "uid long, block int, entry binary")
    known = blocks.join(block_starts, ["uid", "block"]).groupBy("uid", "block").applyInPandas(inside, "uid long, no int, entry binary")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for b in batches:
            got = [starts_of(enc, b.column(3)[i].as_py(), b.column(2)[i].as_py(), np.frombuffer(b.column(4)[i].as_py(), np.int64)).tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.binary())], names=["uid", "no", "starts"])

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        """From the last chunk to the first; a document of Spark's largest string has 65,536 chunks of 4 x width bytes here."""
        pdf = pdf.sort_values("no", ascending=False)
        stop, rows = 0, []
        for no, m in zip(pdf["no"], pdf["starts"], strict=True):
            start = int(np.frombuffer(m, np.int32)[stop])
            rows.append((no, start, stop))
            stop = start
        return pd.DataFrame({"uid": pdf["uid"].to_numpy(), "no": [r[0] for r in rows], "start": [r[1] for r in rows], "stop": [r[2] for r in rows]})

    mapped = parts.join(known, ["uid", "no"]).select("uid", "no", "core", "part", "entry").mapInArrow(maps, "uid long, no int, starts binary")
    fixed = stash(mapped.groupBy("uid").applyInPandas(states, "uid long, no int, start int, stop int"), "chunk-states")

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for b in batches:
            for i in range(b.num_rows):
                core, part, start, stop = (b.column(k)[i].as_py() for k in (2, 3, 4, 5))
                yield _ids_batch([b.column(0).slice(i, 1), b.column(1).slice(i, 1)], ("uid", "no", "ids"), enc.encode(part[start : core + stop]))

    pieces = parts.join(fixed, ["uid", "no"]).select("uid", "no", "core", "part", "start", "stop").mapInArrow(traced, "uid long, no int, ids array<int>")
    joined = pieces.groupBy("uid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids"))  # one document, a row of the result
    large = named.join(joined, "uid").select("doc_id", "ids", "text_crc32")
    if check:
        large = decode(large, model).withColumn("round_trip", F.crc32(F.col("decoded").cast("binary")) == F.col("text_crc32"))
    return small.union(large.select(*names))


def decode_ids(lat: Lattice, ids: np.ndarray) -> str:
    """The text of ids."""
    out: list[bytes] = lat.raw_pieces()
    return b"".join(map(out.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(META, " ")[1:]


def decode(df: DataFrame, model: bytes, ids_col: str = "ids") -> DataFrame:
    """df with the column `decoded`; null ids give the empty text."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        lat = lattice(model)
        return pd.Series([decode_ids(lat, i) if i is not None and len(i) else "" for i in ids], dtype=object)

    return df.withColumn("decoded", text(ids_col))


def op7_maxplus_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = model_bytes()
    out = decode(encode(read_table(spark, sf_dir, "documents"), model), model)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), (F.crc32(F.col("decoded").cast("binary")) == F.col("text_crc32")).alias("round_trip"))
