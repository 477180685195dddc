"""Token-ID output: a content-addressed store of token-id chunks.

Ids of a document are cut where a rolling hash of the last ROLL ids meets a mask, so equal passages
give equal chunks. A chunk's address is the SHA-256 of its ids; each is stored once. A document is a
recipe: the addresses of its chunks, with their Merkle root. Recipes lie in ascending id order; a
manifest holds a root over each recipe part, so every level of a reconstruction can be verified.

Files, all Parquet, in one folder of the shared store:
  data/kind=0   chunks: key (address), n (ids), payload (zstd of little-endian uint16 or uint32)
  recipes       doc_id, n, root, chunks (addresses in order), row_no, before (ids of earlier documents)
  manifest      part, rows, root

Null text is an empty document (its end id alone). Repeated rows get recipes of their own. A null
id sorts first. An empty table gives empty files.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, numbered, read_table

#: Chunk lengths in ids; MASK_BITS sets the mean. MEMO bounds the words that a worker remembers.
ROLL, MIN_IDS, MAX_IDS, MASK_BITS, MEMO = 8, 512, 8192, 11, 500_000
WORD_BPE = "word_bpe_49k.json"
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"
#: White space to Python but not to the tokenizer, and what may begin a special token: encoded as a whole.
WHOLE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: Characters whose lower case or composition is not plain. A text without them is put in lower case as one, as the normalizer would.
FOREIGN = re.compile("[\u0130\u0250-\U0010ffff]")


class WordEncoder:
    """The tokenizers library, asked once for each distinct word.

    For tokenizers whose pre-tokenizer never crosses white space and drops it (word_bpe_49k.json):
    encode(text) is then the concatenation over white-space separated words. Marks after a word of
    letters are a pre-token of their own. Words of Latin letters (all below U+0250, where lower case
    and composition are plain) skip the normalizer and go to the model joined by spaces; their ends
    show in the ids, by the vocabulary's end-of-word mark. The memo has two generations of `memo`
    words; when one is full, words not used since go.
    """

    def __init__(self, model: str, dtype: str, memo: int = MEMO) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.dtype, self.memo, self.old, self.room = Tokenizer.from_str(model), dtype, {}, {}, memo
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.comma, self.stop = self._ids([",", "."])

    def _ids(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _latin(self, words: list[str]) -> list[bytes]:
        out, width = [], np.dtype(self.dtype).itemsize
        for lo in range(0, len(words), 2000):
            part = words[lo : lo + 2000]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()
            if len(ends) != len(part):  # a word without its mark: ask one by one
                out += self._ids(part)
                continue
            raw, last = ids.tobytes(), 0
            for end in ends:
                out.append(raw[last:end])
                last = end
        return out

    def _learn(self, words: set[str]) -> None:
        """Puts all of `words` into the memo."""
        if len(self.memo) > self.room:
            self.old, self.memo = self.memo, {}
        memo, old = self.memo, self.old
        new = words.difference(memo)
        if old:
            known = new.intersection(old)
            memo.update({w: old[w] for w in known})
            new -= known
        forms, lows, tails, rest = [], [], [], []
        for w in new:
            stem = w.rstrip(MARKS)
            if stem.isalpha() and (stem.isascii() or max(stem) < "\u0250" and "\u0130" not in stem):
                forms.append(w)
                lows.append(stem.lower())
                tails.append(w[len(stem) :])
            else:
                rest.append(w)
        rest += set(tails).difference(memo, rest, [""])
        memo.update(zip(rest, self._ids(rest), strict=True))
        unknown = list(set(lows).difference(memo))
        memo.update(zip(unknown, self._latin(unknown), strict=True))
        memo.update({w: memo[low] + memo[tail] if tail else memo[low] for w, low, tail in zip(forms, lows, tails, strict=True) if w != low})

    @staticmethod
    def _words(text: str) -> list[str] | None:
        """Pieces that encode one by one as the whole does; None: no such pieces."""
        if any(map(text.__contains__, WHOLE)):
            return None
        return (text.lower() if text.isascii() or not FOREIGN.search(text) else text).split()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as bytes."""
        split = [self._words(t) for t in texts]
        words = set().union(*(w for w in split if w))
        if not words <= self.memo.keys():
            self._learn(words)
        find = self.memo.__getitem__
        for text, words in zip(texts, split, strict=True):
            yield self._ids([text])[0] if words is None else b"".join(map(find, words))


_encoders: dict = {}


def encoder(model: str, dtype: str) -> WordEncoder:
    """One for each Python worker."""
    key = (zlib.crc32(model.encode()), dtype)
    if key not in _encoders:
        _encoders[key] = WordEncoder(model, dtype)
    return _encoders[key]


def cut(ids: np.ndarray, least: int = MIN_IDS, most: int = MAX_IDS, bits: int = MASK_BITS) -> list[int]:
    """Ends of the chunks of ids."""
    n = len(ids)
    if n <= least:
        return [n]
    gear = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    gear ^= gear >> np.uint32(15)
    h = gear.copy()
    for k in range(1, ROLL):
        h[k:] += gear[:-k] << np.uint32(k)
    marks = np.flatnonzero((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits) == 0) + 1
    ends, last = [], 0
    while n - last > most or (len(marks) and n - last > least):
        i = np.searchsorted(marks, last + least)
        end = int(marks[i]) if i < len(marks) else n
        end = min(end, last + most)
        if end >= n:
            break
        ends.append(end)
        last = end
    return [*ends, n]


def merkle(leaves: Iterable[bytes]) -> bytes:
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[k : k + 2])).digest() for k in range(0, len(level), 2)]
    return level[0]


@dataclass
class Store:
    """Where a store lies, and the number type of its payloads."""

    spark: SparkSession
    path: str
    dtype: str

    def chunks(self) -> DataFrame:
        rows = self.spark.read.schema("kind int, key binary, doc_id long, n long, payload binary").parquet(f"{self.path}/data")  # without rows there is no folder of a kind
        return rows.where("kind = 0").select("key", "doc_id", "n", "payload")

    def recipes(self) -> DataFrame:
        return self.spark.read.schema("doc_id long, n long, root binary, chunks array<binary>, row_no long, before long").parquet(f"{self.path}/recipes")

    def manifest(self) -> DataFrame:
        return self.spark.read.schema("part long, rows long, root string").parquet(f"{self.path}/manifest")


def manifest_of(recipes: DataFrame, rows: int = 4096) -> DataFrame:
    """A root over each run of `rows` recipes in order."""
    part = F.expr(f"row_no div {rows}")
    each = F.array_sort(F.collect_list(F.struct("row_no", F.hex("root").alias("root"))))
    return recipes.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.array_join(F.transform(each, lambda x: x["root"]), ""), 256).alias("root"))


def damaged_parts(store: Store) -> DataFrame:
    """part: every part of the manifest whose recipes are not those it was written for, or are gone."""
    now = manifest_of(store.recipes()).select("part", F.col("rows").alias("rows_now"), F.col("root").alias("root_now"))
    return store.manifest().join(now, "part", "full_outer").where("not (rows <=> rows_now and root <=> root_now)").select("part")


def write_store(df: DataFrame, model_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> Store:
    """Encodes every text, appends end_id, and writes the store."""
    from tokenizers import Tokenizer

    spark = df.sparkSession
    model = open(model_path, encoding="utf-8").read()
    dtype = "<u2" if max(Tokenizer.from_str(model).get_vocab_size(), end_id + 1) <= 65536 else "<u4"
    path = path or new_path(spark, "token-store")
    end = np.array([end_id], dtype=dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        enc, squeeze, seen, at = encoder(model, dtype), zstandard.ZstdCompressor(level=1), 0, TaskContext.get().partitionId()
        width = np.dtype(dtype).itemsize

        def rows(ids: list[str], texts: list[str]) -> list[tuple]:
            nonlocal seen
            out = []
            for doc_id, raw in zip(ids, enc.encode(texts), strict=True):
                raw += end
                last, keys = 0, []
                for stop in cut(np.frombuffer(raw, dtype)):
                    piece = raw[last * width : stop * width]
                    keys.append(hashlib.sha256(piece).digest())
                    out.append((0, keys[-1], None, stop - last, squeeze.compress(piece), None))
                    last = stop
                out.append((1, struct.pack(">qq", at, seen), doc_id, last, merkle(keys), keys))
                seen += 1
            return out

        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                got = rows(part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()])
                kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True), kinds, strict=True)], names=["kind", "key", "doc_id", "n", "payload", "chunks"])

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = slim.mapInArrow(run, "kind int, key binary, doc_id long, n long, payload binary, chunks array<binary>")
    made.dropDuplicates(["kind", "key"]).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/data")
    store = Store(spark, path, dtype)
    raw = spark.read.schema("kind int, key binary, doc_id long, n long, payload binary, chunks array<binary>").parquet(f"{path}/data")
    rows = raw.where("kind = 1").select("doc_id", "n", F.col("payload").alias("root"), "chunks")
    ordered, _ = numbered(rows, [F.col("doc_id"), F.col("root")], "recipes", total="n")
    ordered.select("doc_id", "n", "root", "chunks", "row_no", "before").write.parquet(f"{path}/recipes")
    manifest_of(store.recipes()).write.parquet(f"{path}/manifest")
    return store


_shifts: dict[int, int] = {}


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of CRC-32, bits reflected."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def _shift(n_bytes: int) -> int:
    """x to the power 8 n."""
    if n_bytes not in _shifts:
        out, power, n = 0x80000000, 0x00800000, n_bytes  # 1 and x^8
        while n:
            if n & 1:
                out = _times(out, power)
            power, n = _times(power, power), n >> 1
        if len(_shifts) > 100_000:
            _shifts.clear()
        _shifts[n_bytes] = out
    return _shifts[n_bytes]


def joined_crc(parts: Iterable[tuple[int, int]]) -> int:
    """The CRC-32 of a concatenation from (CRC-32, bytes) of its parts."""
    out = 0
    for crc, n in parts:
        out = _times(_shift(n), out) ^ crc
    return out


def read_ids(store: Store) -> DataFrame:
    """doc_id, row_no, ids: every document put together again from its chunks."""
    dtype = store.dtype

    @F.pandas_udf("array<int>")
    def ids(payloads: pd.Series) -> pd.Series:
        import zstandard

        d = zstandard.ZstdDecompressor()
        return pd.Series([np.concatenate([np.frombuffer(d.decompress(x["payload"]), dtype) for x in p]).astype(np.int32) for p in payloads])

    uses = store.recipes().select("doc_id", "row_no", F.posexplode("chunks").alias("pos", "key"))
    found = uses.join(store.chunks().select("key", "payload"), "key").groupBy("row_no", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "payload"))).alias("parts"))
    return found.select("doc_id", "row_no", ids("parts").alias("ids"))


def read_digests(store: Store) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and verified for every document, from the files.

    Every stored chunk is read, checked against its address and digested once; digests, not ids,
    are then brought together by the recipes. `verified`: all chunks are there, lengths agree, and
    the Merkle root of the addresses is the stored one.
    """
    dtype = store.dtype

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        d = zstandard.ZstdDecompressor()
        for b in batches:
            got = []
            for key, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = d.decompress(payload)
                ids = np.frombuffer(raw, dtype)
                got.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(raw).digest() == key))
            n, crc, good = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(good, pa.bool_())], names=["key", "n_ids", "crc", "good"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, crcs, oks = b.to_pydict(), [], []
            for parts, n, root in zip(t["parts"], t["n"], t["root"], strict=True):
                crcs.append(joined_crc((p["crc"], 4 * p["n_ids"]) for p in parts))
                oks.append(all(p["good"] for p in parts) and sum(p["n_ids"] for p in parts) == n and merkle(p["key"] for p in parts) == root)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crcs, pa.int64()), pa.array(oks, pa.bool_())], names=["doc_id", "start", "n_tokens", "ids_crc32", "verified"])

    recipes = store.recipes()
    uses = recipes.select("row_no", F.posexplode("chunks").alias("pos", "key"))
    digests = store.chunks().select("key", "payload").mapInArrow(digest, "key binary, n_ids long, crc long, good boolean")
    parts = uses.join(digests, "key").groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "n_ids", "crc", "good"))).alias("parts"))
    whole = recipes.select("row_no", "doc_id", "before", "n", "root").join(parts, "row_no", "left")
    none = F.expr("cast(array() as array<struct<pos:int,key:binary,n_ids:bigint,crc:bigint,good:boolean>>)")
    return whole.select("doc_id", "before", "n", "root", F.coalesce("parts", none).alias("parts")).mapInArrow(join, "doc_id long, start long, n_tokens long, ids_crc32 long, verified boolean")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_digests(write_store(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), 2))
