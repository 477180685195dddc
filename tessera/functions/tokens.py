"""The token grammar of `text` for whole corpora, in Arrow batches: what stands between blanks is split once and remembered.

A term never holds white space, so a text falls into lines, and these into runs without blanks. The terms of a run, and
whether it starts and ends with a plain one, follow from the run; joined neighbours follow from two runs of one line.
Texts come in folded (`text.folded`).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Runs that a worker remembers, the longest of them, the rows that go on at once, and the postings that are inverted at once.
MEMO, LONG, ROWS, INVERTED = 200_000, 64, 1 << 16, 1 << 20
_A = r"[^\W_]"  # a letter or number: str.isalnum
_TERM = re.compile(rf"[$.]?{_A}+(?:[._-]{_A}+)*(?:\+\+|#)?")
_PARTED = re.compile(r"[._-]")
_STOP = frozenset(T.STOPWORDS)


_own = itemgetter(0)


class Grammar(dict):
    """Tokens of folded texts; with `stopwords` those too. Holds what is known of runs: (tokens, plain term at the start, plain term at the end), the terms only if they may be joined."""

    def __init__(self, stopwords: bool = False) -> None:
        self.drop = frozenset() if stopwords else _STOP

    def __missing__(self, run: str) -> tuple:
        found = list(_TERM.finditer(run))
        out, head, tail = [m[0] for m in found], None, None
        for t in out[:]:
            if t[0].isalnum() and t[-1].isalnum() and not t.isalnum() and any(map(str.isalpha, t)):
                parts = _PARTED.split(t)
                out += dict.fromkeys([*parts, "".join(parts)])
        if found:
            first, last = found[0], found[-1]
            if first.start() == 0 and self._joins(first[0]):
                head = first[0]
            if last.end() == len(run) and self._joins(last[0]):
                tail = last[0]
        known = tuple(t for t in out if t not in self.drop), head, tail
        if len(run) <= LONG:
            self[run] = known
        return known

    @staticmethod
    def _joins(t: str) -> bool:
        return len(t) >= 2 and t.isalnum() and t not in _STOP

    def of(self, text: str) -> list[str]:
        """The tokens of a text, with repeats."""
        if len(self) > MEMO:
            self.clear()
        out: list[str] = []
        find, drop = self.__getitem__, self.drop
        for line in (text.replace("\r", "\n") if "\r" in text else text).split("\n"):
            runs = list(map(find, line.split()))
            out += chain.from_iterable(map(_own, runs))
            out += [
                both for (_, _, a), (_, b, _) in zip(runs, runs[1:], strict=False)
                if a and b and a != b and (n := len(both := a + b)) <= 48 and (n > 4 or both not in drop) and (both.isalpha() or any(map(str.isalpha, both)))
            ]
        return out


_grammars: dict[bool, Grammar] = {}


def grammar(stopwords: bool = False) -> Grammar:
    """One for each Python worker."""
    if stopwords not in _grammars:
        _grammars[stopwords] = Grammar(stopwords)
    return _grammars[stopwords]


def _over_texts(docs: DataFrame, doc: str, text: str, composed: bool, run, kinds: str) -> DataFrame:
    """`run` over batches of (doc, folded text); doc keeps its type, kinds are those of the other columns."""
    content = F.col(text) if composed else T.nfc(F.col(text))
    slim = docs.select(F.col(doc).alias("doc"), T.folded(content).alias("text"))
    return slim.mapInArrow(run, f"doc {slim.schema['doc'].dataType.simpleString()}, {kinds}")


def lengths(docs: DataFrame, doc: str = "doc_id", text: str = "text", composed: bool = False) -> DataFrame:
    """doc, length: one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grammar()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(g.of(t.as_py())) for t in b.column(1)], pa.int64())], names=["doc", "length"])

    return _over_texts(docs, doc, text, composed, run, "length long")


def counts(docs: DataFrame, doc: str = "doc_id", text: str = "text", composed: bool = False) -> DataFrame:
    """doc, length, token, tf: one row per document and token, each document on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grammar()
        for b in batches:
            tokens, tfs, where, sizes = [], [], [], []
            for i, t in enumerate(b.column(1)):
                own = g.of(t.as_py())
                found = Counter(own)
                tokens += found
                tfs += found.values()
                where += [i] * len(found)
                sizes += [len(own)] * len(found)
                if len(tokens) >= ROWS or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(where, pa.int64())), pa.array(sizes, pa.int64()), pa.array(tokens, pa.string()), pa.array(tfs, pa.int64())], names=["doc", "length", "token", "tf"])
                    tokens, tfs, where, sizes = [], [], [], []

    return _over_texts(docs, doc, text, composed, run, "length long, token string, tf long")


def inverted(docs: DataFrame, block: int, doc: str = "doc_id", text: str = "text", composed: bool = False) -> DataFrame:
    """token, block, docs: the documents of a token among some neighbouring ones, by blocks of `block` ids; other rows have more of a token's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grammar()
        for b in batches:
            blocks, tokens, sizes, lo = b.column(2).to_pylist(), [], [], 0
            for i, t in enumerate(b.column(1)):
                own = set(g.of(t.as_py()))
                tokens += own
                sizes.append(len(own))
                if len(tokens) >= INVERTED or i + 1 == b.num_rows or blocks[i + 1] != blocks[lo]:
                    coded = pa.array(tokens, pa.string()).dictionary_encode()
                    codes = coded.indices.to_numpy()
                    ends = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))])
                    at = np.repeat(np.arange(lo, i + 1), sizes)[np.argsort(codes, kind="stable")]
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), b.column(0).take(pa.array(at)))
                    yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array([blocks[lo]] * len(coded.dictionary), pa.int64()), lists], names=["token", "block", "docs"])
                    tokens, sizes, lo = [], [], i + 1

    content = F.col(text) if composed else T.nfc(F.col(text))
    slim = docs.select(F.col(doc).alias("doc"), T.folded(content).alias("text"), F.expr(f"{doc} div {block}").alias("block"))
    return slim.mapInArrow(run, f"token string, block long, docs array<{slim.schema['doc'].dataType.simpleString()}>")


def merged(rows: DataFrame) -> DataFrame:
    """token, block, docs of rows(token, block, docs) that lie sorted by token and block: the sorted documents of each, once. No document may be null."""

    def joined(b: pa.Table) -> pa.RecordBatch:
        """One row for each run of rows with one key."""
        b = b.combine_chunks().to_batches()[0]
        lists, new = b.column(2), _starts(b)
        docs, of = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.cumsum(new) - 1, np.diff(lists.offsets.to_numpy()))
        order = np.lexsort((docs, of))
        docs, of = docs[order], of[order]
        once = np.concatenate([[True], (docs[1:] != docs[:-1]) | (of[1:] != of[:-1])])
        ends = np.concatenate([[0], np.cumsum(np.bincount(of[once], minlength=int(new.sum())))])
        first = pa.array(np.flatnonzero(new))
        return pa.RecordBatch.from_arrays([b.column(0).take(first), b.column(1).take(first), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(docs[once], lists.type.value_type))], names=["token", "block", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of one key at the end
        for b in batches:
            if not b.num_rows:
                continue
            last = int(np.flatnonzero(_starts(b))[-1])
            same = held and held[0].column(0)[0] == b.column(0)[0] and held[0].column(1)[0] == b.column(1)[0]
            if last or (held and not same):
                yield joined(pa.Table.from_batches([*held, b.slice(0, last)]))
                held = []
            held.append(b.slice(last))
        if held:
            yield joined(pa.Table.from_batches(held))

    return rows.mapInArrow(run, rows.schema)


def _starts(b: pa.RecordBatch) -> np.ndarray:
    """Which rows have another token or block than the row before."""
    n = b.num_rows - 1
    out = [pc.not_equal(c.slice(0, n), c.slice(1)) for c in (b.column(0), b.column(1))]
    return np.concatenate([[True], pc.or_(*out).to_numpy(zero_copy_only=False).astype(bool)])


def query_counts(docs: DataFrame, query: list[str], doc: str = "doc_id", text: str = "text", composed: bool = False, stopwords: bool = False) -> DataFrame:
    """doc, length, tf: how often a document has each token of the query; with `stopwords` documents keep theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, wanted, none = grammar(stopwords), frozenset(query), [0] * len(query)
        for b in batches:
            sizes, tfs = [], []
            for t in b.column(1):
                own = g.of(t.as_py())
                sizes.append(len(own))
                tfs.append(none if wanted.isdisjoint(own) else list(map(own.count, query)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(tfs, pa.list_(pa.int32()))], names=["doc", "length", "tf"])

    return _over_texts(docs, doc, text, composed, run, "length int, tf array<int>")


def distinct(docs: DataFrame, doc: str = "doc_id", text: str = "text", composed: bool = False) -> DataFrame:
    """token: every token at least once; a task remembers MEMO of them and gives these once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, seen = grammar(), set()
        for b in batches:
            fresh: set[str] = set()
            for i, t in enumerate(b.column(1)):
                fresh.update(g.of(t.as_py()))
                if len(fresh) >= ROWS or i + 1 == b.num_rows:
                    fresh -= seen
                    yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.string())], names=["token"])
                    seen = fresh if len(seen) > MEMO else seen | fresh
                    fresh = set()

    content = F.col(text) if composed else T.nfc(F.col(text))
    return docs.select(F.col(doc).alias("doc"), T.folded(content).alias("text")).mapInArrow(run, "token string")
