"""Structure-aware chunks within a token budget, in Arrow batches: a document's chunks depend on one another in order."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.html import slices

_WORD = re.compile(r"\S+")


class SpaceCounter:
    """Counts white-space separated words, and `special` more for each text. Any object with count and offsets may stand in.

    One that also has `spans`, as this one, is only asked about as much of a long text as a chunk can hold: a longer text must not
    count less, and each span must count at least one.
    """

    def __init__(self, limit: int = 256, special: int = 2) -> None:
        self.model_limit, self.special = limit, special

    def count(self, text: str) -> int:
        return len(text.split()) + self.special

    def offsets(self, text: str) -> list[tuple[int, int]]:
        return list(self.spans(text))

    def spans(self, text: str, at: int = 0) -> Iterator[tuple[int, int]]:
        """offsets from `at` on, one by one."""
        return (m.span() for m in _WORD.finditer(text, at))

    def fits(self, text: str, most: int) -> bool:
        """count(text) <= most, without a look at the words after those."""
        return most >= self.special and len(text.split(None, most - self.special)) <= most - self.special


def paragraphs(text: str) -> list[dict]:
    return [{"kind": "paragraph", "text": p} for p in re.split(r"\n\s*\n", text) if p.strip()]


def _sections(blocks: list[dict]) -> Iterator[tuple[list[str], list[dict]]]:
    """(headings above, blocks) in order; a heading without text of its own stands if the next is not below it."""
    path: list[tuple[int, str]] = []
    body: list[dict] = []
    for block in blocks:
        if not isinstance(block["text"], str):
            raise ValueError("block text must be a string")
        if block["kind"] != "heading":
            if block["text"].strip():
                body.append(block)
            continue
        level = block["level"]
        if body or path and level <= path[-1][0]:
            yield [h for _, h in path], body
            body = []
        path = [x for x in path if x[0] < level] + [(level, block["text"])]
    if body or path:
        yield [h for _, h in path], body


class _Packer:
    """Chunks of one section."""

    def __init__(self, counter, headings: list[str], limit: int, target: int, overlap: int) -> None:
        self.c, self.limit, self.target, self.overlap = counter, limit, target, overlap
        self.prefix = "\n".join(headings)
        room = max(counter.count(""), limit // 3)
        if counter.count(self.prefix) > room:
            self.prefix = self._head(self.prefix, max(counter.count("") + 1, limit // 3), lambda x: x)
        self.out: list[str] = []
        self.pending = self.previous = ""

    def compose(self, value: str) -> str:
        return (f"{self.prefix}\n\n{value}" if self.prefix else value).strip("\r\n")

    def fits(self, value: str) -> bool:
        composed = self.compose(value)
        return self.c.fits(composed, self.limit) if hasattr(self.c, "fits") else self.c.count(composed) <= self.limit

    def _head(self, value: str, most: int, render: Callable[[str], str]) -> str:
        if hasattr(self.c, "spans"):
            stops = [stop for _, stop in islice(self.c.spans(value), most + 1)]
            n = bisect_right(stops, most, key=lambda stop: self.c.count(render(value[:stop])))
            return value[: stops[n - 1]] if n else ""
        end = 0
        for _, stop in self.c.offsets(value):
            if self.c.count(render(value[:stop])) > most:
                break
            end = stop
        return value[:end]

    def _tail(self) -> str:
        spans = self.c.offsets(self.previous)
        if not spans or not self.overlap:
            return ""
        tail = self.previous[spans[max(0, len(spans) - self.overlap)][0] :]
        while tail and self.c.count(tail) - self.c.count("") > self.overlap:
            spans = self.c.offsets(tail)
            tail = tail[spans[1][0] :] if len(spans) > 1 else ""
        return tail

    def joined(self, value: str) -> str:
        """value after the end of the chunk before it, where both fit."""
        if not self.previous or not self.overlap:
            return value
        longer = f"{self._tail()}\n\n{value}"
        return longer if self.fits(longer) else value

    def emit(self, value: str) -> None:
        if text := self.compose(value):
            self.out.append(text)

    def flush(self) -> None:
        if self.pending:
            self.emit(self.pending)
            self.previous, self.pending = self.pending, ""

    def add(self, block: dict) -> None:
        value = block["text"]
        if not self.fits(value):
            self.flush()
            self._split(value, block["kind"] == "code")
            return
        if self.pending and (not self.fits(f"{self.pending}\n\n{value}") or self.c.count(self.compose(self.pending)) >= self.target):
            self.flush()
        self.pending = f"{self.pending}\n\n{value}" if self.pending else self.joined(value)

    def _rest(self, value: str, at: int) -> str:
        """The text from `at` on, or a part of it that is too long to fit, too; empty for blanks."""
        if not hasattr(self.c, "spans"):
            return value[at:] if value[at:].strip() else ""
        near = list(islice(self.c.spans(value, at), self.limit + 1))
        if len(near) > self.limit:
            return value[at : near[-1][1]]
        return value[at:] if near else ""

    def _split(self, value: str, code: bool) -> None:
        at = 0
        while rest := self._rest(value, at):
            if self.fits(rest):
                self.pending = self.joined(rest)
                return
            piece = self._head(rest, self.target, self.compose)
            if not piece:
                raise ValueError("no token of the text fits beside its headings")
            if code and "\n" in piece:
                piece = piece[: piece.rindex("\n") + 1]
            self.emit(self.joined(piece))
            self.previous, at = piece, at + len(piece)


def structured(text: str | None, blocks: list[dict] | None = None, target: int = 200, most: int = 300, overlap: int = 40, counter=None) -> list[tuple[list[str], str, int]]:
    """(headings, text, tokens) of each chunk."""
    counter = counter or SpaceCounter()
    if target < 1 or most < 1 or overlap < 0 or target > most or overlap >= target:
        raise ValueError("0 <= overlap < target <= most is required")
    if not (text or "").strip():
        return []
    limit = min(most, counter.model_limit)
    target = min(target, limit)
    if overlap >= target or limit <= counter.count(""):
        raise ValueError("the settings leave no room for text")
    out = []
    for headings, body in _sections(paragraphs(text) if blocks is None else blocks):
        pack = _Packer(counter, headings, limit, target, overlap)
        whole = "\n\n".join(b["text"] for b in body)
        if pack.fits(whole):
            pack.emit(whole)
        else:
            for block in body:
                pack.add(block)
            pack.flush()
        out += [(headings, chunk, counter.count(chunk)) for chunk in pack.out]
    return out


def structured_chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text", blocks: str | None = None, counter=None, **settings: int) -> DataFrame:
    """doc, chunk_index, heading_path, token_count, text. `blocks`: a column as html_extract makes; without it, paragraphs of the text."""
    slim = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), (F.col(blocks) if blocks else F.lit(None).cast("array<struct<kind:string,text:string,level:int,ordered:boolean>>")).alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            at, rows = [], []
            for k, (t, given) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                made = structured(t, given, counter=counter, **settings)
                rows += [(i, h, n, c) for i, (h, c, n) in enumerate(made)]
                at += [k] * len(made)
            parts = list(zip(*rows, strict=True)) or [()] * 4
            columns = [pa.array(v, kind) for v, kind in zip(parts, (pa.int32(), pa.list_(pa.string()), pa.int32(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns], names=["doc", "chunk_index", "heading_path", "token_count", "text"])

    return slim.mapInArrow(run, f"doc {slim.schema['doc'].dataType.simpleString()}, chunk_index int, heading_path array<string>, token_count int, text string")
