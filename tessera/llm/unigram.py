"""A unigram lattice over the pieces of a SentencePiece model, and token counts over a shared trie.

The model file given here is of the BPE kind; its merges are no shortest path. These operators read
its pieces and their stored scores as a unigram model, as the sentencepiece library does with the
same file once its model type is set to unigram: the segmentation with the largest score sum; a
character outside the vocabulary costs the smallest score less 10 and becomes its UTF-8 bytes' pieces.
Scores are whole numbers, so sums are exact. Ties: the longer last piece.

Token counts: distinct pre-tokens of a batch are visited in sorted order, a walk of their trie. The
forward score of a prefix is computed once and shared by all words below it; a terminal keeps its
token count. Only pieces of the meta symbol alone hold it past their first place, so a pre-token is
a run of spaces with the word after it, and counts add up over pre-tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold_memo, read_table

META, MEMO = "▁", 400_000
#: Characters of texts that are counted together, and the longest word that is remembered.
SLICE, LONG = 1 << 21, 200
PIECES = "piece_bpe_32k.model"
_WORD = re.compile(f"{META}+[^{META}]*|[^{META}]+")


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    """Where to look for keys first in a table of a power of two."""
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - (size - 1).bit_length())).astype(np.int64)


class Lattice:
    """Pieces and scores of a model file (bytes of a SentencePiece model)."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids, self.pieces, self.bytes = {}, [sp.id_to_piece(i) for i in range(sp.get_piece_size())], [0] * 256
        self.scores = [int(sp.get_score(i)) for i in range(sp.get_piece_size())]
        self.unk = sp.unk_id()
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.ids[p] = i
        self.byte_ids, self._raw, self.counts = set(self.bytes), None, {}
        self.longest = max(map(len, self.ids))
        self.unk_score = min((self.scores[i] for i in self.ids.values()), default=0) - 10
        self.trie: dict = {}
        for p, i in self.ids.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""], node["id"] = self.scores[i], i
        self.raw_ids = [i.to_bytes(4, "little") for i in range(len(self.pieces))]
        self._arrays = None

    @staticmethod
    def normalize(text: str) -> str:
        """What the model's normalizer gives: a space before the text, spaces as the meta symbol."""
        return META + text.replace(" ", META) if text else ""

    def has_bytes(self, ids: list[int]) -> bool:
        return not self.byte_ids.isdisjoint(ids)

    def raw_pieces(self) -> list[bytes]:
        """What each id stands for, as UTF-8 bytes."""
        if self._raw is None:
            self._raw = [p.encode("utf-8") if p in self.ids else b"" for p in self.pieces]
            for b, i in enumerate(self.bytes):
                self._raw[i] = bytes([b])
        return self._raw

    def unknown_ids(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "replace")]

    def best(self, word: str) -> tuple[int, list[int]]:
        """The best score and ids of a string."""
        n = len(word)
        score, back = self.forward(word, n, {0: 0}, n)
        out, j = [], n
        while j:
            piece = word[back[j] : j]
            i = self.ids.get(piece)
            out.append([i] if i is not None else self.unknown_ids(piece))
            j = back[j]
        return score[n], [i for part in reversed(out) for i in part]

    def trie_counts(self, words: Iterable[str]) -> dict[str, int]:
        """The token count of each word: forward scores of a prefix are computed once."""
        out, root, known, unk_score = {}, self.trie, self.ids, self.unk_score
        score, count, alive = [0], [0], [[(root, 0, 0)]]  # by depth; alive: piece-trie nodes with the score and count before them
        last = ""
        for word in sorted(set(words)):
            keep = 0
            for a, b in zip(word, last, strict=False):
                if a != b:
                    break
                keep += 1
            del score[keep + 1 :], count[keep + 1 :], alive[keep + 1 :]
            for c in word[keep:]:
                best, many, going = None, 0, []
                for node, s, k in alive[-1]:
                    if (to := node.get(c)) is not None:
                        going.append((to, s, k))
                        if (own := to.get("")) is not None and (best is None or s + own > best):
                            best, many = s + own, k + 1
                if c not in known and (best is None or score[-1] + unk_score > best):
                    best, many = score[-1] + unk_score, count[-1] + len(c.encode("utf-8", "replace"))
                going.append((root, best, many))
                score.append(best)
                count.append(many)
                alive.append(going)
            out[word] = count[-1]
            last = word
        return out


    def trie_ids(self, words: Iterable[str]) -> dict[str, tuple[bytes, int]]:
        """The ids (bytes of int32) and score of each word; prefixes are shared as in trie_counts. Keeps back pointers, not paths."""
        out, root, known, unk_score = {}, self.trie, self.ids, self.unk_score
        raw = self.raw_ids
        score, back, alive = [0], [(0, b"")], [[(root, 0, 0)]]  # back: where the last piece starts, and its ids
        last = ""
        for word in sorted(set(words)):
            keep = 0
            for a, b in zip(word, last, strict=False):
                if a != b:
                    break
                keep += 1
            del score[keep + 1 :], back[keep + 1 :], alive[keep + 1 :]
            for c in word[keep:]:
                best, link, going = None, None, []
                for node, s, at in alive[-1]:
                    if (to := node.get(c)) is not None:
                        going.append((to, s, at))
                        if (own := to.get("")) is not None and (best is None or s + own > best):
                            best, link = s + own, (at, raw[to["id"]])
                depth = len(score)
                if c not in known and (best is None or score[-1] + unk_score > best):
                    best, link = score[-1] + unk_score, (depth - 1, b"".join([raw[i] for i in self.unknown_ids(c)]))
                going.append((root, best, depth))
                score.append(best)
                back.append(link)
                alive.append(going)
            parts, j = [], len(word)
            while j:
                j, piece = back[j]
                parts.append(piece)
            out[word] = b"".join(reversed(parts)), score[-1]
            last = word
        return out

    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The trie as arrays: a hash table (keys: node and character; -1 is free), the nodes it leads to, each node's piece or -1, each piece's score."""
        if self._arrays is None:
            keys, ends, nodes = [], [-1], [self.trie]
            for at, node in enumerate(nodes):
                for c, to in node.items():
                    if isinstance(to, dict):
                        keys.append((at << 21 | ord(c), len(nodes)))
                        nodes.append(to)
                        ends.append(to.get("id", -1))
            size = 1 << (4 * len(keys) + 16).bit_length()
            table, goes = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
            for (key, to), slot in zip(keys, _slots(np.array([k for k, _ in keys], dtype=np.int64), size).tolist(), strict=True):
                while table[slot] != -1:
                    slot = (slot + 1) % size
                table[slot], goes[slot] = key, to
            self._arrays = table, goes, np.array(ends, dtype=np.int64), np.array(self.scores, dtype=np.int64)
        return self._arrays

    def _steps(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The trie nodes that these nodes reach with these characters, or -1."""
        table, goes, _, _ = self._tables()
        keys = nodes << 21 | codes
        slots = _slots(keys, len(table))
        found = table[slots]
        out = np.where(found == keys, goes[slots], -1)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            slots[left] = (slots[left] + 1) % len(table)
            found = table[slots[left]]
            hit = found == keys[left]
            out[left[hit]] = goes[slots[left[hit]]]
            left = left[~hit & (found != -1)]
        return out

    def all_ids(self, words: Iterable[str]) -> dict[str, tuple[bytes, int]]:
        """What trie_ids gives of words that are not empty, for all at once: pieces from every place first, then best scores by place in the word, then paths."""
        words = list(words)
        if not words:
            return {}
        _, _, piece_of, score_of = self._tables()
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        start, end = np.repeat(starts, sizes), np.repeat(ends, sizes)  # of the word that a character stands in
        at, node, found = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64), []
        alone = np.zeros(len(codes), dtype=bool)
        for size in range(1, self.longest + 1):
            node = self._steps(node, codes[at + size - 1])
            at, node = at[node >= 0], node[node >= 0]
            piece = piece_of[node]
            own = piece >= 0
            found.append((at[own], np.full(np.count_nonzero(own), size), piece[own]))
            if size == 1:
                alone[at[own]] = True
            on = at + size < end[at]
            at, node = at[on], node[on]
            if not len(at):
                break
        unknown = np.flatnonzero(~alone)
        found.append((unknown, np.full(len(unknown), 1), np.full(len(unknown), -1)))
        first, size, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        last = first + size - 1
        place = last - start[last]
        order = np.argsort(last, kind="stable")
        order = order[np.argsort(place[order].astype(np.int16 if sizes.max() < 1 << 15 else np.int64), kind="stable")]
        first, size, piece, last, place = (x[order] for x in (first, size, piece, last, place))
        add, bits = np.where(piece >= 0, score_of[piece], self.unk_score), self.longest.bit_length()
        opens = first == start[first]
        best, back, chosen = (np.zeros(len(codes), dtype=np.int64) for _ in range(3))
        bounds = np.searchsorted(place, np.arange(place[-1] + 2)).tolist()
        for lo, hi in zip(bounds, bounds[1:], strict=False):  # a word's characters in order; the same place of all words at once
            score = np.where(opens[lo:hi], 0, best[first[lo:hi] - 1]) + add[lo:hi]
            key = (score << bits) + size[lo:hi]  # of equal scores the longer piece
            to = last[lo:hi]
            new = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            top = np.maximum.reduceat(key, new)
            won = np.flatnonzero(key == np.repeat(top, np.diff(np.append(new, hi - lo))))
            best[to[new]] = top >> bits
            back[to[new]] = size[lo:hi][won]
            chosen[to[new]] = piece[lo:hi][won]
        on_path, at = np.zeros(len(codes), dtype=bool), ends - 1
        while len(at):
            on_path[at] = True
            before = at - back[at]
            at = before[before >= start[at]]
        path = np.flatnonzero(on_path)
        ids, many = chosen[path], np.ones(len(path), dtype=np.int64)
        odd = {k: self.unknown_ids(chr(codes[path[k]])) for k in np.flatnonzero(ids < 0).tolist()}
        if odd:
            many[list(odd)] = [len(x) for x in odd.values()]
            ids = np.repeat(ids, many)
            for lo, x in zip((np.cumsum(many) - many)[list(odd)].tolist(), odd.values(), strict=True):
                ids[lo : lo + len(x)] = x
        counts = np.zeros(len(codes), dtype=np.int64)
        counts[path] = many
        raw, stops = ids.astype("<i4").tobytes(), (4 * np.cumsum(np.add.reduceat(counts, starts))).tolist()
        return {w: (raw[lo:hi], s) for w, lo, hi, s in zip(words, [0, *stops], stops, best[ends - 1].tolist(), strict=False)}

    def forward(self, text: str, n: int, entry: dict[int, int], core: int) -> tuple[list, list[int]]:
        """Scores and back pointers of the places up to n, from `entry` scores, over pieces that start before core.

        A back pointer is the start of the last piece, or -1 where the entry's score stands.
        """
        score: list = [None] * (n + 1)
        back = [-1] * (n + 1)
        for at, s in entry.items():
            score[at] = s
        known, unk_score = self.ids, self.unk_score
        for i in range(min(core, n)):
            if (at := score[i]) is None:
                continue
            node, j = self.trie, i
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                if (s := node.get("")) is not None and (score[j] is None or at + s > score[j]):
                    score[j], back[j] = at + s, i
            if text[i] not in known and (score[i + 1] is None or at + unk_score > score[i + 1]):
                score[i + 1], back[i + 1] = at + unk_score, i
        return score, back

    def best_bytes(self, word: str) -> tuple[bytes, int]:
        score, ids = self.best(word)
        return b"".join([self.raw_ids[i] for i in ids]), score


_lattices: dict[int, Lattice] = {}


def lattice(model: bytes) -> Lattice:
    """One for each Python worker."""
    key = hash(model)
    if key not in _lattices:
        _lattices[key] = Lattice(model)
    return _lattices[key]


def forget_lattices() -> None:
    _lattices.clear()


def pre_tokens(text: str) -> list[str]:
    return _WORD.findall(text)


def token_counts(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens for every row, in its own partition: no shuffle.

    Null and empty texts have no tokens. Repeated rows count each, null ids too; an empty table gives an
    empty result. Texts of any length are counted whole; words of over LONG characters are not remembered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memo("token counts", forget_lattices)
        lat = lattice(model)
        memo = lat.counts
        for b in batches:
            counts, lo = [], 0
            while lo < b.num_rows:
                docs, seen = [], 0
                while lo < b.num_rows and seen < SLICE:
                    text = b.column(1)[lo].as_py() or ""
                    docs.append(pre_tokens(lat.normalize(text)))
                    seen, lo = seen + len(text) + 64, lo + 1
                if len(memo) > MEMO:
                    memo.clear()
                new = set().union(*docs).difference(memo)
                long = {w: len(lat.best(w)[1]) for w in new if len(w) > LONG}
                memo.update(lat.trie_counts(new.difference(long)))
                find = {**memo, **long} if long else memo
                counts += [sum(map(find.__getitem__, words)) for words in docs]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def model_bytes(path: str | None = None) -> bytes:
    import public_tokenizers

    with open(path or public_tokenizers.path(PIECES), "rb") as f:
        return f.read()


def op6_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), model_bytes())
