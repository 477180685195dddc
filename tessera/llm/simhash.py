"""SimHash near-dedup: Golay-code fuzzy keys over fingerprint segments.

A 64-bit fingerprint falls into segments of 22, 21 and 21 bits. Of two fingerprints at most two
bits apart, at least one segment is equal (pigeonhole) and the segment after it differs in two bits
at most. A segment, padded to 23 bits, is decoded with the perfect binary Golay code: its keys are
the codewords within distance 4 (one, or six for words at distance 3). Two words at most two bits
apart always share such a codeword: the one nearest to a word halfway between them. So the keys
(segment number, equal segment, codeword of the next segment) find every link; each is verified.

A key that more than HOT fingerprints share is not paired: its fingerprints emit themselves and
their 64 one-bit neighbours. Two fingerprints are at most two bits apart just if these balls meet,
and at most 65 fingerprints lie in a ball, all linked with each other: an exact way, linear in rows.

Null text counts as empty; texts without words have fingerprint zero and link like any other.
Repeated rows stay; a null id never becomes a component's id unless all its ids are null. An empty table
gives an empty result; other columns do not matter. Texts of any length are read whole. Ties of the
smallest id are copies of one id. Fingerprints with very many copies meet their class by broadcast.

keep_one, the pipeline's stage, takes the same steps with five-word shingles: fingerprints, Golay keys, links of at most
two bits, components. It adds the exact likeness of each link, and a search for the near copies that lie further apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, drop_stash, join_hot, read_table, spare, stash
from .linededup import BITS, bit_table, maybe_in

SHINGLE, SEED, HOT = 3, 42, 32
#: Near copies of keep_one: words of a shingle, and the least Jaccard likeness as a fraction.
STAGE_SHINGLE, LIKE = 5, (4, 5)
#: Texts that a task of keep_one remembers to skip copies of.
SEEN = 100_000
#: Frequent shingles are looked for in one text of so many.
PART = 8
#: (shift, bits) of the three segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = [b" ".join(g) for g in zip(*(words[k:] for k in range(shingle)), strict=False)]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(g, SEED) for g in grams], dtype=np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed 64-bit integer."""
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(h), 255):  # 64 bytes for each shingle of a slice, sums of one byte
        ones += np.unpackbits(h[lo : lo + 255].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.uint8)
    ones = ones * 2 > len(h)
    return int(np.packbits(ones).view(">u8")[0].astype(np.int64))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], names=["doc_id", "fp"])

    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp long")


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of all 23-bit words, by two tables of 12 and 11 bits, and for each syndrome the six errors to undo (the first is the nearest; those with one codeword in reach repeat it)."""

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    unit = [syndrome(1 << k) for k in range(23)]
    low = np.zeros(1 << 23, dtype=np.int16)
    for k in range(23):
        low[1 << k : 2 << k] = low[: 1 << k] ^ unit[k]
    errors = np.zeros((2048, 6), dtype=np.int64)
    filled = np.zeros(2048, dtype=int)
    for weight in range(4):
        for places in combinations(range(23), weight):
            s = e = 0
            for k in places:
                s, e = s ^ unit[k], e | 1 << k
            errors[s], filled[s] = e, 6 if weight < 3 else 1
    for places in combinations(range(23), 4):
        s = e = 0
        for k in places:
            s, e = s ^ unit[k], e | 1 << k
        if filled[s] < 6:
            errors[s, filled[s]] = e
            filled[s] += 1
    return low, errors


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords near each 23-bit word."""
    syndromes, errors = _golay()
    return (words[:, None] ^ errors[syndromes[words]]) >> 11  # systematic: the upper 12 bits


def segment_keys(fp: np.ndarray) -> np.ndarray:
    """(n, 18) keys of each fingerprint; some repeat."""
    u = fp.astype(np.uint64)
    seg = [((u >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    near = [codeword_indices(x) for x in seg]
    return np.concatenate([(np.int64(i) << 40) | (seg[i][:, None] << 12) | near[(i + 1) % 3] for i in range(3)], axis=1)


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(u, v): linked fingerprints; all links are implied by paths in it. `fps(fp long)` is distinct."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            k = np.sort(segment_keys(fp), axis=1)
            first = np.concatenate([np.ones((len(k), 1), bool), k[:, 1:] != k[:, :-1]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(k[first]), pa.array(np.repeat(fp, first.sum(axis=1)))], names=["key", "fp"])

    keyed = fps.select("fp").mapInArrow(keys, "key long, fp long")
    sized = stash(keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1"), "golay-keys")
    few = sized.where(F.col("n") <= hot)
    a, b = few.select("key", F.col("fp").alias("u")), few.select("key", F.col("fp").alias("v"))
    pairs = a.join(b, "key").where("u > v AND bit_count(u ^ v) <= 2").select("u", "v")

    many = sized.where(F.col("n") > hot).select("fp").distinct()
    ball = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    balls = many.select("fp", F.explode(ball).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("center"))
    least = balls.groupBy("center").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = balls.join(least, "center").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.union(stars).distinct()


def classes(prints: DataFrame) -> DataFrame:
    """prints(doc_id, fp) with component_id: the smallest doc_id reachable over links, and class_fp, the same fingerprint for all of a component."""
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    roots = stash(connected_components(links(firsts.select("fp"))), "simhash-roots").withColumnRenamed("node", "fp")
    linked = roots.join(firsts, "fp")
    smallest = linked.groupBy("root").agg(F.min("first").alias("smallest"))
    linked = linked.join(smallest, "root").select("fp", "root", "smallest")
    by_fp = firsts.join(linked, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component_id"), F.coalesce("root", "fp").alias("class_fp"), "n")
    return join_hot(prints, stash(by_fp, "simhash-classes"), ["fp"], "n")


def shingle_hashes(text: str | None, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """Hashes of the shingles of one text, repeats included; a text of fewer words has one shingle, a text without none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), dtype=np.uint64, count=len(words))
    k = min(shingle, len(h))
    mixed = np.full(max(len(h) - k + 1, 0) if k else 0, k, dtype=np.uint64)
    for i in range(k):
        mixed = (mixed ^ h[i : i + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def shingle_set(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """The id of a set of shingles, and the set in ascending order."""
    import xxhash

    own = np.unique(hashes.view(np.int64))
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).astype(np.int64)), own


def prefix_length(n: int) -> int:
    """Two sets of Jaccard likeness >= LIKE share one of so many first elements of theirs, in any one order of all elements."""
    num, den = LIKE
    return n + (-n * num // den) + 1


def parities(own: np.ndarray) -> np.ndarray:
    """Bits, one or two an element (a power of two): each says whether an odd number of elements fall on it.

    An element that only one of two sets has flips one bit, so no more bits differ than elements. Twice as many bits
    fold into the fewer by an exclusive or of their halves.
    """
    many = 1 << max(6, len(own).bit_length())
    odd = np.bincount((own.view(np.uint64) >> np.uint64(20) & np.uint64(many - 1)).astype(np.int64), minlength=many) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def may_be_alike(na: str, nb: str, a: str, b: str) -> Column:
    """True of all sets of Jaccard likeness >= LIKE: sizes agree, and no more bits of their parities differ than elements may."""
    num, den = LIKE

    def folded(x: str, other: str) -> str:
        return f"if(size({x}) <= size({other}), {x}, zip_with(slice({x}, 1, size({other})), slice({x}, size({other}) + 1, size({other})), (x, y) -> x ^ y))"

    apart = f"aggregate(zip_with({folded(a, b)}, {folded(b, a)}, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)"
    return F.expr(f"{den} * least({na}, {nb}) >= {num} * greatest({na}, {nb}) and {num + den} * {apart} <= {den - num} * ({na} + {nb})")


def shingle_prints(texts: DataFrame) -> DataFrame:
    """doc_id, th, n (shingles in the set), set_id, fp (SimHash of the shingles), odd (parities) for every row of texts(doc_id, th, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ids, fps, odd = [], [], [], []
            for t in b.column(2):
                h = shingle_hashes(t.as_py())
                set_id, own = shingle_set(h)
                n.append(len(own))
                ids.append(set_id)
                fps.append(majority(h))
                odd.append(parities(own))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(ids, pa.int64()), pa.array(fps, pa.int64()), pa.array(odd, pa.list_(pa.int64()))],
                names=["doc_id", "th", "n", "set_id", "fp", "odd"],
            )

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, th long, n int, set_id long, fp long, odd array<long>")


def _bits(df: DataFrame, of: str) -> np.ndarray:
    """bit_table() on the driver: 2^BITS bits whatever the size of df."""
    got, out = bit_table(df, of).toArrow(), np.zeros(1 << (BITS - 6), dtype=np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _in_bits(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = values.view(np.uint64) & np.uint64((1 << BITS) - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)


def prefix_keys(texts: DataFrame, late: np.ndarray | None = None, only: np.ndarray | None = None) -> DataFrame:
    """key, set_id: the first shingles (prefix_length) of the set of every text of texts(th, text).

    The order is by hash, those in the bits `late` behind all others. `only`: bits of the keys wanted. A task remembers
    the last SEEN texts and gives the keys of copies once; some are given again.
    """
    context = texts.sparkSession.sparkContext
    late, only = (None if x is None else context.broadcast(x) for x in (late, only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part, keys, ids = b.slice(lo, 1000), [], []
                for i, th in enumerate(part.column(0).to_pylist()):
                    if th in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(th)
                    set_id, own = shingle_set(shingle_hashes(part.column(1)[i].as_py()))
                    if not len(own):
                        continue
                    most = prefix_length(len(own))
                    if late is not None:
                        behind = _in_bits(late.value, own)
                        own = np.concatenate([own[~behind], own[behind]])
                    own = own[:most]
                    if only is not None:
                        own = own[_in_bits(only.value, own)]
                    keys.append(own)
                    ids.append(np.full(len(own), set_id, dtype=np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], names=["key", "set_id"])

    return texts.select("th", "text").mapInArrow(run, "key long, set_id long")


def alike(texts: DataFrame, firsts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs(u, v) of set ids whose Jaccard likeness is LIKE or more.

    Parities, one or two bits an element, throw most of the others out; then the sets that stand in a pair are moved, from one text of each.
    """
    num, den = LIKE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for i, th in enumerate(b.column(0).to_pylist()):
                if th in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(th)
                set_id, own = shingle_set(shingle_hashes(b.column(1)[i].as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([set_id], pa.int64()), pa.array([own], pa.list_(pa.int64()))], names=["set_id", "sigs"])

    sized = [firsts.select(F.col("set_id").alias(x), F.col("n").alias(f"n{x}"), F.col("odd").alias(f"odd_{x}")) for x in "uv"]
    pairs = stash(pairs.select("u", "v").distinct().join(sized[0], "u").join(sized[1], "v").where(may_be_alike("nu", "nv", "odd_u", "odd_v")).select("u", "v"), "near-pairs")
    ends = stash(firsts.join(pairs.select(F.explode(F.array("u", "v")).alias("set_id")).distinct(), "set_id", "left_semi").select("set_id", F.col("first.th").alias("th")), "near-ends")
    some = maybe_in(texts.select("th", "text"), "th", bit_table(ends, "th")).mapInArrow(run, "set_id long, sigs array<long>")
    sets = stash(some.join(ends, "set_id", "left_semi").dropDuplicates(["set_id"]), "near-sets")
    both = pairs.join(sets.select(F.col("set_id").alias("u"), F.col("sigs").alias("a")), "u").join(sets.select(F.col("set_id").alias("v"), F.col("sigs").alias("b")), "v")
    same = F.size(F.array_intersect("a", "b"))
    out = stash(both.where(den * same >= num * (F.size("a") + F.size("b") - same)).select("u", "v"), "near-links")
    for done in (pairs, ends, sets):
        drop_stash(done)
    return out


def near_links(texts: DataFrame, firsts: DataFrame, linked: DataFrame, hot: int = HOT) -> DataFrame:
    """(u, v): set ids linked by Jaccard likeness >= LIKE; all such links are implied by paths in it. `linked`: some that are known.

    Exact: in any one order of all shingles, two sets that alike share one of their first n // 5 + 1. The order is
    by hash, but shingles that are frequent there (in one text of PART, those of more than hot / PART), and some that share their bits, come last. Sets
    already linked are not compared. Where more than `hot` share one, each is first compared with one of them, and then
    only those of different components with each other. Keys are read from the texts each time, never kept.
    """

    def shared(some: DataFrame, late: np.ndarray | None, least: int = 0) -> DataFrame:
        keyed = prefix_keys(some, late).groupBy("key").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi"), F.count(F.lit(1)).alias("n"))
        return stash(keyed.where(f"lo <> hi and n > {least}").select("key"), "near-shared")

    def across(members: DataFrame, links: DataFrame) -> DataFrame:
        """key, set_id, root, size: members of the keys that lie in several components."""
        roots = connected_components(links).withColumnRenamed("node", "set_id")
        by_key = Window.partitionBy("key")
        rooted = members.join(roots, "set_id", "left").select("key", "set_id", F.coalesce("root", "set_id").alias("root"))
        rooted = rooted.withColumn("lo", F.min("root").over(by_key)).withColumn("hi", F.max("root").over(by_key)).withColumn("size", F.count(F.lit(1)).over(by_key))
        return stash(rooted.where("lo <> hi").select("key", "set_id", "root", "size"), "near-members")

    def crossing(rows: DataFrame) -> DataFrame:
        a, b = (rows.select("key", F.col("set_id").alias(x), F.col("root").alias(f"r{x}")) for x in "uv")
        return a.join(b, "key").where("u > v and ru <> rv").select("u", "v")

    frequent = shared(texts.where(f"pmod(th, {PART}) = 0"), None, hot // PART)
    late = _bits(frequent, "key") if frequent.take(1) else None
    keys = shared(texts, late)
    members = stash(prefix_keys(texts, late, _bits(keys, "key")).join(keys, "key", "left_semi").distinct(), "near-keyed")
    drop_stash(keys)

    first = across(members, linked)
    many = first.where(F.col("size") > hot)
    hub = F.first("set_id").over(Window.partitionBy("key").orderBy("set_id"))
    stars = many.select(F.col("set_id").alias("u"), hub.alias("v")).where("u <> v")
    found = linked.union(alike(texts, firsts, crossing(first.where(F.col("size") <= hot)).union(stars)))
    if len(many.take(1)):
        found = found.union(alike(texts, firsts, crossing(across(many.select("key", "set_id"), found))))
    return found


def print_links(texts: DataFrame, firsts: DataFrame) -> DataFrame:
    """(u, v): sets of Jaccard likeness >= LIKE among those whose fingerprints are linked by Golay keys (see links) or equal."""
    worded = firsts.where("n > 0").select("set_id", "fp")
    hubs = stash(worded.groupBy("fp").agg(F.min("set_id").alias("hub"), F.count(F.lit(1)).alias("sets")), "near-hubs")
    equal = join_hot(worded, hubs, ["fp"], "sets").where("set_id <> hub").select(F.col("set_id").alias("u"), F.col("hub").alias("v"))
    ends = [hubs.select(F.col("fp").alias(x), F.col("hub").alias(f"hub_{x}")) for x in "uv"]
    close = links(hubs.select("fp")).join(ends[0], "u").join(ends[1], "v").select(F.greatest("hub_u", "hub_v").alias("u"), F.least("hub_u", "hub_v").alias("v"))
    return alike(texts, firsts, equal.union(close))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group of near copies: one with the smallest id (null only if all are).

    Near copies have five-word shingles of Jaccard likeness 0.8 or more, or are linked by such. SimHash fingerprints of
    these shingles and their Golay keys give the first links, each verified. Most near copies differ in 3 to 9 bits,
    too many for keys; near_links finds the rest. Texts, and not sets, are read again for each step; no set is kept on
    disk but those of candidate pairs. Only rows that may go, or are repeated, meet the list of those that stay.
    """
    text = F.col(text_col).cast("string")
    slim = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    prints = stash(shingle_prints(slim), "near-prints")
    firsts = stash(prints.groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.first("odd").alias("odd")), "near-firsts")
    near = near_links(slim, firsts, print_links(slim, firsts))
    roots = stash(connected_components(near), "near-roots").withColumnRenamed("node", "set_id")
    kept = firsts.join(roots, "set_id", "left").groupBy(F.coalesce("root", "set_id").alias("root")).agg(F.min("first").alias("k"))
    own, kept_id, kept_th, word, bits, at = spare(df, "own", "kept_id", "kept_th", "word", "bits", "at")
    kept = stash(kept.select(F.col("k.doc_id").alias(kept_id), F.col("k.th").alias(kept_th)), "near-kept")

    rows = prints.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    stays = kept.withColumnsRenamed({kept_id: "k", kept_th: "t"}).withColumn("stays", F.lit(True))
    looked = rows.join(stays, rows["doc_id"].eqNullSafe(stays["k"]) & (F.col("th") == F.col("t")), "left").where("stays is null or n > 1")
    table = stash(bit_table(looked.select(F.xxhash64("doc_id", "th").alias("at")), "at"), "near-looked").withColumnsRenamed({"word": word, "bits": bits})
    drop_stash(prints)

    low = F.col(at).bitwiseAND((1 << BITS) - 1)
    marked = df.withColumn(own, F.xxhash64(text)).withColumn(at, F.xxhash64(id_col, own)).withColumn(word, F.shiftright(low, 6))
    marked = marked.join(F.broadcast(table), word, "left").withColumn(bits, F.coalesce(F.expr(f"shiftright(`{bits}`, cast({at} & 63 as int)) & 1"), F.lit(0)))  # bounded by 2^BITS / 64 rows
    rest = marked.where(F.col(bits) == 1).join(kept, (F.col(own) == F.col(kept_th)) & F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
    return marked.where(F.col(bits) == 0).select(*df.columns).union(rest.dropDuplicates([id_col, own]).select(*df.columns))


def op9_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = stash(fingerprints(read_table(spark, sf_dir, "documents")), "simhash")
    return classes(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
