"""Line dedup: exact classes and a segment-partition edit join, DataFrame functions only.

A line (white space trimmed, of `least` characters or more) goes if an equal line, or one within its
allowed edits, stands earlier in the corpus, in the order of (doc_id, line number). Allowed edits are 0
below MIN_CHARS characters, 1 up to SHORT and TAU = 2 from there, by the shorter line of a pair. The
query and the pipeline take all lines that are not blank (least=1).

The edit join: a line is split into edits + 1 even segments; within the allowed edits another line
has one of them unchanged, near its place. Index keys are (length, segment number, segment hash);
a line probes the keys of all lengths down to its own less TAU, at the places that the multi-match
rule leaves. Keys with one line on them are found by a combined minimum and maximum, so no key is
gathered in one task; only lines that touch a live key go on. A fixed table of bits (at most
2^BITS / 64 rows) keeps most of the others out of the shuffles; it never decides by itself.

Only whether an earlier near line exists is wanted. So the lines of a key are compared with its
earliest REPS lines first, those found late leave, the rest meet the next lines of the key, in steps
that grow, until each line left has met every earlier line on its keys: no pair is left out, and a
group of near copies costs about one comparison a line. Pairs whose counts of common letters differ by more
than their edits allow are left out inside the join (an edit moves at most one count up and one down). Others pass the built-in
bounded `levenshtein`, and what is left is verified by a banded bit-parallel edit distance: bit sets over the
2 TAU + 1 diagonals for 0, 1 and TAU edits.

Null text has no lines. Lines below `least` and blank lines always stay. Rows with equal id and text count as
one document and get the same result. A null id is last in the corpus order. Lines of one place (rows with
equal id, other text) are ordered by their hash. An empty table gives an empty result; other columns keep their
names whatever they are. Very long lines are compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_hot, read_table, spare, stash

MIN_CHARS, SHORT, TAU = 20, 40, 2
LAST = (1 << 63) - 1
#: Lines of a key that are compared first (times GROW a step), and the size of the table of bits.
REPS, GROW, BITS = 4, 8, 26
#: Letters that are counted one by one to tell lines apart before they are verified; other letters are not looked at.
LETTERS = "etaonisrhldugmcfpybvwkz"
BLANKS = " \t\r\f\x0b"


def lines_of(df: DataFrame, id_col: str, text_col: str, least: int = MIN_CHARS) -> DataFrame:
    """doc_id (null: LAST), th, no, line of all lines that count."""
    text = F.col(text_col).cast("string")
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).alias("th"), F.posexplode_outer(F.split(text, "\n")).alias("no", "line"))
    return rows.withColumn("line", F.btrim("line", F.lit(BLANKS))).where((F.char_length("line") >= least) & F.col("line").rlike(r"\S"))


def key_rules() -> list[dict[str, int]]:
    """Every (tau, delta, segment, shift) at which a line meets an index key; index: whether it is its own."""
    rules = []
    for tau in (1, TAU):
        for delta in range(tau + 1):
            for i in range(1, tau + 2):
                # multi-match rule: shifts allowed from the left by i - 1 edits and from the right by tau + 1 - i
                low, high = max(-(i - 1), delta - (tau + 1 - i)), min(i - 1, delta + (tau + 1 - i))
                rules += [{"tau": tau, "delta": delta, "i": i, "shift": s, "index": int(delta == 0 and s == 0)} for s in range(low, high + 1)]
    return rules


def keys(rows: DataFrame) -> DataFrame:
    """key and index (true: the line's own index key) beside the columns of rows(line, len, ...) but the line.

    One small expression in a loop over the rules: an expression for each rule makes methods too large to compile.
    """
    every, short, long = (F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in r.items())) for r in key_rules() if r["tau"] in taus)) for taus in ((1, TAU), (1,), (TAU,)))
    rules = F.when(F.col("len") >= SHORT + TAU, long).when(F.col("len") < SHORT, short).otherwise(every)  # the others would be thrown out below
    more = [c for c in rows.columns if c not in ("line", "len")]
    each = rows.select(*more, "line", "len", F.explode_outer(rules).alias("r"))
    each = each.select(*more, "line", "len", "r.tau", "r.i", "r.shift", "r.index", (F.col("len") - F.col("r.delta")).alias("n"))  # n: the length of the indexed line
    each = each.where((F.col("n") >= MIN_CHARS) & ((F.col("n") >= SHORT) == (F.col("tau") == TAU)))
    k, i = F.col("tau") + 1, F.col("i")
    longer = F.expr("n % (tau + 1)")
    size = F.expr("n div (tau + 1)").cast("int") + F.when(longer > k - i, 1).otherwise(0)  # even segments, the longer ones last
    start = (F.expr("n div (tau + 1)").cast("int") * (i - 1) + F.greatest(F.lit(0), longer - (k - i + 1)) + F.col("shift")).cast("int")
    each = each.select(*more, "line", "len", "n", "tau", "i", "index", start.alias("at"), size.alias("size")).where("at >= 0 and at + size <= len")
    return each.select(*more, F.xxhash64("n", F.col("tau") * 10 + i, F.substring(F.col("line"), F.col("at") + 1, F.col("size"))).alias("key"), (F.col("index") == 1).alias("index"))


def _bit(of: str) -> tuple[Column, Column]:
    low = F.col(of).bitwiseAND((1 << BITS) - 1)
    return F.shiftright(low, 6), low.bitwiseAND(63).cast("int")


def bit_table(df: DataFrame, of: str) -> DataFrame:
    """(word, bits): a set of the low BITS bits of a hash, at most 2^BITS / 64 rows whatever the size of df."""
    word, bit = _bit(of)
    return df.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def maybe_in(df: DataFrame, of: str, table: DataFrame) -> DataFrame:
    """Rows of df whose hash may be in the table (all that are, and a few others)."""
    word, bit = _bit(of)
    both = df.withColumn("word", word).withColumn("bit", bit).join(F.broadcast(table), "word")  # bounded by 2^BITS / 64 rows
    return both.where("(shiftright(bits, bit) & 1) = 1").select(*df.columns)


def letter_counts(line: Column) -> Column:
    return F.struct(*((F.char_length(line) - F.char_length(F.translate(line, c, ""))).alias(c) for c in LETTERS))


def may_be_near(a: str, b: str) -> Column:
    """No more than TAU letters too many on either side: true of all lines within TAU edits."""

    def surplus(x: str, y: str) -> Column:
        return sum((F.greatest(F.col(f"{x}.{c}") - F.col(f"{y}.{c}"), F.lit(0)) for c in LETTERS), F.lit(0))

    return (surplus(a, b) <= TAU) & (surplus(b, a) <= TAU)


def within(a: Column, b: Column) -> Column:
    """Edits between two lines if at most TAU, else null: a banded bit-parallel distance.

    The state holds for e = 0 .. TAU edits the set of diagonals d (bit d + TAU) with D[i, i + d] <= e; a character of `a`
    moves all diagonals at once.
    """

    def shifted(v: Column, by: int) -> Column:
        return F.shiftleft(v, by) if by >= 0 else F.shiftright(v, -by)

    full = (1 << (2 * TAU + 1)) - 1
    start = F.struct(*(F.lit(sum(1 << (d + TAU) for d in range(e + 1))).alias(f"e{e}") for e in range(TAU + 1)))

    def step(ends: Column, acc: Column, i: Column) -> Column:
        c = F.get(ends["x"], i)
        same = sum((F.when(F.get(ends["y"], i + d) == c, 1 << (d + TAU)).otherwise(0) for d in range(-TAU, TAU + 1)), F.lit(0))
        row = F.struct(same.alias("m"), acc.alias("s"))

        def levels(r: Column) -> Column:
            now = [r["s"]["e0"].bitwiseAND(r["m"])]
            for e in range(1, TAU + 1):
                old, less = r["s"][f"e{e}"], r["s"][f"e{e - 1}"]
                now.append(old.bitwiseAND(r["m"]).bitwiseOR(less).bitwiseOR(shifted(less, -1)).bitwiseOR(shifted(now[-1], 1)).bitwiseAND(full))
            return F.struct(*(v.alias(f"e{e}") for e, v in enumerate(now)))

        return F.when(acc[f"e{TAU}"] == 0, acc).otherwise(F.get(F.transform(F.array(row), levels), F.lit(0)))  # too far apart already: nothing to do

    n, m = F.char_length(a), F.char_length(b)
    # transform over one element: what stands in it is computed once, not at every character
    ends = F.array(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"), F.sequence(F.lit(0), n - 1).alias("i")))
    last = F.transform(ends, lambda p: F.aggregate(p["i"], start, lambda acc, i: step(p, acc, i)))
    end = F.call_function("shiftleft", F.lit(1), m - n + TAU)
    edits = F.get(F.transform(last, lambda s: F.coalesce(*(F.when(s[f"e{e}"].bitwiseAND(end) != 0, e) for e in range(TAU + 1)))), F.lit(0))
    return F.when(F.abs(m - n) <= TAU, edits)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_CHARS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """places(doc_id, th, no, lid, lid2), firsts(lid, lid2, first, n) and late(lid, lid2): distinct lines with an earlier near line."""
    all_lines = lines_of(df, id_col, text_col, least)
    lid, lid2 = F.xxhash64("line").alias("lid"), F.xxhash64(F.lit(1), "line").alias("lid2")
    places = stash(all_lines.select("doc_id", "th", "no", lid, lid2, (F.char_length("line") >= MIN_CHARS).alias("long")), "line-places")
    firsts = stash(places.groupBy("lid", "lid2").agg(F.min(F.struct("doc_id", "no")).alias("first"), F.count(F.lit(1)).alias("n"), F.max("long").alias("long")), "line-firsts")
    long_lines = all_lines.where(F.char_length("line") >= MIN_CHARS).select(lid, "line", F.char_length("line").alias("len"))  # shorter ones have no near lines

    made = keys(long_lines.select("lid", "line", "len")).groupBy("key").agg(F.min("lid").alias("lo"), F.max("lid").alias("hi"), F.max("index").alias("index"))
    shared = stash(made.where("lo <> hi and index").select("key"), "line-shared")
    again = maybe_in(keys(long_lines), "key", bit_table(shared, "key")).distinct()
    live = stash(again.join(shared, "key").select("key", "lid", "index"), "line-keys")

    ends = live.select("lid").distinct()
    some = bit_table(ends, "lid")
    texts = maybe_in(long_lines.select("lid", "line"), "lid", some).groupBy("lid").agg(F.min("line").alias("line"))
    texts = stash(texts.join(ends, "lid", "left_semi"), "line-texts")
    where = maybe_in(firsts.where("long").select("lid", "first"), "lid", some).groupBy("lid").agg(F.min("first").alias("first"))
    where = where.join(texts.select("lid", letter_counts(F.col("line")).alias("c")), "lid")
    placed = live.groupBy("key", "lid").agg(F.max("index").alias("index")).join(where, "lid").select("key", F.struct("first", "lid").alias("at"), "index", "c")
    placed = stash(placed, "line-members")

    late, used, reps, rest = None, None, REPS, placed
    while True:
        comparers = placed if used is None else placed.join(used, "key", "left").where("last is null or at > last").select("key", "at", "index", "c")
        if used is not None:  # only keys that still have lines to be judged
            comparers = comparers.join(rest.groupBy("key").agg(F.max("at").alias("top")), "key").where("at < top").select("key", "at", "index", "c")
        place = F.row_number().over(Window.partitionBy("key").orderBy("at"))
        chosen = stash(comparers.withColumn("place", place).where(F.col("place") <= reps).select("key", "at", "index", "c"), "line-reps")
        if not chosen.take(1):
            break
        b = chosen.select("key", F.col("at").alias("other"), F.col("index").alias("other_index"), F.col("c").alias("other_c"))
        pairs = rest.join(b, "key").where(F.expr("other < at and (index or other_index)") & may_be_near("c", "other_c")).select(F.col("at.lid").alias("v"), F.col("other.lid").alias("u")).distinct()
        both = pairs.join(texts.select(F.col("lid").alias("u"), F.col("line").alias("a")), "u").join(texts.select(F.col("lid").alias("v"), F.col("line").alias("b")), "v")
        allowed = F.when(F.least(F.char_length("a"), F.char_length("b")) < SHORT, 1).otherwise(TAU)
        # the built-in distance, with its own bound, throws most of the far pairs out at a few steps each; both forms are exact
        near = F.when(F.levenshtein("a", "b", TAU) >= 0, within(F.col("a"), F.col("b")))
        found = both.where(near <= allowed).select(F.col("v").alias("lid"))
        now = stash(found.distinct(), "line-late")
        late = now if late is None else late.union(now)  # a line that is late is judged no more, so none comes twice
        last = chosen.groupBy("key").agg(F.max("at").alias("last"))
        used = stash(last if used is None else last.union(used).groupBy("key").agg(F.max("last").alias("last")), "line-used")
        # a line that is late is done, and on its key every line up to the last comparer: it has met all before it there
        open_keys = rest.join(used, "key", "left").where("last is null or at > last").select("key", "at", "index", "c")
        rest = stash(open_keys.join(now, open_keys["at.lid"] == now["lid"], "left_anti"), "line-rest")
        reps *= GROW
    return places, firsts, late if late is not None else ends.limit(0)


def dropped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_CHARS) -> DataFrame:
    """doc_id, th, no, near (the line goes for a near line, not an equal one) of all lines that go."""
    places, firsts, late = find(df, id_col, text_col, least)
    rule = firsts.join(late.withColumn("late", F.lit(True)), "lid", "left").where("late or n > 1").select("lid", "lid2", "first", "late", "n")
    rows = join_hot(places, rule, ["lid", "lid2"], "n")
    is_first = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.no") == F.col("no"))
    return rows.where(~is_first | F.coalesce("late", F.lit(False))).select("doc_id", "th", "no", is_first.alias("near")).distinct()


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_empty: bool = False, least: int = MIN_CHARS) -> DataFrame:
    """df with the text of each row less the lines that go; drop_empty: rows left without any text go too."""
    gone, key, th = spare(df, "gone", "key", "th")
    lost = stash(dropped(df, id_col, text_col, least).groupBy("doc_id", "th").agg(F.collect_set("no").alias(gone)), "lost-lines")
    lost = lost.withColumnsRenamed({"doc_id": key, "th": th})
    text = F.col(f"`{text_col}`").cast("string")
    joined = df.join(lost, (F.coalesce(df[id_col].cast("long"), F.lit(LAST)) == lost[key]) & (F.xxhash64(text) == lost[th]), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    out = joined.withColumn(text_col, F.when(F.col(gone).isNull(), text).otherwise(kept))
    if drop_empty:
        out = out.where(F.col(gone).isNull() | (F.trim(F.col(text_col)) != ""))
    return out.drop(gone, key, th)


def op10_segment_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    lost = dropped(docs, least=1).groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n_dropped"), F.count_if("near").alias("n_near"), F.array_sort(F.collect_set("no")).alias("lines"))
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("th"), F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).alias("n_lines"))
    out = rows.withColumn("key", F.coalesce("doc_id", F.lit(LAST))).join(lost.withColumnRenamed("doc_id", "key"), ["key", "th"], "left")
    none = F.expr("cast(array() as array<int>)")
    return out.select("doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.array_join(F.coalesce("lines", none).cast("array<string>"), ",").alias("dropped_lines"))
