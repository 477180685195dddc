import random

from tessera.llm import linededup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def brute(docs):
    seen, out = [], set()
    for doc_id, text in sorted((d for d in docs if d[1] is not None), key=lambda d: d[0]):
        for no, line in enumerate(text.split("\n")):
            line = line.strip(" ")
            if len(line) < linededup.MIN_CHARS:
                continue
            if any(abs(len(line) - len(s)) <= 2 and distance(line, s) <= (1 if min(len(s), len(line)) < linededup.SHORT else 2) for s in seen):
                out.add((doc_id, no))
            seen.append(line)
    return out


def test_dropped_lines_match_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd e") for _ in range(rng.choice([12, 20, 21, 38, 39, 40, 41, 60, 75]))) for _ in range(30)]

    def edited(line):
        chars = list(line)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(chars))
            chars[at : at + rng.randint(0, 1)] = [rng.choice("abcxyz")] * rng.randint(0, 1)
        return "".join(chars).strip(" ") + rng.choice(["", " "])

    docs = [(i, "\n".join(edited(rng.choice(base)) for _ in range(rng.randint(1, 5)))) for i in range(60)] + [(99, None), (100, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.no) for r in linededup.dropped(df).collect()}
    assert got == brute(docs)
    texts = {r.doc_id: r.text for r in linededup.dedup(df).collect()}
    for doc_id, text in docs:
        want = text and "\n".join(x for no, x in enumerate(text.split("\n")) if (doc_id, no) not in got)
        assert texts[doc_id] == want


def test_empty_table(spark):
    assert linededup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_lines(spark, tmp_path):
    rows = [(1, "Menu\n \nMenu"), (2, "Menu\n\t\nMena\n \n\t"), (3, "a line of more than twenty\na line of more than twenti")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_dropped, r.dropped_lines) for r in linededup.op10_segment_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (1, "2"), 2: (1, "0"), 3: (1, "1")}


def test_within_matches_edit_distance(spark):
    rng = random.Random(11)
    pairs = []
    for _ in range(400):
        a = [rng.choice("abc ") for _ in range(rng.randint(1, 30))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = [rng.choice("abcx")] * rng.randint(0, 1)
        pairs.append(("".join(a), "".join(b)))
    rows = spark.createDataFrame(pairs, "a string, b string").where("b <> ''")
    for r in rows.select("a", "b", linededup.within(rows["a"], rows["b"]).alias("d")).collect():
        want = distance(r.a, r.b)
        assert r.d == (want if want <= linededup.TAU else None), r


def test_group_of_near_copies_and_columns_of_any_name(spark, monkeypatch):
    rng = random.Random(4)
    base = "a line that a very large group of documents shares with small changes in it"
    lines = []
    for _ in range(300):
        chars = list(base)
        for _ in range(rng.randint(0, 2)):
            chars[rng.randrange(len(chars))] = rng.choice("xyz")
        lines.append("".join(chars))
    docs = [(i, x) for i, x in enumerate(lines)] + [(None, base), (7, lines[7]), (400, base + "\t\r"), (401, "w " * 30_000)]
    df = spark.createDataFrame([(i, x, 1, 2, 3) for i, x in docs], "doc_id long, text string, _gone int, _key int, _th int")
    want = brute([(linededup.LAST if i is None else i, x.rstrip("\t\r")) for i, x in sorted(set((i if i is not None else linededup.LAST, x) for i, x in docs))])
    got = {(r.doc_id, r.no) for r in linededup.dropped(df).collect()}
    assert got == want and len(got) > 200
    out = linededup.dedup(df)
    assert out.columns == df.columns and out.count() == len(docs)


def test_lines_done_on_a_key_are_not_carried_on(spark, monkeypatch):
    """A line that has met every earlier line of a key leaves it, so steps get smaller; before, each read all lines not late."""
    head, words = "these twenty words or so stand first in every one of the lines ", [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    docs = [(i, f"{head}{w * 9} {w[::-1] * 9}") for i, w in enumerate(words[:90])]
    kept, old = [], linededup.stash

    def stash(df, name, **options):
        out = old(df, name, **options)
        if name in ("line-members", "line-rest"):
            kept.append(out.count())
        return out

    monkeypatch.setattr(linededup, "stash", stash)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.no) for r in linededup.dropped(df).collect()} == brute(docs)
    assert len(kept) >= 3 and kept[0] > kept[1] > kept[2] and kept[-1] <= 1  # the last line of a key is nobody's comparer
