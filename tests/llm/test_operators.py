import zlib
from pathlib import Path

import numpy as np
import pytest

from tessera.llm import decontam, quality, sentencepiece, sharding, simhash, spotsigs, tokenstore, toxicity, unigram

public_tokenizers = pytest.importorskip("public_tokenizers")


def docs(spark, texts, start=0):
    rows = [(i + start, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string")


@pytest.mark.parametrize("count", [1, 2, 3, 17, 1000])
def test_permutation_is_one_to_one_and_inverts(count):
    p = sharding.permute(np.arange(count), count)
    assert sorted(p.tolist()) == list(range(count))
    assert sharding.permute(p, count, inverse=True).tolist() == list(range(count))


def test_shards_are_even_and_gapless(spark):
    rows = sharding.shard_rows(docs(spark, ["a", None, "", "a"] * 10), shards=7).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.shard_rows(docs(spark, [])).count() == 0


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**63), 2**63 - 1, 300)
    for bits in (1, 2):
        flips = np.array([sum(1 << int(k) for k in rng.choice(63, bits, replace=False)) for _ in x])
        a, b = simhash.segment_keys(x), simhash.segment_keys(x ^ flips)
        assert all(set(p) & set(q) for p, q in zip(a.tolist(), b.tolist(), strict=True))


@pytest.mark.parametrize("hot", [1, 32])
def test_components_match_brute_force(spark, hot):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**40, 6)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), replace=False) if k < 63) for b in base for _ in range(25)})
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), hot=hot)
    from tessera.llm.common import connected_components

    got = {r.node: r.root for r in connected_components(edges).collect()}
    root = {f: f for f in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[a] == root[b] for a in fps for b in fps if (a ^ b).bit_count() <= 2):
            break
    assert {f: got.get(f, f) for f in fps} == root


def test_keep_one(spark):
    df = docs(spark, ["one two three four", "One two three four", None, "", "other words stand here now"])
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [0, 2, 4]


def test_token_store_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokenstore.WORD_BPE)
    texts = ["Hello, World! it's 7.0 a--b ...", None, "", "ÀÉ ß Ωmega İ \x1c x <|endoftext|> don't.", "word " * 5000, "word " * 5000, "é, naïve."]
    store = tokenstore.write_store(docs(spark, texts), path, 2)
    tokenizer = Tokenizer.from_file(path)
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert [list(r.ids) for r in tokenstore.read_ids(store).orderBy("doc_id").collect()] == want
    start = 0
    for ids, r in zip(want, tokenstore.read_digests(store).orderBy("doc_id").collect(), strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32, r.verified) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        start += len(ids)
    chunks = store.chunks()
    assert chunks.count() == chunks.select("key").distinct().count()


def test_token_store_without_rows_and_damaged(spark):
    path = public_tokenizers.path(tokenstore.WORD_BPE)
    empty = tokenstore.write_store(docs(spark, []), path, 2)
    assert tokenstore.read_digests(empty).count() == 0 and empty.chunks().count() == 0 and tokenstore.damaged_parts(empty).count() == 0
    store = tokenstore.write_store(docs(spark, ["one", "two", None]), path, 2)
    assert tokenstore.damaged_parts(store).count() == 0
    kept = store.recipes().where("doc_id <> 1").collect()
    spark.createDataFrame(kept, store.recipes().schema).write.mode("overwrite").parquet(f"{store.path}/recipes")
    assert [r.part for r in tokenstore.damaged_parts(store).collect()] == [0]


def test_max_plus_scan_equals_one_pass(spark):
    model = unigram.model_bytes()
    lat = unigram.Lattice(model)
    texts = ["", None, "one  two\nthree ß日本😀", "abcdefg" * 30, "the quick brown fox " * 20 + "x" * 90, "a " * 64, "日本" * 300 + "xyz" * 700, "  ".join(["aaaa  bb"] * 90)]
    out = {r.doc_id: r for r in sentencepiece.decode(sentencepiece.encode(docs(spark, texts), model, chunk=48), model).collect()}
    assert len(out) == len(texts)

    for i, t in enumerate(texts):
        assert out[i].decoded == (t or "")
        assert list(out[i].ids) == lat.best(lat.normalize(t or ""))[1], i
    counts = {r.doc_id: r.n_tokens for r in unigram.token_counts(docs(spark, texts), model).collect()}
    assert counts == {i: len(lat.best(lat.normalize(t or ""))[1]) for i, t in enumerate(texts)}


def test_leaks_survive_substitutions(spark):
    item = [f"w{i}" for i in range(30)]
    near = [w if i % 5 != 4 else "zz" for i, w in enumerate(item)]
    texts = [" ".join(["a", "b", *item, "c"]), " ".join(near), " ".join(item[:6] + ["q"] * 30), None, "", "five short words stand here"]
    items = spark.createDataFrame([(7, " ".join(item)), (8, "short words stand"), (9, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.doc_start, r.n_equal) for r in decontam.leaks(docs(spark, texts), items).collect()}
    assert got == {(0, 7): (2, 30), (1, 7): (0, 24), (5, 8): (1, 3)}
    assert sorted(r.doc_id for r in decontam.clean(docs(spark, texts), items).collect()) == [2, 3, 4]


def test_spotsigs(spark):
    texts = ["the cat sat on a red mat with great joy", "The cat sat, on a red mat with great joy!", None, "", "zebra", "of of"]
    rows = spotsigs.with_next(docs(spark, texts)).orderBy("doc_id").collect()
    assert rows[0].sigs == rows[1].sigs and rows[2].sigs == [] and rows[4].sigs != rows[5].sigs
    assert [r.next_text for r in rows] == [t or "" for t in [*texts[1:], texts[0]]]
    member, near = spotsigs.near_pairs(docs(spark, ["the one two three the four five six " + x for x in ("a", "b")] + ["the red cat sat"]))
    assert member.count() == 3 and near.count() <= 1
    assert spotsigs.with_next(docs(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [2, 64])
def test_spotsigs_near_pairs_match_brute_force(spark, hot):
    rng = np.random.default_rng(12)
    texts = [""]
    for g in range(8):
        base = [str(w) for w in rng.choice([*spotsigs.ANCHORS[:12], *(f"w{g}x{i}" for i in range(40)), "shared"], int(rng.integers(20, 160)))]
        for _ in range(14):
            words = list(base)
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = f"z{rng.integers(10**9)}"
            texts.append(" ".join(words))
    sets = {tuple(r.sigs) for r in spotsigs.with_next(docs(spark, texts)).collect()} - {()}
    want = sum(1 for a in sets for b in sets if a < b and len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)))
    member, near = spotsigs.near_pairs(docs(spark, texts), hot=hot)
    assert near.count() == want > 50 and member.count() == len(texts)


def test_next_of_repeated_rows(spark):
    rows = [(i, f"text {i}") for i in range(600)] + [(511, "text 511")] * 3 + [(None, None), (0, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = spotsigs.with_next(df).collect()
    key = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows) and all(r.next_text is not None for r in got)
    by = {r.text: r.next_text for r in got if r.doc_id not in (511, 0)}
    assert by["text 510"] == "text 511" and by["text 512"] == "text 513" and by["text 599"] == "" and len(key) == len(rows)
    assert sorted(r.next_text for r in got if r.doc_id == 511) == ["text 511"] * 3 + ["text 512"]


def test_pool_is_monotone():
    out = quality.pool(np.array([0, 2, 1, 3.0]), np.array([1, 2, 2, 3.0]))
    assert (np.diff(out) >= 0).all()


def test_toxicity_learns_and_scores_all(spark):
    texts = [f"plain words number {i} here" for i in range(60)] + [f"you vile rotter number {i}" for i in range(60)]
    labels = np.array([0] * 60 + [1] * 60)
    model = toxicity.fit(texts, labels)
    scores = toxicity.score_texts(model, iter(["plain words here", "vile rotter", None, ""]))
    assert scores[1] > 0.5 > scores[0] and all(0 <= s <= 1 for s in scores)
    assert toxicity.score_texts(toxicity.fit([], np.zeros(0)), iter(["x"]))[0] < 0.5


@pytest.mark.parametrize("hot", [1, 32])
def test_keep_one_finds_all_near_copies(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash.near_links, "__defaults__", (hot,))
    rng = np.random.default_rng(5)
    texts = ["", None]
    for g in range(12):
        base = [f"w{g}x{i}" for i in range(int(rng.integers(12, 80)))] + ["common words stand in all texts"]
        for _ in range(8):
            words = list(base)
            for _ in range(int(rng.integers(0, 3))):
                words[int(rng.integers(len(words)))] = f"z{rng.integers(10**9)}"
            texts.append(" ".join(words))

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    near = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for a, b in near:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    bits = [(simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])).bit_count() for a, b in near if sets[a] != sets[b]]
    assert sum(x > 2 for x in bits) > 20  # out of reach of the query's radius
    assert sorted(r.doc_id for r in simhash.keep_one(docs(spark, texts)).collect()) == sorted(set(root))


def test_leaks_match_brute_force(spark):
    rng = np.random.default_rng(8)
    items, texts = [], []
    for k in range(150):
        n = int(rng.choice([4, 5, 6, 7, 10, 13, 15, 16, 20, 25, 38]))
        item = [f"i{k}w{j}" for j in range(n)]
        first = int(rng.integers(n))
        changed = range(first, min(first + n // 6, n)) if k % 3 == 0 else rng.choice(n, rng.integers(0, n // 4 + 1), replace=False)
        copy = [w if j not in set(map(int, changed)) else "zz" for j, w in enumerate(item)]
        items.append(item)
        texts.append(["a", "b"] * int(rng.integers(0, 3)) + copy + ["c"] * int(rng.integers(0, 3)))
    items.append([f"p{j}" for j in range(25)])
    texts.append([f"p{j}" if j not in (11, 12, 13) else "zz" for j in range(25)])  # 11 words, then 11 more

    def leaks(item, text):
        for d in range(-len(item), len(text)):
            same = [item[j] == text[j + d] for j in range(len(item)) if 0 <= j + d < len(text)]
            for i in range(len(same)):
                for j in range(i + min(13, len(item)), len(same) + 1):
                    if 5 * sum(same[i:j]) >= 4 * (j - i):
                        return True
        return False

    want = {k for k, (item, text) in enumerate(zip(items, texts, strict=True)) if leaks(item, text)}
    table = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = decontam.leaks(docs(spark, [" ".join(x) for x in texts]), table).collect()
    assert {r.doc_id for r in got} == want and len(want) > 60 and all(r.doc_id == r.item_id and r.similarity >= 0.8 and r.n_words >= min(13, len(items[r.item_id])) for r in got)


def test_spotsigs_stray_anchor(spark):
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words), " ".join([*words[:40], "the", *words[40:]]), " ".join(["the", *words[:5]]), " ".join(words[:5])]
    sigs = [set(r.sigs) for r in spotsigs.with_next(docs(spark, texts)).orderBy("doc_id").collect()]
    assert len(sigs[0]) > 8 and len(sigs[0] & sigs[1]) >= 0.8 * len(sigs[0] | sigs[1]) and all(sigs)


def test_keep_one_does_not_write_the_sets(spark, monkeypatch):
    """Tables kept between its steps are small against the texts: 8 bytes a word, as sets have, would be more than these."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 3000)) for _ in range(40)]
    texts.append(texts[0] + " end")
    wrote, old = [], simhash.stash

    def stash(df, name, **options):
        out = old(df, name, **options)
        wrote.append(sum(p.stat().st_size for p in Path(out._tessera_path.removeprefix("file://")).glob("*.parquet")))
        return out

    monkeypatch.setattr(simhash, "stash", stash)
    assert sorted(r.doc_id for r in simhash.keep_one(docs(spark, texts)).collect()) == list(range(40))
    assert sum(wrote) < sum(map(len, texts)) / 3


def test_parities_leave_no_alike_sets_out(spark):
    rng = np.random.default_rng(6)
    rows = []
    for n in (1, 5, 63, 64, 127, 128, 1000, 1023, 1030):
        for _ in range(4):
            a = rng.integers(-(2**62), 2**62, n)
            b = np.concatenate([a[: n - n // 10], rng.integers(-(2**62), 2**62, n // 12)])
            c = rng.integers(-(2**62), 2**62, n)
            rows += [(n, len(x), simhash.parities(np.unique(a)).tolist(), simhash.parities(np.unique(x)).tolist(), len(set(a) & set(x)) / len(set(a) | set(x))) for x in (b, c)]
    df = spark.createDataFrame(rows, "n int, m int, a array<long>, b array<long>, like double")
    got = [(r.like, r.near) for r in df.select("like", simhash.may_be_alike("n", "m", "a", "b").alias("near")).collect()]
    assert all(near for like, near in got if like >= 0.8) and sum(like >= 0.8 for like, _ in got) >= 36
    assert not any(near for like, near in got if like < 0.1)


def test_keep_one_goes_by_fingerprints_first(spark):
    rng = np.random.default_rng(9)
    base = [[f"g{g}x{i}" for i in range(400)] for g in range(6)]
    texts = [" ".join(w) for w in base] + [" ".join([*w[:-1], "other"]) for w in base] + [" ".join(rng.permutation(base[0]))]
    fps = [simhash.majority(simhash.shingle_hashes(t)) for t in texts]
    close = [(a, b) for b in range(13) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= 2]
    assert len(close) >= 4 and all(b == a + 6 for a, b in close)
    slim = docs(spark, texts).selectExpr("doc_id", "xxhash64(text) th", "text")
    prints = simhash.shingle_prints(slim)
    ids = {r.set_id: r.doc_id for r in prints.collect()}
    firsts = prints.selectExpr("set_id", "named_struct('none', false, 'doc_id', doc_id, 'th', th) first", "n", "fp", "odd")
    got = {tuple(sorted((ids[r.u], ids[r.v]))) for r in simhash.print_links(slim, firsts).collect()}
    assert got == set(close)


def test_token_store_puts_plain_texts_in_lower_case_once(monkeypatch):
    """As the library does, whatever letters stand in a text; forms of a word in plain texts are learnt once."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokenstore.WORD_BPE)
    enc, tokenizer = tokenstore.WordEncoder(open(path, encoding="utf-8").read(), "<u2"), Tokenizer.from_file(path)
    texts = ["Word WORD word, Éa ÉA éa\u0130 ÇA\u0301 ΟΔΟΣ", "Word WORD word, Éa ÉA éa ÇA", "STRASSE straße Ǆ \u212aelvin \u017f", "", "I'LL DON'T <|ENDOFTEXT|>", "A\x1cB", "X,, Y... <| z"]
    assert [np.frombuffer(x, "<u2").tolist() for x in enc.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    plain = tokenstore.WordEncoder(open(path, encoding="utf-8").read(), "<u2")
    assert len(list(plain.encode(["Word WORD word Éa ÉA éa"]))) == 1 and set(plain.memo) == {"word", "éa"}


def test_worker_remembers_for_one_operator_at_a_time():
    from tessera.llm.common import hold_memo

    hold_memo("none", lambda: None)
    model = toxicity.fit([], np.zeros(0))
    toxicity.score_texts(model, ["some words"])
    assert toxicity._memo
    sentencepiece.encoder(unigram.model_bytes()).encode("▁some▁words")
    assert not toxicity._memo and sentencepiece._encoders and unigram._lattices
    toxicity.score_texts(model, ["some words"])
    assert toxicity._memo and not sentencepiece._encoders and not unigram._lattices


def test_all_words_of_a_slice_are_learned_at_once(monkeypatch):
    rng = np.random.default_rng(5)
    letters = list("▁abcehinot1-\n\0é中😀")
    words = {"".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(3000)} | {"a", "▁", "中" * 150, "x" * 199, "\0", "a\0"}
    words.discard("")
    lat = unigram.lattice(unigram.model_bytes())
    got = lat.all_ids(words)
    assert lat.all_ids([]) == {} and got == {w: lat.best_bytes(w) for w in words}
    monkeypatch.setattr(sentencepiece, "MEMO", 50)
    enc, asked = sentencepiece.Encoder(lat), []
    monkeypatch.setattr(lat, "all_ids", lambda new, f=lat.all_ids: asked.append(set(new)) or f(new))
    for lo in range(0, 400, 100):  # generations turn over, long words are not remembered
        texts = [lat.normalize(f"{w} some text {'long' * 60}{lo} {w}") for w in sorted(words)[lo : lo + 100]]
        assert enc.encode(*texts) == [lat.best_bytes(t)[0] for t in texts]
    assert len(asked) == 4 and not any(len(w) > sentencepiece.LONG for w in enc.memo)
