import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import ingest, lexical


def tokens(spark, text, **more):
    row = spark.createDataFrame([(text,)], "t string").select(T.lexemes(F.col("t")).alias("l")).select(T.tokens_of(F.col("l"), **more).alias("k")).first()
    return row.k


def test_token_grammar(spark):
    assert set(tokens(spark, "Node.js")) == {"node.js", "node", "js", "nodejs"}
    assert tokens(spark, "C++ c# .NET") == ["c++", "c#", ".net"]
    assert "datacenter" in tokens(spark, "data center") and "datacenter" not in tokens(spark, "data\ncenter")
    assert tokens(spark, "the of") == [] and tokens(spark, None) == []
    assert tokens(spark, "Straße") == ["strasse"]


def test_bm25_and_empty(spark):
    docs = spark.createDataFrame([(1, "apple banana"), (2, "apple apple cherry"), (3, None)], "doc_id long, text string")
    t = lexical.tokenized(docs)
    scores = lexical.ranked(lexical.bm25_index(lexical.postings(t), lexical.doc_stats(t)), "the cherry", "weight", False)
    assert [r.doc for r in lexical.top(scores, 5).collect()] == [2]
    assert lexical.doc_stats(t).where("doc = 3").first().length == 0
    with pytest.raises(ValueError):
        lexical.bm25_index(lexical.postings(t), lexical.doc_stats(t), b=2)


def test_fusion(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 1.0)], "doc long, score double")
    b = spark.createDataFrame([(2, 0.9)], "doc long, score double")
    got = {r.doc: r.score for r in lexical.fuse(a, b).collect()}
    assert got == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61})


def test_chunks_and_dedup(spark):
    docs = spark.createDataFrame([(1, "a  b c d e"), (2, "a b c d e"), (3, "")], "doc_id long, text string")
    chunks = [(r.doc, r.chunk, r.text) for r in ingest.word_chunks(docs.where("doc_id = 1"), 3, 1).collect()]
    assert chunks == [(1, 0, "a  b c"), (1, 1, "c d e")]
    assert ingest.first_of_content(docs).count() == 2


def test_fusion_takes_the_whole_lexical_list(spark, tmp_path):
    from tessera.plans import registry

    texts = [(i, "tion " + "x " * i) for i in range(400)]  # longer texts rank lower
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    vectors = [(i, [1.0, abs(i - 350) / 400 if i else 0.0]) for i in range(400)]  # after 0: 350, 349, 351, ...
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.doc_id: r for r in registry.QUERIES["rrf_fusion"](spark, str(tmp_path)).collect()}
    assert (got[350].bm25_rank, got[350].semantic_rank) == (351, 2)
    assert got[350].score == round(1 / (60 + 351) + 1 / 62, 6)
    ranks = spark.range(1000).selectExpr("id AS doc", "cast(id % 7 AS double) AS score")
    want = {i: k for k, i in enumerate(sorted(range(1000), key=lambda i: (-(i % 7), i)), 1)}
    assert {r.doc: r.k for r in lexical.with_ranks(ranks, "k").collect()} == want


ODD_TEXTS = [
    "Node.js and C++ c# .NET $HOME x.y-z_w a--b c#b c++.d 12.5 3-4 the.of is-on", "data center\tdata\x0bcenter data\ncenter data\r\ncenter data\x85center data center", "th at th is the th at", "a bb bb cc ccc",
    "12 34 56x 78", "Straße GROẞE ÎLE naïve ΑΣ ΑΣ", "x" * 30 + " " + "y" * 20 + " " + "z" * 25, "(data) center, data (center) -data center- 'data' center", "data  \t center data \n center", " \n ", "", None, "½ ² ⅷ ٣ 中文 テスト の字 éte café éte", "a." * 70 + "b " + "w" * 100, "😀 data😀center data 😀 center",
]


def test_arrow_grammar_equals_the_columns(spark, monkeypatch):
    from tessera.functions import tokens as G

    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")
    for keep in (False, True):
        want = {r.doc: sorted(r.tokens) for r in lexical.tokenized(docs, keep_stopwords=keep).collect()}
        texts = {r.doc_id: r.t for r in docs.select("doc_id", T.folded(T.nfc(F.col("text"))).alias("t")).collect()}
        assert {i: sorted(G.Grammar(keep).of(t)) for i, t in texts.items()} == want
        monkeypatch.setattr(G, "MEMO", 2)  # what is forgotten is found again
        g = G.Grammar(keep)
        assert {i: sorted(g.of(t)) for i, t in texts.items()} == want
    t = lexical.tokenized(docs)
    assert sorted(map(tuple, lexical.counted(docs).select("token", "doc", "tf").collect())) == sorted(map(tuple, lexical.postings(t).select("token", "doc", "tf").collect()))
    assert sorted(map(tuple, G.lengths(docs).collect())) == sorted(map(tuple, lexical.doc_stats(t).collect()))
    assert {r.token for r in G.distinct(docs).collect()} == {x for r in t.collect() for x in r.tokens}
    plan = lexical.counted(docs)._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning" not in plan and "regexp_extract_all" not in plan


def test_indexes_of_repeated_ids(spark):
    """Rows of one id are added up, as GROUP BY token, doc does; lengths stay those of the rows."""
    docs = spark.createDataFrame([(1, "apple banana"), (1, "apple"), (2, "banana"), (None, "apple")], "doc_id long, text string")
    got = {(r.token, r.doc): r.tf for r in lexical.counted(docs).collect()}
    assert got == {("apple", 1): 2, ("banana", 1): 1, ("applebanana", 1): 1, ("banana", 2): 1, ("apple", None): 1}
    t = lexical.tokenized(docs)
    rows = lexical.bm25_index(lexical.postings(t), lexical.doc_stats(t)).collect()
    assert sorted(map(tuple, lexical.bm25_of(docs).collect())) == sorted(map(tuple, rows)) and len(rows) == 7
    once = docs.where("text <> 'apple' or doc_id is null")
    t = lexical.tokenized(once)
    assert sorted(map(tuple, lexical.bm25_of(once).collect())) == sorted(map(tuple, lexical.bm25_index(lexical.postings(t), lexical.doc_stats(t)).collect()))


def test_quality_measures_equal_the_columns(spark):
    docs = spark.createDataFrame(list(enumerate([*ODD_TEXTS, "Home\r\nMENU\x0b\x1cPrivacy  POLICY of us  \x1d\x85a-b o'c 'd'\nMENU\n　x　", "Share\n" * 9 + "w " * 200])), "doc_id long, text string")
    content = F.coalesce("text", F.lit(""))
    lines, words = T.lines_of(content), T.words_of(content)
    size = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + F.char_length(v))
    low = lambda test: size(F.filter(lines, lambda x: test(F.lower(x))))
    want = docs.select(
        "doc_id", F.char_length(F.regexp_replace(content, r"(?U)^\s+|\s+$", "")), F.size(words), F.size(F.array_distinct(words)), size(lines), size(F.array_distinct(lines)),
        low(lambda x: x.rlike("|".join(ingest.BOILERPLATE))), low(lambda x: x.isin(list(ingest.NAVIGATION))), F.when(F.size(words) < 160, F.coalesce(F.get(lines, F.lit(0)), F.lit(""))).otherwise(""),
    )
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r[0]: tuple(r)[1:] for r in want.collect()} == {i: ingest.measures(t) for i, t in texts.items()}
    plan = ingest.accepted(docs).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan


def test_chunking_asks_about_each_part_a_few_times():
    from tessera.operators import chunks

    class Asked(chunks.SpaceCounter):
        seen = 0

        def count(self, text):
            self.seen += len(text)
            return super().count(text)

        def fits(self, text, most):
            self.seen += min(len(text), 8 * most)
            return super().fits(text, most)

    text = " ".join(f"w{i}" for i in range(20_000))
    counter, plain = Asked(), type("Plain", (), {"model_limit": 256, "count": lambda self, t: len(t.split()) + 2, "offsets": lambda self, t: chunks.SpaceCounter().offsets(t)})()
    got = chunks.structured(text, target=120, most=200, overlap=20, counter=counter)
    assert len(got) > 100 and got[-1][1].endswith(" w19999") and counter.seen < 30 * len(text)
    some = text[:9000] + "\n\n" + text[:700]  # a counter that only counts gives the same
    assert chunks.structured(some, target=40, most=60, overlap=5, counter=plain) == chunks.structured(some, target=40, most=60, overlap=5)


def test_pages_go_in_bounded_slices():
    import pyarrow as pa

    from tessera.functions import html as H

    sizes = [10, H.SLICE // 2, H.SLICE // 2, 3 * H.SLICE, 0, 5]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(["x" * n for n in sizes] + [None, "z"])], names=["key", "html"])
    parts = list(H.slices(iter([batch, batch.slice(0, 0)]), 1))
    assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(8)) and len(parts) == 4
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(1).to_pylist()) <= H.SLICE for p in parts)


def test_weighted_indexes_read_the_texts_once(spark):
    docs = spark.createDataFrame([(i, f"apple w{i} banana") for i in range(20)], "doc_id long, text string")
    post, n = lexical.counted(docs), docs.agg(F.count(F.lit(1)).alias("n"))
    for rows in (lexical.bm25_of(docs, composed=True), lexical.tfidf_index(lexical.by_token(post, docs), n)):
        assert len(rows.collect()) == 100
        plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("MapInArrow") == 1 and "ReusedExchange" in plan and "SortMergeJoin" not in plan


def test_inverted_lists_are_merged(spark):
    """Lists of a token meet from many batches; repeated ids count once, null ids have neither block nor list."""
    texts = [*ODD_TEXTS, "data center apple", "apple", "apple data"]
    docs = spark.createDataFrame([*((i % 13 - 4, t) for i, t in enumerate(texts * 3)), (None, "apple pear")], "doc_id long, text string").repartition(3)
    post = lexical.postings(lexical.tokenized(docs))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        for block in (3, 1000):
            want = {(r.token, r.block): r.docs for r in lexical.inverted_index(post.where("doc is not null"), block).collect()}
            got = lexical.inverted_of(docs, block=block).collect()
            assert {(r.token, r.block): r.docs for r in got} == want | {(t, None): None for t in ("apple", "pear", "applepear")} and len(got) == len(want) + 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
