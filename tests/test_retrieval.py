import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import html as H
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import chunks, frontier, ingest, lexical, retrieval
from tessera.sources import files
from tessera.streaming import history


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return rows.select(column.alias("x")).first().x


def test_matches_equal_the_indexes(spark):
    docs = spark.createDataFrame([(1, "Node.js apple banana"), (2, "apple apple cherry the"), (3, None), (4, "")], "doc_id long, text string")
    t = lexical.tokenized(docs)
    post = lexical.postings(t)
    query = "the apple node.js missing"
    for keep, index, weight, name in ((False, lexical.bm25_index(post, lexical.doc_stats(t)), "weight", "bm25"), (True, post, "tf", "tf"), (True, lexical.tfidf_index(post, docs.agg(F.count("*").alias("n"))), "weight", "tfidf")):
        want = {r.doc: r.score for r in lexical.ranked(index, query, weight, keep).collect()}
        got = {r.doc: r.score for r in getattr(lexical.matches(docs, query, keep_stopwords=keep), name)().collect()}
        assert got == pytest.approx(want) and set(got) == {1, 2}
    assert lexical.matches(docs, "the of").bm25().count() == 0
    plan = lexical.matches(docs, query).bm25()._jdf.queryExecution().toString()
    assert "InMemoryTableScan" in plan and plan.count("Exchange hashpartitioning") == 0


def test_composition_and_gaps(spark):
    assert one(spark, T.nfc(F.col("t")), t="café") == "café" and one(spark, T.nfc(F.col("t")), t=None) is None
    for gap, joined in ((" ", True), ("\x0b", True), (" ", True), ("\n", False), ("\r", False)):
        got = one(spark, T.tokens_of(T.lexemes(F.col("t"))), t=f"data{gap}center")
        assert ("datacenter" in got) is joined, repr(gap)


def test_snippets(spark):
    text = "x" * 80 + " Apple\npie " + "y" * 80 + " apple " + "z" * 80 + " pie"
    got = one(spark, T.snippets(F.col("t"), ["apple", "pie", "absent", "zz"]), t=text)
    at = text.lower().index("apple")
    assert got[0] == text[at - 50 : at + 50].replace("\n", " ") and len(got) == 3 and "\n" not in "".join(got)
    assert one(spark, T.snippets(F.col("t"), ["a"]), t=None) == [] and one(spark, T.snippets(F.col("t"), []), t="a") == []


@pytest.mark.parametrize("raw, want", [
    ("HTTP://Example.COM:80/a//b/?b=2&a=%7e%2f#top", "http://example.com/a//b/?b=2&a=~%2F"), ("https://h.org", "https://h.org/"), ("https://h.org:444/x%zz", "https://h.org:444/x%zz"),
    ("ftp://h.org/", None), ("https://u:p@h.org/", None), ("https://h.org/a b", None), ("https://h.org:99999/", None), ("/relative", None), (None, None), ("https://[::1]:8080/x", "https://[::1]:8080/x"),
])
def test_urls(spark, raw, want):
    assert one(spark, U.normalize(F.col("u")), u=raw) == want
    assert one(spark, U.is_valid(F.col("u")), u=raw) is (want is not None)


def test_url_tests(spark):
    assert one(spark, U.domain_of(F.col("u")), u="https://user@Docs.Example.org:8443/x?h=http://other/") == "docs.example.org"
    assert one(spark, U.allowed(F.col("u"), ["a.org"]), u="https://a.org:443/") and not one(spark, U.allowed(F.col("u"), ["a.org"]), u="https://a.org:80/") and not one(spark, U.allowed(F.col("u"), ["a.org"]), u="https://b.a.org/")
    assert not one(spark, U.is_page(F.col("u")), u="https://a.org/X.PDF?q=1") and one(spark, U.is_page(F.col("u")), u="https://a.org/x?f=y.pdf")
    assert one(spark, U.point_id(F.col("s"), F.col("c")), s="https://a.org/", c="d::chunk-0") == str(uuid.uuid5(uuid.NAMESPACE_URL, "https://a.org/::d::chunk-0"))
    assert one(spark, U.document_name(F.col("s"), F.col("c")), s="u", c="h") == f"web-{hashlib.sha256(b'u').hexdigest()}-h"


def test_quality_reasons(spark):
    prose = " ".join(f"word{i}" for i in range(80))
    rows = [
        ("", "", "empty_content"), ("404 - Not Found", prose, "soft_404"), ("", "Page not found!\nSorry", "soft_404"), ("Access Denied | site", prose, "error_page"), ("", "Forbidden.\n" + prose, "error_page"),
        ("", "Accept all cookies " * 30, "boilerplate"), ("", "the same line here\n" * 40, "boilerplate"), ("", "Home\nMenu\nSearch", "navigation_content"), ("", "just a few words", "too_short"),
        ("", "alpha beta gamma " * 60, "insufficient_content"), ("Errors", prose + " 404 page not found is discussed", None), ("", None, "empty_content"),
    ]
    df = spark.createDataFrame([(i, t, x) for i, (t, x, _) in enumerate(rows)], "doc_id long, title string, text string")
    got = {r.doc: r for r in ingest.quality(df, title="title").collect()}
    assert [got[i].reason for i in range(len(rows))] == [r[2] for r in rows]
    assert got[8].words == 4 and got[8].characters == 16 and got[6].repeated_line_ratio == pytest.approx(1 - 1 / 40)
    kept = ingest.accepted(df.withColumn("doc", F.lit("x")), title="title")
    assert [r.doc_id for r in kept.collect()] == [10] and kept.columns == ["doc_id", "title", "text", "doc"]
    for bad in ({"min_words": 0}, {"min_words": True}, {"max_navigation_ratio": float("nan")}, {"min_unique_ratio": 2.0}, {"enabled": 1}):
        with pytest.raises(ValueError):
            ingest.QualityRules(**bad)


def test_unusable_vectors_and_null_texts(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [float("nan"), 1.0]), (3, [1.0]), (4, None), (5, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ingest.nearest(v, v.where("vec_id = 0").select(F.col("embedding").alias("q")), 9).collect()
    assert [(r.vec_id, round(r.score, 4)) for r in got] == [(0, 1.0), (5, 0.7071)]
    docs = spark.createDataFrame([(1, None), (2, "a"), (3, " a ")], "doc_id long, text string")
    assert [r.doc for r in ingest.first_of_content(docs).collect()] == [2]


def test_html(spark):
    page = "<html><head><title>T &amp; U</title></head><body><nav>menu</nav><!-- c --><article><h1>Head</h1><p>one <b>two</b><br>three<p>four</p><ul><li>a<li>b</ul><pre>x = 1\n\n y</pre><table><tr><td>1</td><td>2</td></tr></table><div class='toc'>no</div></article><footer>no</footer></body></html>"
    title, text, blocks = H.extract(page)
    assert title == "T & U"
    assert [(b["kind"], b["text"]) for b in blocks] == [("heading", "Head"), ("paragraph", "one two\nthree"), ("paragraph", "four"), ("list", "a\nb"), ("code", "x = 1\n y"), ("list", "1 | 2")]
    assert H.extract(None) == ("", "", []) and "no" not in text.split()
    assert H.links_of('<base href="/b/"><a href="c">x</a><a name=n>y</a><a href="https://o.org/">z</a>', "https://h.org/a") == [("c", "https://h.org/b/c"), ("https://o.org/", "https://o.org/")]
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert {r.page_id: len(r.blocks) for r in H.html_extract(df).collect()} == {1: 6, 2: 0}


def test_titles_as_written(spark, tmp_path):
    from tessera.plans import registry

    titles = {"a&amp;b&amp": "a&b&amp", "x = &quot;1": "x = &quot;1", " two \t words&&amp;&": "two words&&&", "": ""}
    rows = [(i, f"<head><title>{t}</title></head><p>x") for i, t in enumerate(titles)] + [(9, "<h1>no title</h1>"), (10, None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.title for r in registry.QUERIES["html_titles"](spark, str(tmp_path)).collect()}
    assert got == {**dict(enumerate(titles.values())), 9: "", 10: None}


def test_metrics_and_classes(spark):
    ranks = spark.createDataFrame([("q", "s", "x", 1), ("q", "s", "a", 2), ("q", "s", "a", 3), ("q", "s", "y", 4), ("q", "s", "z", 5), ("q", "s", "w", 6), ("q", "s", "b", 7)], "query_id string, system string, doc string, rank int")
    relevant = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "a")], "query_id string, doc string")
    got = {r.query_id: (r.recall_at_5, r.recall_at_10, r.reciprocal_rank) for r in retrieval.retrieval_metrics(ranks, relevant).collect()}
    assert got == {"q": (0.5, 1.0, 0.5), "r": (0.0, 0.0, 0.0)}
    assert retrieval.macro_average(retrieval.retrieval_metrics(ranks, relevant), "system").first().recall_at_10 == 0.5
    schema = "query_id string, recall_at_5 double, recall_at_10 double, reciprocal_rank double, ranking array<string>"
    before = spark.createDataFrame([(c, 0.5, 0.5, 0.5, ["a"]) for c in "abcde"], schema)
    after = spark.createDataFrame([("a", 1.0, 0.5, 0.2, ["b"]), ("b", 0.5, 0.6, 0.5, ["b"]), ("c", 0.5, 0.5, 0.1, ["a"]), ("d", 0.5, 0.5, 0.5, ["b"]), ("e", 0.5, 0.5, 0.5, ["a"])], schema)
    assert [r.category for r in retrieval.change_class(before, after).orderBy("query_id").collect()] == ["mixed", "improved", "decreased", "changed_without_metric_gain", "unchanged"]


def test_rerank_and_context(spark):
    rows = [(1, "d1", "c1", "u1", "alpha"), (2, "d2", "c1", "u2", "alpha"), (3, "d1", "c2", "u1", "beta"), (4, "d3", None, "u1", "gamma"), (5, "d4", None, None, " "), (6, "d5", None, None, "delta"), (7, "d6", None, "u7", "eps")]
    df = spark.createDataFrame(rows, "rank int, doc string, chunk_id string, url string, text string")
    assert [(r.source_id, r["rank"]) for r in retrieval.context(df, 2).orderBy("source_id").collect()] == [(1, 1), (2, 6)]
    assert [r["rank"] for r in retrieval.context(df, 9, one_per_document=False).orderBy("source_id").collect()] == [1, 3, 4, 6, 7]
    shown = retrieval.rendered(retrieval.context(df, 2)).orderBy("source_id").collect()
    assert shown[1].excerpt == "[Source 2]\nDocument: d5\nURL: Unavailable\nChunk ID: Unavailable (document-level result)\nRetrieval rank: 6\nContent:\ndelta"
    got = retrieval.rerank(df.where("rank in (1, 3, 6)"), retrieval.overlap_scorer(["beta"]), 3, 2, (F.col("rank"),)).collect()
    assert [r["rank"] for r in got] == [3, 1]
    with pytest.raises(Exception, match="missing candidate text"):
        retrieval.rerank(df, retrieval.overlap_scorer(["a"]), 9, 9, (F.col("rank"),)).collect()
    with pytest.raises(ValueError):
        retrieval.rerank(df, retrieval.overlap_scorer(["a"]), 0)
    assert one(spark, T.citations(F.col("t")), t="so [2], [1, 3] and [2]") == [1, 2, 3]
    assert one(spark, T.is_grounded(F.col("t"), F.col("n")), t="yes [1]", n=1) and not one(spark, T.is_grounded(F.col("t"), F.col("n")), t="see [2]", n=1) and not one(spark, T.is_grounded(F.col("t"), F.col("n")), t="www.x [1]", n=1)


def test_frontier(spark):
    empty = spark.createDataFrame([], frontier.SCHEMA)
    urls = [("https://a.org/x", 9, 1), ("https://a.org/x#f", 1, 2), ("https://b.org/", 0, 3), ("https://a.org/y.png", 0, 4), ("bad url", 0, 5), ("https://a.org/z", 1, 6)]
    found = spark.createDataFrame([(u, d, "link", s) for u, d, s in urls], "url string, depth int, discovery_source string, seq long")
    first = frontier.add(empty, found, ["a.org"], 3)
    got = {r.url: (r.status, r.error_type) for r in first.collect()}
    assert got == {"https://a.org/x": ("skipped", "depth"), "https://b.org/": ("skipped", "domain"), "https://a.org/y.png": ("skipped", "asset"), "https://a.org/z": ("queued", None)}
    again = frontier.add(first, spark.createDataFrame([("https://a.org/x", 2, "link", 9)], "url string, depth int, discovery_source string, seq long"), ["a.org"], 3)
    assert {r.url: (r.status, r.depth) for r in again.collect()}["https://a.org/x"] == ("queued", 2)
    assert [r.normalized_url for r in frontier.next_urls(again, 3).collect()] == ["https://a.org/z"]
    assert frontier.totals(empty).first().asDict()["chunks"] == 0
    store = spark.createDataFrame([("s", 1, 1, "old"), ("s", 2, 1, "old"), ("t", 3, 1, "old")], "source string, id long, generation int, payload string")
    batch = spark.createDataFrame([("s", 1, 2, "new"), ("s", 1, 3, "newest")], store.schema)
    assert sorted((r.source, r.id, r.payload) for r in frontier.replace_scopes(store, batch).collect()) == [("s", 1, "newest"), ("t", 3, "old")]


def test_structured_chunks(spark):
    words = " ".join(f"w{i}" for i in range(30))
    blocks = [{"kind": "heading", "text": "H", "level": 1}, {"kind": "paragraph", "text": words}, {"kind": "heading", "text": "S", "level": 2}, {"kind": "paragraph", "text": "short"}]
    got = chunks.structured("x", blocks, target=10, most=12, overlap=2)
    assert all(n <= 12 for _, _, n in got) and got[-1][0] == ["H", "S"] and got[-1][1] == "H\nS\n\nshort"
    assert [w for _, t, _ in got[:1] for w in t.split()][:2] == ["H", "w0"] and "w29" in got[-2][1]
    assert chunks.structured(" \n") == [] and len(chunks.structured("one\n\ntwo", target=4, most=4, overlap=0)) == 1
    with pytest.raises(ValueError):
        chunks.structured("x", overlap=200)
    df = spark.createDataFrame([(1, words), (2, None)], "doc_id long, text string")
    assert chunks.structured_chunks(df, target=10, most=12, overlap=2).count() > 2


def test_files_and_history(spark, tmp_path):
    for name, text in (("a.TXT", "one\ntwo"), ("b.txt", ""), ("c.md", "no")):
        (tmp_path / name).write_text(text)
    texts = files.read_texts(spark, str(tmp_path))
    assert {r.file_name: r.text for r in texts.collect()} == {"a.TXT": "one\ntwo", "b.txt": ""}
    path = str(tmp_path / "index.json")
    assert files.write_json(texts, path) and not files.write_json(texts.limit(0), path) and spark.read.json(path).count() == 2
    assert files.write_json(texts.limit(1), path, overwrite=True) and spark.read.json(path).count() == 1
    crawled = spark.createDataFrame([("a.TXT", "u", "t", "s", "d", "web", 1), ("a.TXT", "u", "t", "s", "d", "newer", 2)], files.MANIFEST + ", crawled_at int")
    files.write_manifest(crawled, str(tmp_path / "manifest"))
    assert {r.document_name: r.text for r in files.with_manifest(texts, spark, str(tmp_path / "manifest")).collect()} == {"a.TXT": "newer", "b.txt": ""}

    saved, hist = str(tmp_path / "saved"), str(tmp_path / "history")
    schema = "url string, text string"
    for n, rows in enumerate(([("u1", "a b"), ("u2", "a  b"), ("u3", None)], [("u4", "a b "), ("u5", "c")])):
        spark.createDataFrame(rows, schema).write.mode("append").json(str(tmp_path / "in"))
        history.save_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), saved, hist, str(tmp_path / "ckpt")).awaitTermination()
        assert {r.url for r in spark.read.parquet(saved).collect()} == ({"u1"} if n == 0 else {"u1", "u5"})
    history.save_unseen(spark.createDataFrame([("u4", "a b "), ("u5", "c")], schema), 1, saved, hist)  # the last batch once more
    assert {r.url for r in history.known(spark, hist).collect()} == {"u1", "u5"} and spark.read.parquet(saved).count() == 2
    report = spark.createDataFrame([("bm25", 0.5)], "system string, recall_at_5 double")
    files.write_report(spark, str(tmp_path / "report"), report, "Evaluation", ["recall_at_5"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "report" / "report.md")).collect()]
    assert "| bm25 | 0.5000 |" in lines


def test_entry_point(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 50
