import hashlib
import zlib

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline
from tessera.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _gone int, _own int, fp string, key string, part string"
LONG = " ".join(f"word{i}" for i in range(9000))
TEXTS = ["a plain text of some words that stand here", None, "", "x" * 40_000, LONG, "one\ntwo\n\nthree", "日本 ß 😀"] + [f"vile rotter {i} you" if i % 2 else f"kind words number {i} here" for i in range(30)]


def tables(spark, folder, rows):
    extra = (1, 2, "f", "k", "p")
    docs = [(i, t, "en", "s", len(t) if t is not None else None, *extra) for i, t in rows]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0 if t and t.startswith("vile") else 1, 1 if t and t.startswith("vile") else 0) for i, t in rows if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, " ".join(f"word{i}" for i in range(100, 140))), (2, None), (None, "kind words")] if rows else []
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    rows = list(enumerate(TEXTS))
    return rows + [rows[0], rows[0], (None, "a row without an id"), (5, "another text of id five")], tables(spark, tmp_path_factory.mktemp("awkward"), rows + [rows[0], rows[0], (None, "a row without an id"), (5, "another text of id five")])


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("bare"), [])


@pytest.mark.parametrize("name", queries.QUERIES)
def test_whole_results(spark, awkward, bare, name):
    rows, folder = awkward
    got = queries.QUERIES[name](spark, folder).collect()
    if name.startswith("op1_"):
        assert {(r.doc_id, r.item_id) for r in got} == {(4, 1)}
    else:
        assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, _ in rows)
    if name.startswith(("op3_", "op4_")):
        assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    if name.startswith("op5_"):
        sizes = {(r.doc_id, r["size"], r.text_crc32) for r in got}
        assert sizes == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows} and len({(r.shard, r.slot) for r in got}) == len(rows)
    if name.startswith("op7_"):
        assert all(r.round_trip for r in got)
    if name.startswith("op8_"):
        edits = {(r.doc_id, r.n_chars, r.edited_sha256) for r in got}
        assert (3, 40_000, hashlib.sha256((TEXTS[3][:30_000] + LONG[:10_000]).encode()).hexdigest()) in edits and (1, 0, hashlib.sha256(b"").hexdigest()) in edits
    assert queries.QUERIES[name](spark, bare).count() == 0


def test_pipeline(spark, awkward, bare):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]
    got = corpus_pipeline.run(spark, awkward[1]).collect()
    ids = [r.doc_id for r in got]
    # repeats, the leaking text and the second of the two texts without words go; clean documents stay
    assert all(r.round_trip for r in got) and 4 not in ids and ids.count(0) == 1 and {0, 3, 6}.issubset(ids) and len({1, 2} & set(ids)) == 1
    assert corpus_pipeline.run(spark, bare).count() == 0
