"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import pytest

import corpus_pipeline
from delaylake.llm import entries

LONG = "lorem ipsum dolor sit amet " * 20_000
DOCS = [
    (1, "One two three four five six seven", "en", "a", 33, 7, "x"),
    (1, "One two three four five six seven", "en", "a", 33, 7, "x"),
    (1, "same id but another text than the other", "en", "a", 3, 7, "x"),
    (2, None, None, None, None, None, None),
    (None, "no id here, though a text: mail me at ann@mail.example.com", "en", "b", 5, 7, "x"),
    (None, None, None, None, None, None, None),
    (3, "", "en", "b", 0, 7, "x"),
    (4, "   \n\t ", "en", "b", 6, 7, "x"),
    (5, LONG, "en", "c", len(LONG), 7, "x"),
    (6, "one", "en", "c", 3, 7, "x"),
    (7, "\u0000 nul, \U0001f600 astral, ▁ mark,  double  spaces ", "en", "c", 3, 7, "x"),
    (8, "token = \"0641917ea4e9feb9cda83477b57ac26f71d4f592\" and +1 (456) 555-2186", "en", "c", 3, 7, "x"),
]
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, _id string"
DOC_QUERIES = [n for n in entries.queries() if n.startswith("op") and not n.startswith(("op2_", "op7_"))]


def save(spark, folder, docs, labels, benchmark, pages, vectors):
    spark.createDataFrame(docs, DOC_SCHEMA).withColumnRenamed("fp", "score").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string, doc_id long").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string, host string, verdict string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, rank int").write.parquet(f"{folder}/embeddings.parquet")


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("edge"))
    labels = [(1, 1, 0, "t"), (1, 1, 1, "t"), (3, None, None, None), (None, 1, 1, None), (5, 1, 0, None), (99, 0, 1, None)]
    benchmark = [(1, "four five six", 1), (1, None, 1), (2, "", 1), (None, "one two", 1), (3, "!!!", 1), (4, "lorem ipsum dolor sit amet " * 4, 1)]
    pages = [(1, "http://A.com/x?a=1&b", "", "h", "v"), (1, "http://A.com/x?a=1&b", "", "h", "v"), (2, None, None, None, None), (None, "x", "", "", ""), (3, "", "", "", ""), (4, "https://www.example.com/en/", "", "", "")]
    vectors = [(20, [1.0, 0.0], 0, 1), (20, [1.0, 0.0], 0, 1), (40, [0.0, 1.0], 0, 1), (1, [1.0, 0.0], 0, 1), (2, [1.0, 0.0], 0, 1), (3, None, 0, 1), (4, [0.0, 0.0], 0, 1), (5, [float("nan"), 1.0], 0, 1)]
    vectors += [(6, [None, 1.0], 0, 1), (None, [1.0, 1.0], 0, 1), (60, [float("inf"), 1.0], 0, 1), (7, [1.0], 0, 1)]
    save(spark, folder, DOCS, labels, benchmark, pages, vectors)
    return folder


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    save(spark, folder, [], [], [], [], [])
    return folder


@pytest.mark.parametrize("name", DOC_QUERIES)
def test_one_row_per_document(spark, edge_dir, name):
    rows = entries.queries()[name](spark, edge_dir).collect()
    # op1 needs an id to report; all others keep every row
    assert len(rows) == (len(DOCS) - 2 if name.startswith("op1_") else len(DOCS))


@pytest.mark.parametrize("name", [n for n in entries.queries() if n.startswith("op")])
def test_empty_tables(spark, empty_dir, name):
    assert entries.queries()[name](spark, empty_dir).collect() == []


def test_pages(spark, edge_dir):
    rows = entries.queries()["op7_url_filter"](spark, edge_dir).collect()
    assert len(rows) == 6
    by_url = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in rows}
    assert by_url[(1, "a.com", "/x")] == ("com/", "allow")
    assert by_url[(2, "", "")][0] is None
    assert by_url[(4, "www.example.com", "/en/")] == ("www.example.com/en/", "allow")


def test_vectors(spark, edge_dir):
    rows = entries.queries()["op2_ann"](spark, edge_dir).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == {20, 40}
    # ties by the smaller id; never the query's own id
    assert found[20][:2] == [(1, 1.0), (2, 1.0)]
    assert all(v != q for q, vs in found.items() for v, _ in vs)


@pytest.mark.parametrize("k", range(5))
@pytest.mark.parametrize("which", ["edge_dir", "empty_dir"])
def test_stages(spark, request, which, k, tmp_path):
    folder = request.getfixturevalue(which)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.STAGES[k][1](spark, docs, folder)
    if k < 4:
        assert out.columns == docs.columns
    else:
        assert out.columns == docs.columns + ["pieces"]
    out.write.parquet(str(tmp_path / "out"))
    n = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).count()
    if which == "empty_dir":
        assert n == 0
    elif k in (3, 4):
        assert n == len(DOCS)
    else:
        assert 0 < n <= len(DOCS)


def test_whole_pipeline(spark, edge_dir):
    out = corpus_pipeline.run(spark, edge_dir)
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(None) == 2
    assert 8 in ids
