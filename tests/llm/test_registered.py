"""Every registered corpus query over a whole small table, and the pipeline against its stages one by one."""

import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
import corpus_pipeline
from sightline.llm import queries
from sightline.llm.words import vocabulary_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()


def test_all_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(entry_point.queries()) > set(queries.QUERIES) | {"pipeline"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    expected = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, FOLDER).select(*expected.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected.fetchall()))


@pytest.mark.parametrize("name, columns", [
    ("op2_bpe", {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}),
    ("op6_toxicity", {"doc_id", "held_out", "score", "predicted"}),
    ("op8_langid", {"doc_id", "held_out", "lang_pred", "score"}),
    ("op9_substrings", {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}),
    ("op10_secrets", {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}),
    ("op3_minhash", {"doc_id", "n_shingles", "component_id", "kept"}),
    ("op11_alignment", {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}),
])
def test_query_has_a_row_per_document(spark, documents, name, columns):
    got = queries.QUERIES[name](spark, FOLDER)
    assert set(got.columns) == columns
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(d["doc_id"] for d in documents)
    folds = {"op6_toxicity": (5, 0), "op8_langid": (4, 2)}
    if name in folds:
        n, left = folds[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == left) for r in rows)
    if name == "op8_langid":
        truth = {d["doc_id"]: d["lang"] for d in documents}
        assert np.mean([truth[r.doc_id] == r.lang_pred for r in rows if r.held_out]) > 0.75
    if name == "op2_bpe":
        library, texts = Tokenizer.from_file(vocabulary_path()), {d["doc_id"]: d["text"] for d in documents}
        for r in rows:
            ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_nearest_query_finds_most(spark):
    rows = pq.read_table(f"{FOLDER}/embeddings.parquet").to_pydict()
    ids, vectors = np.array(rows["vec_id"]), np.array(rows["embedding"], float)
    units = vectors / np.sqrt((vectors ** 2).sum(axis=1))[:, None]
    got = queries.QUERIES["op1_nearest"](spark, FOLDER).toPandas()
    hits = wanted = 0
    for q in np.flatnonzero(ids % 50 == 0):
        scores = units @ units[q]
        scores[q] = -9
        best = set(ids[np.lexsort((ids, -scores))[:5]])
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and (np.diff(own.score) <= 0).all()
        hits, wanted = hits + len(best & set(own.vec_id)), wanted + 5
    assert hits >= 0.9 * wanted


def test_pipeline_is_its_stages_in_order(spark, documents):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), "stage")
        counts.append(docs.count())
        if name != "best-fit packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert counts[0] >= counts[1] >= counts[2] == counts[3]
    texts = {d["text"] for d in documents}
    assert counts[0] > 0.97 * len(documents) and counts[1] <= len(texts)
    whole = corpus_pipeline.run(spark, FOLDER).drop("sequence_id", "offset").collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, docs.drop("sequence_id", "offset").collect()))


def test_pipeline_stages_on_odd_documents(spark, make_docs):
    rows = [(1, "Plain words of a text, said again and again."), (2, None), (3, ""), (4, "123"), (5, "token=abcdefghij"),
            (5, "token=abcdefghij"), (6, "token=abcdefghij"), (None, "no identifier"), (7, "long word " * 30_000),
            (None, "no identifier"), (None, "token=abcdefghij")]
    docs = make_docs(rows).fillna("en", ["lang"])
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, FOLDER)
    assert {r.doc_id for r in docs.collect()} == {1, 2, 4, 5, 7, None}
    kept = corpus_pipeline.language_id(spark, make_docs(rows).fillna("en", ["lang"]), FOLDER)
    assert {r.doc_id for r in kept.collect()} == {1, 5, 6, 7, None}
    untaught = corpus_pipeline.language_id(spark, make_docs(rows), FOLDER)
    assert {r.doc_id for r in untaught.collect()} == {1, 5, 6, 7, None}
    masked = corpus_pipeline.secrets(spark, make_docs([(5, "token=abcdefghij"), (2, None)]), FOLDER).collect()
    assert {(r.doc_id, r.text, r.n_chars) for r in masked} == {(5, "[SECRET]", 8), (2, None, None)}


def test_pipeline_of_nothing(spark, make_docs):
    docs = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.collect() == []
