"""The stages one by one and in a row, on a small corpus with planted cases."""

import os
import zlib

import pytest

import corpus_pipeline
from wordloom.llm import tokens
from wordloom.llm.queries import QUERIES, SQL, tokenizer_path

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, last = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "tokens":
            assert out.columns == columns
            if name != "mixing":
                assert out.count() <= docs.count() and out.join(docs, columns, "left_anti").count() == 0
        last, docs = docs, out
    ids = {r.doc_id: r.text for r in last.collect()}
    got = docs.collect()
    whole = tokens.load(tokenizer_path())[0]
    assert len(got) == last.count()
    for r in got[:50]:
        e = [*whole.encode(ids[r.doc_id], add_special_tokens=False).ids, 0]
        assert r.n_tokens == len(e) and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in e))


def test_registration():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11)) and set(SQL) <= set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_take_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "the a of " * 9, "en", "s", 1), (3, "the a of and to " * 9, "en", "s", 1), (3, "the a of and to " * 9, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, DATA).count() >= 0
