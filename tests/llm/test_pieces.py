from __future__ import annotations

import hashlib
from collections import Counter

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from fettle.llm import pieces

FREQUENT = pieces.frequent
MODEL = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab  \n\tThé<s>🙂▁　½.1\x00日"), max_size=40), st.text(max_size=30))
def test_chunks_encode_like_whole_texts(a, b):
    table = pieces.ChunkTable(MODEL, size=20)
    for text in (a, b, a + b, b + " " + a):
        assert table.encode(text) == MODEL.encode(text)


def test_no_piece_crosses_a_marker():
    assert not pieces.can_cross(MODEL)


def test_rows_and_digests(odd_docs, no_docs):
    named = odd_docs.withColumnsRenamed({"n_chars": "ids"})
    got = pieces.encode_decode(named).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert list(r["ids"]) == MODEL.encode(r.text or "") and r.decoded == MODEL.decode(MODEL.encode(r.text or ""))
    for r in pieces.digests(pieces.encode_decode(odd_docs)).collect():
        ids = MODEL.encode(r.text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(MODEL.decode(ids).encode()).hexdigest()
    assert pieces.encode_decode(no_docs).count() == 0


def test_each_repeated_chunk_is_in_the_table_once(spark):
    texts = ["a bb  bb c", "a bb", None, "", " a ", "a▁bb d"] * 2 + ["lone words here"]
    rows = pieces.chunk_table(spark.createDataFrame([(t,) for t in texts], "text STRING")).collect()
    count = Counter(c for t in texts for c in pieces.ChunkTable(MODEL).chunks(t or ""))
    assert {r["chunk"]: r["n"] for r in rows} == {c: n for c, n in count.items() if n > 1} and len(rows) == len({r["chunk"] for r in rows})
    whole = pieces.ChunkTable(MODEL)
    for r in rows:
        assert list(r["ids"]) == whole.encode(r["chunk"]) or not r["chunk"] or r["chunk"][0] == " "


def test_any_part_of_the_table_gives_the_same_ids(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    want = {r.doc_id: MODEL.encode(r.text) for r in docs.collect()}
    for most in (0, 2_000, 1 << 24):
        monkeypatch.setattr(pieces, "frequent", lambda table, most=most: FREQUENT(table, most))
        assert {r.doc_id: list(r["ids"]) for r in pieces.encode_decode(docs).collect()} == want
    table = pieces.chunk_table(docs)
    assert FREQUENT(table, 0).num_rows == 0 < FREQUENT(table, 2_000).num_rows < FREQUENT(table, 1 << 24).num_rows


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for r in pieces.encode_decode(docs).collect():
        assert list(r["ids"]) == MODEL.encode(r.text)
