import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
from quern.llm import pieces

LIB = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" aethornisd\n▁.é|"), st.characters(blacklist_categories=("Cs",))), max_size=120))
def test_ids_equal_the_library(text):
    m = pieces.model()
    got = np.frombuffer(m.encode(text), np.int32)
    assert got.tolist() == LIB.encode(text)
    assert m.decode(got) == text.replace("▁", " ")


def test_long_segments_stream():
    m = pieces.model()
    for text in ("thereof" * 3000, "ab" * 5000, " " * 400 + "x", "é漢" * 900, "internationalization" * 700):
        assert np.frombuffer(m.encode(text), np.int32).tolist() == LIB.encode(text)
    parts = list(m.stream("thereof" * 3000))
    assert len(parts) > 200 and max(map(len, parts)) <= 3 * m.longest


def test_streaming_whole_texts_of_the_table_commits_and_equals_the_library(spark, sf_dir):
    m = pieces.model()
    commits = 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        s = (" " + r.text).replace(" ", pieces.MARK) if r.text else ""
        parts = list(m.stream(s))
        commits += len(parts) - 1
        assert [i for p in parts for i in p] == LIB.encode(r.text or "")
        assert all(len(p) <= 4 * m.longest for p in parts)
    assert commits > 1000


def test_round_trip_decodes_the_returned_ids(spark):
    m = pieces.Model(pieces.MODEL)
    m.encode("some words")
    m.spaced["words"] = m.encode("others")  # wrong ids from the memo must show
    assert m.decode(np.frombuffer(m.encode("some words"), np.int32)) != "some words"
    df = spark.createDataFrame([(1, "a▁b"), (2, "a b"), (3, "▁")], "doc_id long, text string")
    assert sorted((r.doc_id, r.round_trip) for r in pieces.encoded(df).collect()) == [(1, False), (2, True), (3, False)]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, None), (7001, ""), (7002, "a b" * 20000), (7001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "doc_id as piece_ids2", "1 as n")
    out = pieces.decoded(pieces.encoded(df))
    got = sorted(((r.doc_id, r.piece_ids, r.n_pieces, r.round_trip, r.decoded) for r in out.collect()), key=lambda r: str(r[0]))
    want = sorted(((d, LIB.encode(t or ""), len(LIB.encode(t or "")), True, t or "") for d, t in rows), key=lambda r: str(r[0]))
    assert got == want


def test_empty_table(spark):
    assert pieces.encoded(spark.createDataFrame([], "doc_id long, text string")).count() == 0
