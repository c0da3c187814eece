import hashlib

import public_tokenizers
import pytest
import sentencepiece as lib

from ketframe.llm import sentencepiece as op

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def processor():
    return lib.SentencePieceProcessor(model_file=PATH)


def test_edges(spark, processor):
    texts = [None, "", " ", "  a  b ", "a▁b", "▁", "\n\n x\ty\r\n", "x\x00y", "日本 \U0001f600 é", "word " * 3000, "a", "a", "\xa0 b", "tail ", "   ", "<s> </s> <unk>", "end� ​"]
    df = spark.createDataFrame([(i % 12, t, "k") for i, t in enumerate(texts)], "doc_id int, text string, decoded string")
    rows = op.sentencepiece_round_trip(df.coalesce(1), PATH).collect()
    assert len(rows) == len(texts)
    for t, r in zip(texts, rows):
        ids = processor.encode(t or "")
        assert r.ids == ids, repr(t)
        assert r.decoded == processor.decode(ids), repr(t)


def test_table_against_library(spark, sf, processor):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op.op9(spark, sf).collect():
        ids = processor.encode(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(processor.decode(ids).encode()).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op.sentencepiece_round_trip(df, PATH).count() == 0
