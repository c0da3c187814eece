"""The pipeline against brute-force versions of its stages, each on its own input."""

import public_tokenizers
import sentencepiece as lib

from ketframe.llm import pipeline
from tests.llm import test_decontaminate, test_line_dedup, test_quality_rules, test_simhash


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    last = pipeline.run(spark, sf).collect()
    frame, rows = docs, docs.collect()
    for name, stage in pipeline.STAGES[:-1]:
        frame = pipeline.materialize(stage(spark, frame, sf), "stage")
        assert frame.columns == docs.columns
        got = {(r.doc_id, r.text, r.n_chars) for r in frame.collect()}
        if name == "quality rules":
            full = [(r.lang, r.source, test_quality_rules.counts(r.text)) for r in rows]
            want = {(r.doc_id, r.text, r.n_chars) for r, (*_, kept) in zip(rows, test_quality_rules.verdicts(full)) if kept}
        elif name == "line dedup":
            cut = test_line_dedup.brute([(r.doc_id, r.text) for r in rows], 20)
            texts = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(gone)) for (i, t), gone in cut.items()}
            want = {(i, t, len(t)) for i, t in texts.items()}
            assert any(map(bool, cut.values()))
        elif name == "near-dedup":
            root = test_simhash.slow_similar({r.doc_id: r.text for r in rows})
            want = {(r.doc_id, r.text, r.n_chars) for r in rows if root[r.doc_id] == r.doc_id}
        else:
            found = test_decontaminate.brute([(r.doc_id, r.text) for r in rows], items, 13)
            want = {(r.doc_id, r.text, r.n_chars) for r, (*_, bad) in zip(rows, found) if not bad}
        assert got == want, name
        rows = frame.collect()
    processor = lib.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {(r.doc_id, tuple(r.ids), r.n_tokens, r.round_trip) for r in last} == {(r.doc_id, tuple(i := processor.encode(r.text)), len(i), True) for r in rows}


def test_empty_documents(spark, tmp_path, sf):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
