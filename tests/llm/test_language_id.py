import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ketframe.llm import language_id as op

SF = "/root/testdata/sf0.01"


def grams(word):
    """The features' definition, as strings."""
    s = f"<{word}>"
    out = [c for c in word] + [s[i : i + 2] for i in range(len(s) - 1)] + [s[i : i + 3] for i in range(len(s) - 2)]
    return out + [s[:4]] * (len(s) >= 4) + [s[-4:]] * (len(s) > 4)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    return op.fit(docs.where(op.fold(F.col("doc_id")) != op.HELD_OUT))


def test_features_follow_their_definition():
    words = ["a", "ab", "abc", "the", "thé", "日本", "x" * 300, "abcab"]
    f, starts = op.word_features(words)
    parts = np.split(f, starts[1:])
    for word, part in zip(words, parts):
        alone, _ = op.word_features([word])
        assert (alone == part).all()
        assert (part > 0).sum() == len(grams(word))
    seen = {}
    for word, part in zip(words, parts):  # equal n-grams of a kind share a bucket
        for i in range(len(word)):
            assert seen.setdefault(("one", word[i]), part[i + 1, 0]) == part[i + 1, 0]


def test_forward_backward_equals_all_labellings():
    rng = np.random.default_rng(1)
    for k, length in ((2, 1), (2, 7), (3, 6)):
        m = op.Model([str(i) for i in range(k)], {}, np.zeros((0, k)))
        m.moves = rng.standard_normal((k, k))
        e = rng.standard_normal((length, k))
        want, total = np.zeros((length, k)), 0
        for path in itertools.product(range(k), repeat=length):
            w = np.exp(e[range(length), path].sum() + sum(m.moves[a, b] for a, b in itertools.pairwise(path))) * np.exp(m.moves[:, path[0]]).sum()
            total += w
            want[range(length), path] += w
        assert np.allclose(op.word_probabilities(m, e, np.array([length])), want / total)


def test_blocks_equal_one_long_chain(monkeypatch):
    rng = np.random.default_rng(2)
    m = op.Model(["a", "b", "c"], {}, np.zeros((0, 3)))
    m.moves = rng.standard_normal((3, 3)) * 2
    lengths = np.array([1, 31, 32, 33, 500, 64, 2])
    e = rng.standard_normal((lengths.sum(), 3)) * 3
    got = op.word_probabilities(m, e, lengths)
    monkeypatch.setattr(op, "BLOCK", 1000)
    assert np.allclose(got, op.word_probabilities(m, e, lengths))


def test_gradient_raises_the_likelihood(model):
    assert model.languages == ["de", "en", "es", "fr"]
    assert (np.diag(model.moves) - np.where(np.eye(4) > 0, -np.inf, model.moves).max(1) > 1).all()  # staying is likelier than each move
    assert len(model.lexicon) and model.lexicon.keys() >= {"the", "und", "para"}


def test_held_out_accuracy(spark):
    rows = op.op12(spark, SF).collect()
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    test = [(r.lang_pred, truth[r.doc_id][0]) for r in rows if r.held_out]
    assert len(test) > 200 and sum(p == t for p, t in test) >= 0.98 * len(test)


def test_words_of_mixed_texts(spark, model):
    docs = [(r.lang, " ".join(r.text.split()[:60])) for r in spark.read.parquet(f"{SF}/documents.parquet").where((op.fold(F.col("doc_id")) == op.HELD_OUT) & (F.length("text") > 600)).collect()]
    of = {lang: [t for v, t in docs if v == lang][:8] for lang in ("en", "de", "fr")}
    rows = [(i, a, b, x + " " + y) for i, (a, b) in enumerate([("en", "de"), ("de", "fr"), ("fr", "en")]) for x, y in zip(of[a], of[b])]
    df = spark.createDataFrame(rows, "doc_id long, a string, b string, text string")
    right = total = 0
    for r in op.add_word_languages(df, model).collect():
        got = [w.lang for w in r.word_languages]
        assert [w.word for w in r.word_languages] == op.letter_words(r.text)
        half = len(op.letter_words(r.text.split(" ")[0])) and len(got) // 2
        right += sum(x == r.a for x in got[: half - 12]) + sum(x == r.b for x in got[half + 12 :])
        total += max(0, half - 12) + len(got[half + 12 :])
    assert total > 1000 and right >= 0.93 * total


def test_edges(spark, model):
    long = "the house and " * 60_000
    texts = [None, "", "  \n", "123 ½ --", "a", "der " * 3, "der " * 3, long, "日本 語", "\x00\x02\x03x", "İstanbul"]
    df = spark.createDataFrame([(None if i == 5 else i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, n int")
    out = op.add_language(df, model)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "lang_pred", "n", "score"] and len(rows) == len(texts)
    by = {r.text: r for r in rows}
    assert all(by[t].lang_pred == op.NONE and by[t].score == 0 for t in texts[:4])
    assert by["der " * 3].lang_pred == "de" and by[long].lang_pred == "en" and by[long].score > 0.9
    assert all(0 <= r.score <= 1 and r.lang_pred in [*model.languages, op.NONE] for r in rows)
    assert op.add_language(df.limit(0), model).count() == 0


def test_without_labels_or_with_one(spark):
    kind = "doc_id long, lang string, text string"
    assert op.fit(spark.createDataFrame([], kind)) is None
    nothing = spark.createDataFrame([(1, None, "a b"), (None, "en", "c d"), (2, "en", None)], kind)
    assert op.fit(nothing) is None
    assert [(r.lang_pred, r.score) for r in op.add_language(nothing, None).collect()] == [(op.NONE, 0.0)] * 3
    one = op.fit(spark.createDataFrame([(1, "en", "a b c"), (1, "en", "a b c")], kind))
    assert [(r.lang_pred, r.score) for r in op.add_language(nothing.where("doc_id = 1"), one).collect()] == [("en", 1.0)]
    empty = op.fit(spark.createDataFrame([(1, "en", "1 2"), (2, "de", "und")], kind))
    assert [r.lang_pred for r in op.add_language(spark.createDataFrame([(1, "und"), (2, "")], "i long, text string"), empty).collect()][1] == op.NONE
