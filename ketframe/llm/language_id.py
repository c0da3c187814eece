"""Language of every word and text by a linear-chain conditional random field.

A word's emission is a sum of weights: of its n-grams of one to three characters between boundary marks (hashed), of
its affixes (the first and last one to three letters, which are the n-grams with a mark and one longer each way) and of
its entry in a lexicon. The lexicon holds the LEXICON most frequent words of all learnable documents with the
logarithms of their shares by language; counts are made by task and added by word. Transitions between
languages are learned with the rest, from spans of documents of two languages put one behind the other, since a
document has one label but may hold words of several languages. Weights maximise the likelihood of a bounded sample
(SAMPLE documents, about the same number a language, WINDOW words of each from a hashed place); nothing else is sampled.

Forward and backward run over whole texts. A text is cut into blocks of BLOCK words; transfer matrices of all blocks
of a batch are multiplied out side by side, carried along each text, and then every block fills in its own words. So a
very long text takes few steps of its own and no prefix is taken. A text's language is the one with the largest sum
of word probabilities, and its score that language's share.

Defined cases: a text that is null or has no letter is `und` with score 0, and so is every text where nothing can be
learned; an equal share goes to the first language by name; documents with a null id, language or text are not learned
from; repeated rows count each; output columns replace input columns of their name, others pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketframe.llm._common import bounded_batches, documents, materialize

NONE = "und"
FOLDS, HELD_OUT = 4, 2
LEXICON = 20_000
#: Words and languages that a task counts before it gives them away.
TASK_COUNTS = 400_000
SAMPLE = 2_400
WINDOW = 48
STEPS = 40
RATE = 0.25
DECAY = 1e-4
BUCKETS = 1 << 14
BLOCK = 32
#: Distinct words whose emissions a task keeps, and words of one run of forward and backward.
TABLE_WORDS = 200_000
RUN_WORDS = 400_000
SEED = 12

_WORD = re.compile(r"[^\W\d_]+")
_BEGIN, _END = "\x02", "\x03"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS))


def letter_words(text: str | None) -> list[str]:
    """Lower-case runs of letters; runs of other numerals alone are dropped when they are looked up."""
    return _WORD.findall(text.lower()) if text else []


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (positions x 5, bucket 0 for none) of all words in a row, and where each word starts."""
    codes = np.frombuffer("".join([f"{_BEGIN}{w}{_END}" for w in words]).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    n = len(codes)
    begins, ends = codes == 2, codes == 3
    ahead = np.zeros((4, n), np.uint64)
    open_ = np.ones((4, n), bool)  # whether the n-gram from here still lies in the word
    for k in range(4):
        ahead[k, : n - k] = codes[k:]
        if k:
            open_[k] = open_[k - 1] & ~np.r_[ends[k - 1 :], np.ones(k - 1, bool)][:n]
            open_[k, n - k :] = False
    out = np.zeros((n, 5), np.int32)
    sums = np.zeros(n, np.uint64)
    last = np.zeros(n, bool)  # the four-gram that ends the word
    last[: max(n - 3, 0)] = ends[3:]
    for k in range(4):
        sums = (sums ^ (ahead[k] + np.uint64(k + 1))) * _MIX[k]
        bucket = 1 + ((sums >> np.uint64(29)) % np.uint64(BUCKETS - 1)).astype(np.int32)
        if k < 3:
            out[:, k] = np.where(open_[k] & ~((k == 0) & (begins | ends)), bucket, 0)
        else:
            out[:, 3] = np.where(open_[3] & begins, bucket, 0)
            out[:, 4] = np.where(open_[3] & last & ~begins, bucket, 0)
    return out, np.flatnonzero(begins)


class Model:
    """Weights of features, of the lexicon and of transitions between `languages`."""

    def __init__(self, languages: list[str], lexicon: dict[str, int], shares: np.ndarray):
        k = len(languages)
        self.languages, self.lexicon = languages, lexicon
        self.shares = np.vstack([shares.reshape(-1, k), np.zeros(k)])  # the last row stands for words not in it
        self.weights = np.zeros((BUCKETS, k))
        self.trust = np.full(k, 0.5)
        self.bias = np.zeros(k)
        self.moves = 2 * np.eye(k)

    def entries(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self.lexicon.get(w, -1) for w in words), np.int64, len(words))

    def emissions(self, words: list[str]) -> np.ndarray:
        features, starts = word_features(words)
        return self.emit(features, starts, self.entries(words))

    def emit(self, features: np.ndarray, starts: np.ndarray, entries: np.ndarray) -> np.ndarray:
        size = np.maximum(np.add.reduceat((features > 0).sum(1), starts), 1)
        return np.add.reduceat(self.weights[features].sum(1), starts) / np.sqrt(size)[:, None] + self.trust * self.shares[entries] + self.bias


def marginals(p: np.ndarray, real: np.ndarray, moves: np.ndarray, text_blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward vectors and word probabilities of all blocks (blocks x BLOCK x languages).

    p: exponentials of emissions, 1 where not real; text_blocks: number of blocks of each text, in order.
    """
    n, length, k = p.shape
    keep = real[..., None]
    start = np.cumsum(text_blocks) - text_blocks
    entry, leave = np.full((n, k), 1.0 / k), np.full((n, k), 1.0)
    if (text_blocks > 1).any():
        carry = np.broadcast_to(np.eye(k), (n, k, k)).copy()
        for t in range(length):
            step = (carry.reshape(-1, k) @ moves).reshape(n, k, k) * p[:, t, None, :]
            step /= step.max(axis=(1, 2), keepdims=True)
            carry = np.where(keep[:, t, None], step, carry)
        for j in range(int(text_blocks.max()) - 1):
            at = start[text_blocks > j + 1] + j
            v = np.einsum("nk,nkl->nl", entry[at], carry[at])
            entry[at + 1] = v / v.sum(1, keepdims=True)
            at = (start + text_blocks - 1)[text_blocks > j + 1] - j
            v = np.einsum("nkl,nl->nk", carry[at], leave[at])
            leave[at - 1] = v / v.sum(1, keepdims=True)
    forward, backward = np.empty_like(p), np.empty_like(p)
    a = entry
    for t in range(length):
        step = (a @ moves) * p[:, t]
        a = np.where(keep[:, t], step / step.sum(1, keepdims=True), a)
        forward[:, t] = a
    b = leave
    for t in reversed(range(length)):
        backward[:, t] = b
        step = (p[:, t] * b) @ moves.T
        b = np.where(keep[:, t], step / step.sum(1, keepdims=True), b)
    gamma = forward * backward
    return forward, backward, np.where(keep, gamma / gamma.sum(2, keepdims=True), 0)


def word_probabilities(model: Model, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probabilities of the languages of every word; words of all texts in a row, lengths of at least one."""
    blocks = -(-lengths // BLOCK)
    p = np.ones((int(blocks.sum()) * BLOCK, len(model.languages)))
    real = np.zeros(len(p), bool)
    first = (np.cumsum(blocks) - blocks) * BLOCK
    place = np.arange(len(emissions)) + np.repeat(first - (np.cumsum(lengths) - lengths), lengths)
    p[place] = np.exp(np.maximum(emissions - emissions.max(1, keepdims=True), -30))
    real[place] = True
    k = p.shape[1]
    return marginals(p.reshape(-1, BLOCK, k), real.reshape(-1, BLOCK), np.exp(model.moves - model.moves.max()), blocks)[2].reshape(-1, k)[place]


def sequences(sample: list[tuple[str, list[str]]], languages: list[str]) -> list[list[tuple[list[str], int]]]:
    """Training sequences, as spans with a language: every second one goes over to a document of another language."""
    rng = np.random.default_rng(SEED)
    code = {v: k for k, v in enumerate(languages)}
    out = []
    for i, (lang, words) in enumerate(sample):
        j = int(rng.integers(len(sample)))
        cut = int(rng.integers(1, WINDOW))
        if i % 2 and sample[j][0] != lang and len(words) > 1:
            cut = min(cut, len(words) - 1)
            out.append([(words[:cut], code[lang]), (sample[j][1][: WINDOW - cut], code[sample[j][0]])])
        else:
            out.append([(words[:WINDOW], code[lang])])
    return out


def train(model: Model, sample: list[tuple[str, list[str]]]) -> Model:
    """Maximise the likelihood of the sample's sequences by STEPS of Adam."""
    rows = sequences(sample, model.languages)
    if not rows or len(model.languages) < 2:
        return model
    k = len(model.languages)
    table: dict[str, int] = {}
    at = np.full((len(rows), WINDOW), -1)
    label = np.zeros((len(rows), WINDOW), np.int64)
    for i, spans in enumerate(rows):
        words = [(w, code) for span, code in spans for w in span][:WINDOW]
        at[i, : len(words)] = [table.setdefault(w, len(table)) for w, _ in words]
        label[i, : len(words)] = [code for _, code in words]
    real = at >= 0
    features, starts = word_features(list(table))
    entries = model.entries(list(table))
    size = np.sqrt(np.maximum(np.add.reduceat((features > 0).sum(1), starts), 1))
    of_word = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(features)]))
    truth = np.eye(k)[label] * real[..., None]
    both = real[:, 1:] & real[:, :-1]
    seen = np.einsum("nta,ntb->ab", truth[:, :-1] * both[..., None], truth[:, 1:])
    held = [model.weights, model.trust, model.bias, model.moves]
    mean, square = [np.zeros_like(h) for h in held], [np.zeros_like(h) for h in held]
    for step in range(1, STEPS + 1):
        e = model.emit(features, starts, entries)[at]
        p = np.where(real[..., None], np.exp(e - e.max(2, keepdims=True)), 1.0)
        moves = np.exp(model.moves)
        forward, backward, gamma = marginals(p, real, moves, np.ones(len(rows), np.int64))
        pair = forward[:, :-1, :, None] * moves * (p * backward)[:, 1:, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        off = (truth - gamma)[real]
        by_word = np.stack([np.bincount(at[real], weights=c, minlength=len(starts)) for c in off.T], axis=1)
        flat, spread = features.ravel(), np.repeat((by_word / size[:, None])[of_word], features.shape[1], axis=0)
        up = np.stack([np.bincount(flat, weights=c, minlength=BUCKETS) for c in spread.T], axis=1)
        up[0] = 0
        ups = [up, (by_word * model.shares[entries]).sum(0), by_word.sum(0), seen - (pair * both[..., None, None]).sum(axis=(0, 1))]
        for h, m, s, u in zip(held, mean, square, ups):
            u = u / real.sum() - DECAY * h
            m += 0.1 * (u - m)
            s += 0.01 * (u * u - s)
            h += RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return model


def word_counts(df: DataFrame) -> DataFrame:
    """(word, lang, n) over df's (lang, text): counted by task, added by word and language."""
    bounded_batches(df.sparkSession)
    names = ["word", "lang", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, counts in found.items():
                for at in range(0, len(counts), 50_000):
                    part = list(counts.items())[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([lang] * len(part), pa.string()), pa.array([c for _, c in part], pa.int64())], names=names)
            found.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                found.setdefault(lang.as_py(), Counter()).update(letter_words(text.as_py()))
                if sum(map(len, found.values())) > TASK_COUNTS:
                    yield from rows()
        yield from rows()

    return df.select("lang", "text").mapInArrow(count, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))


def lexicon(df: DataFrame, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """The LEXICON most frequent words, and the centred logarithms of their shares by language."""
    counts = word_counts(df).groupBy("word").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))  # an entry a language at most
    first = materialize(counts.orderBy(F.desc("n"), "word").limit(LEXICON), "lexicon")  # collected at once, every partition's first would go to the driver
    top = [r for r in first.orderBy(F.desc("n"), "word").collect() if has_letter(r.word)]
    n = np.array([[r.by.get(v, 0) for v in languages] for r in top], float).reshape(-1, len(languages))
    share = (n + 0.5) / np.maximum(n.sum(0), 1)
    logs = np.log(share / share.sum(1, keepdims=True)) if len(n) else n
    return {r.word: i for i, r in enumerate(top)}, logs - logs.mean(1, keepdims=True) if len(n) else n


def windows(df: DataFrame, languages: dict[str, int]) -> list[tuple[str, list[str]]]:
    """WINDOW words from a hashed place of about SAMPLE documents, at most twice as many; df: (h, lang, text)."""
    each = max(1, SAMPLE // len(languages))
    share = F.element_at(F.create_map(*[F.lit(v) for lang, n in languages.items() for v in (lang, each / n)]), F.col("lang"))
    chosen = df.where((F.pmod(F.shiftright("h", 8), F.lit(1 << 30)) / F.lit(float(1 << 30))) < share)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(2)):
                found = [w for w in letter_words(text.as_py()) if has_letter(w)]
                at = h % max(1, len(found) - WINDOW + 1)
                words.append(found[at : at + WINDOW])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], names=["h", "lang", "words"])

    cuts = chosen.select("h", "lang", "text").mapInArrow(cut, "h long, lang string, words array<string>").where(F.size("words") > 0)
    first = materialize(cuts.orderBy("h", "lang", "words").limit(2 * SAMPLE), "windows")
    return [(r.lang, list(r.words)) for r in first.orderBy("h", "lang", "words").collect()]


def fit(df: DataFrame) -> Model | None:
    """df: (doc_id, lang, text) of learnable rows. None where there is no text with a letter."""
    known = df.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select(F.xxhash64(F.col("doc_id").cast("string"), F.crc32(F.col("text").cast("binary"))).alias("h"), F.col("lang").cast("string").alias("lang"), "text")
    languages = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not languages:
        return None
    names = sorted(languages)
    sample = windows(known, {v: languages[v] for v in names})
    return train(Model(names, *lexicon(known, names)), sample) if sample else None


class EmissionTable(dict):
    """Word -> row of the emissions; -1 for what has no letter. New words wait until `fill`."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.pending = model, []
        self.rows = np.zeros((0, len(model.languages)))

    def __missing__(self, word: str) -> int:
        if has_letter(word):
            self[word] = at = len(self.rows) + len(self.pending)
            self.pending.append(word)
            return at
        self[word] = -1
        return -1

    def fill(self) -> None:
        if self.pending:
            parts = [self.model.emissions(self.pending[k : k + 20_000]) for k in range(0, len(self.pending), 20_000)]
            self.rows, self.pending = np.vstack([self.rows, *parts]), []


def probabilities(model: Model, batches: Iterator[pa.Array]) -> Iterator[list[tuple[list[list[str]], np.ndarray, np.ndarray]]]:
    """For every batch of texts its runs of about RUN_WORDS words: words of each text, their number, and the languages' probabilities of all words in a row."""
    table = EmissionTable(model)
    for column in batches:
        out, held, many = [], [], 0
        for i, text in enumerate(column):
            held.append(letter_words(text.as_py()))
            many += len(held[-1])
            if many > RUN_WORDS or i == len(column) - 1:
                at = [np.fromiter(map(table.__getitem__, words), np.int64, len(words)) for words in held]
                table.fill()
                words = [[w for w, k in zip(ws, a.tolist()) if k >= 0] if (a < 0).any() else ws for ws, a in zip(held, at)]
                at = [a[a >= 0] for a in at]
                lengths = np.array([len(a) for a in at])
                some = lengths[lengths > 0]
                out.append((words, lengths, word_probabilities(model, table.rows[np.concatenate(at)], some) if len(some) else np.zeros((0, len(model.languages)))))
                held, many = [], 0
                if len(table) > TABLE_WORDS:
                    table = EmissionTable(model)
        yield out


def add_language(df: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """df with the language of each text and the share of its words' probability that is this language's."""
    bounded_batches(df.sparkSession)

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for out in probabilities(model, batches):
            langs, scores = [], [np.zeros(0)]
            for _, lengths, found in out:
                some = lengths > 0
                score, best = np.zeros(len(lengths)), np.full(len(lengths), -1)
                if some.any():
                    shares = np.add.reduceat(found, np.cumsum(lengths[some]) - lengths[some]) / lengths[some][:, None]
                    score[some] = np.clip(np.round(shares.max(1), 6), 0, 1)
                    best[some] = np.round(shares, 9).argmax(1)
                langs += [model.languages[b] if b >= 0 else NONE for b in best.tolist()]
                scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], names=["lang", "score"])

    if model is None:
        return df.withColumns({lang_col: F.lit(NONE), score_col: F.lit(0.0)})
    both = "__ketframe_lang"
    out = df.withColumn(both, predict(F.col(text_col)))
    return out.withColumns({lang_col: F.col(both)["lang"], score_col: F.col(both)["score"]}).drop(both)


def add_word_languages(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "word_languages") -> DataFrame:
    """df with every word of each text in its order, the word's likeliest language and that language's probability."""
    bounded_batches(df.sparkSession)

    @F.arrow_udf("array<struct<word: string, lang: string, p: double>>")
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for out in probabilities(model, batches):
            words = [w for held, _, _ in out for ws in held for w in ws]
            found = np.concatenate([np.zeros((0, len(model.languages))), *(p for _, _, p in out)])
            names = np.array(model.languages, object)[found.argmax(1)] if len(found) else []
            ends = np.cumsum(np.concatenate([[0], *(lengths for _, lengths, _ in out)]))
            items = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(names, pa.string()), pa.array(found.max(1) if len(found) else [], pa.float64())], names=["word", "lang", "p"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)

    return df.withColumn(out_col, label(F.col(text_col)))


def op12(spark, sf_dir: str) -> DataFrame:
    """Contract query: language of every document, learned from three of four folds."""
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    model = fit(docs.where(~held_out))
    return add_language(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
