"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Each text becomes a few statistics of its characters and words (STATISTICS), never its language,
source, id or label. Standardised, they pass through a fixed random map whose inner products
approximate a Gaussian kernel. Each partition adds up its part of the normal equations; the parts
are added again by SLOTS tasks, row after row, and only SLOTS sums of a fixed size reach the driver,
which solves for the weights. Raw scores of a fold that the weights have not seen are counted in
bins, and pooling adjacent violators turns the counts into a monotone map to probabilities.

All labelled rows outside the held-out fold are used; nothing is sampled. Folds come from crc32 of
the id: 0 is held out, 1 calibrates, 2 to 4 fit the weights.

Defined cases: a null text is the empty text and gets a score; a null label is no label; several
labels of an id are averaged; null ids are scored but never learned from and not held out;
repeated rows count each; without labels every score is 0.5; output columns replace input columns
of their name, others pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketframe.llm._common import bounded_batches, documents, materialize

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_spread", "unique_words", "repeats_of_last_word", "words_a_line",
    "capitals", "digits", "spaces", "line_ends", "stops_and_commas", "exclamations", "symbols", "other_marks", "not_ascii", "byte_entropy",
)
FEATURES = 160
WIDTH = 4.0
RIDGE = 1e-3
SEED = 20
FOLDS = 5
SLOTS = 32
RAW_BINS = 2_000
#: Raw scores are clipped to this range.
RAW = (-0.5, 1.5)
THRESHOLD = 0.3
TEMP = "__ketframe_"

_CLASS = np.zeros(256, np.int8)  # of bytes: the places in `statistics`
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:", b"!?", b"#*$%&|<>"), 1):
    _CLASS[list(_chars)] = _i
_CLASS[[c for c in range(33, 127) if not _CLASS[c] and not chr(c).isalpha()]] = 8
_CLASS[128:] = 9


def statistics(text: str | None) -> np.ndarray:
    """STATISTICS of a text, in their order."""
    data = (text or "").encode()
    words = data.split()
    n, many = max(len(data), 1), max(len(words), 1)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = np.bincount(_CLASS, weights=count, minlength=10) / n
    some = count[count > 0] / n
    size = np.fromiter(map(len, words), np.int64, len(words))
    lines = count[10] + 1
    return np.array([
        np.log1p(len(data)), np.log1p(len(words)), size.mean() if len(words) else 0, np.log1p(size.std()) if len(words) else 0, len(set(words)) / many,
        sum(map(eq, words, words[1:])) / many, np.log1p(len(words) / lines), *share[1:10], -(some * np.log2(some)).sum(),
    ])


def add_statistics(df: DataFrame, text_col: str = "text", out_col: str = "statistics") -> DataFrame:
    bounded_batches(df.sparkSession)

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return df.withColumn(out_col, of(F.col(text_col)))


def partition_sums(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum over all batches of what `part` makes of each: `size` numbers. At most SLOTS rows reach the driver.

    Partitions are added in their order, so that a task that runs again does not move the last digits.
    """
    schema = pa.schema([("slot", pa.int32()), ("place", pa.int32()), ("sums", pa.binary())])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, some = np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
                some = True
        if some:
            place = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"slot": [place % SLOTS], "place": [place], "sums": [total.tobytes()]}, schema)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, sums in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                totals[slot] = totals.get(slot, 0) + np.frombuffer(sums)
        for slot, total in totals.items():
            yield pa.RecordBatch.from_pydict({"slot": [slot], "place": [slot], "sums": [total.tobytes()]}, schema)

    kind = "slot int, place int, sums binary"
    rows = df.mapInArrow(first, kind).repartition(SLOTS, "slot").sortWithinPartitions("place").mapInArrow(second, kind).collect()
    return sum((np.frombuffer(r.sums) for r in sorted(rows)), np.zeros(size))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


class Model:
    """Weights and calibration; a few hundred kilobytes."""

    def __init__(self, width: float = WIDTH, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.turn = rng.standard_normal((len(STATISTICS), features)) / width
        self.shift = rng.uniform(0, 2 * np.pi, features)
        self.mean, self.scale = np.zeros(len(STATISTICS)), np.ones(len(STATISTICS))
        self.weights = np.zeros(self.size)
        self.weights[0] = 0.5
        self.bins: np.ndarray | None = None

    @property
    def size(self) -> int:
        return 1 + len(STATISTICS) + len(self.shift)

    def features(self, x: np.ndarray) -> np.ndarray:
        """A constant, the standardised statistics and their random Fourier features."""
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(x), 1)), x, np.sqrt(2 / len(self.shift)) * np.cos(x @ self.turn + self.shift)])

    def raw_bin(self, x: np.ndarray) -> np.ndarray:
        raw = (self.features(x) @ self.weights - RAW[0]) / (RAW[1] - RAW[0])
        return np.clip((raw * RAW_BINS).astype(np.int64), 0, RAW_BINS - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.bins is None:
            return np.clip(self.features(x) @ self.weights, 0, 1)
        return self.bins[self.raw_bin(x)]


def isotonic(count: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Non-decreasing least-squares shares by pooling adjacent violators; bins without rows are interpolated."""
    have = np.flatnonzero(count)
    pools: list[list[float]] = []  # rows, positives, bins
    for b in have:
        pools.append([count[b], positive[b], 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n, p, k = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + p, pools[-1][2] + k]
    shares = np.repeat([p / n for n, p, _ in pools], [k for *_, k in pools])
    return np.interp(np.arange(len(count)), have, shares)


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS))


def fit(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, statistics_col: str = "statistics") -> Model:
    """rows: ids and statistics; cheap to read several times."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    train = rows.select(F.col(id_col).alias("id"), F.col(statistics_col).alias("x")).join(known, "id").select("x", "y", fold(F.col("id")).cast("int").alias("fold")).where("fold <> 0")
    train = materialize(train, "training")
    model, d = Model(), len(STATISTICS)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column(0))
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    sums = partition_sums(train.where("fold > 1"), moments, 1 + 2 * d)
    if not sums[0]:
        return model
    model.mean = sums[1 : d + 1] / sums[0]
    spread = np.sqrt(np.maximum(sums[d + 1 :] / sums[0] - model.mean**2, 0))
    model.scale = np.where(spread > 1e-9, spread, 1.0)

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z = model.features(_matrix(batch.column(0)))
        return np.concatenate([(z.T @ z).ravel(), z.T @ batch.column(1).to_numpy()])

    n = model.size
    sums = partition_sums(train.where("fold > 1"), equations, n * n + n)
    gram, right = sums[: n * n].reshape(n, n), sums[n * n :]
    penalty = RIDGE * gram[0, 0] * np.eye(n)
    penalty[0, 0] = 0
    model.weights = np.linalg.solve(gram + penalty, right)

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        at = model.raw_bin(_matrix(batch.column(0)))
        return np.concatenate([np.bincount(at, minlength=RAW_BINS), np.bincount(at, weights=batch.column(1).to_numpy(), minlength=RAW_BINS)])

    counts = partition_sums(train.where("fold = 1"), histogram, 2 * RAW_BINS)
    if counts[:RAW_BINS].sum():
        model.bins = isotonic(counts[:RAW_BINS], counts[RAW_BINS:])
    return model


def score(rows: DataFrame, model: Model, statistics_col: str = "statistics", out_col: str = "score") -> DataFrame:
    @F.arrow_udf("double")
    def of(x: pa.Array) -> pa.Array:
        return pa.array(np.round(model.score(_matrix(x)), 6))

    return rows.withColumn(out_col, of(F.col(statistics_col)))


def classify_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", score_col: str = "score", predicted_col: str = "predicted", held_out_col: str = "held_out") -> DataFrame:
    """df with a score, the prediction at THRESHOLD, and whether the row's fold is held out."""
    x = TEMP + "statistics"
    rows = materialize(add_statistics(df, text_col, x), "statistics")
    out = score(rows, fit(rows.select(id_col, x), labels, id_col, label_col, x), x, score_col)
    return out.withColumns({predicted_col: (F.col(score_col) >= THRESHOLD).cast("int"), held_out_col: F.coalesce(fold(F.col(id_col)) == 0, F.lit(False))}).drop(x)


def op10(spark, sf_dir: str) -> DataFrame:
    """Contract query: quality of every document."""
    rows = materialize(add_statistics(documents(spark, sf_dir).select("doc_id", "text")).drop("text"), "statistics")
    model = fit(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "quality")
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return score(rows, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
