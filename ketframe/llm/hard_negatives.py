"""Hard-negative mining by product quantisation with stored residual norms.

Components are scaled and floored to whole numbers, so every score is a whole number. A codebook of whole-number
centroids a segment (SEGMENT components) is fitted on a bounded sample; every row is indexed by its codes and by the
length of what each segment leaves over, rounded up. For an anchor, the sum of its lookup tables at a row's codes
differs from the true score by at most the sum, over segments, of anchor length times residual length. So a row
whose interval misses what is looked for cannot be part of the result, whatever the codebooks are; the others are
scored exactly. Nothing is approximate in the end, only the work depends on the fit.

Two scans of the index for each block of ANCHOR_BLOCK anchors: the first finds positives, the second fills all
windows that the positives open. Anchors of a block go to every task (their number is bounded; blocks grow with the
table, as a fixed query set against all rows does); rows never move. A task keeps the best few of each window, whose
worst raises the bar for its next rows, and gives those away at its end: a few rows a window and task are shuffled.

Defined cases: a row with a null id, label or vector, or with a null or non-finite component (before or after scaling)
takes no part; of several rows with one id the one with the smallest label, then vector, counts; a shorter vector
ends in zeros; fewer positives or negatives than asked for are all given; a positive score below zero opens no window;
ties go to the smaller id; no rows or no anchors give an empty result; other columns of the input are not read. Where
scores may pass 2^53 the same steps run on Python's integers, and a score beyond a long is given as the nearest long.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ketframe.llm._common import materialize

SEGMENT = 2
CENTROIDS = 256
#: Rows that codebooks are fitted on, those with the smallest hash of their id.
SAMPLE = 4_096
ROUNDS = 6
#: Anchors that one pair of scans serves; 64 components are 16 MB.
ANCHOR_BLOCK = 16_384
#: Anchors and rows of one tile, a dense matrix in a task.
TILE_ANCHORS, TILE_ROWS = 256, 2_048
EXACT = 2.0**53

INDEX = "id long, label long, codes binary, residuals binary, vec binary"
FOUND = "anchor_id long, positive_id long, positive_score binary, id long, score binary"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def codebooks(sample: np.ndarray, width: int) -> list[np.ndarray]:
    """Whole-number centroids of each segment: k-means from distinct rows of the sample in their order."""
    books = []
    for at in range(0, width, SEGMENT):
        x = sample[:, at : at + SEGMENT]
        centres = np.unique(x, axis=0)
        if len(centres) > CENTROIDS:
            centres = centres[np.linspace(0, len(centres) - 1, CENTROIDS).astype(int)]
            for _ in range(ROUNDS):
                near = _nearest(x, centres)
                size = np.bincount(near, minlength=len(centres))
                sums = np.stack([np.bincount(near, weights=c, minlength=len(centres)) for c in x.T], axis=1)
                centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
            centres = np.unique(np.rint(centres), axis=0)
        books.append(centres)
    return books


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * (x @ centres.T)).argmin(1)


def _length_up(square: np.ndarray) -> np.ndarray:
    """Square roots, rounded up to whole numbers."""
    if square.dtype == object:
        return np.array([math.isqrt(v) + 1 for v in square.ravel()], object).reshape(square.shape)
    return np.ceil(np.sqrt(square)) + 1


def _whole(x: np.ndarray, exact: bool) -> np.ndarray:
    return x if exact else np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


class Quantiser:
    """Codebooks, and whether float64 holds every sum exactly."""

    def __init__(self, books: list[np.ndarray], width: int, exact: bool):
        self.books, self.width, self.exact = books, width, exact

    def index(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and float64 lengths of each segment's residual, not below the true ones."""
        codes = np.stack([_nearest(x[:, SEGMENT * m : SEGMENT * (m + 1)], b) for m, b in enumerate(self.books)], axis=1)
        left = x - np.hstack([b[c] for b, c in zip(self.books, codes.T)])
        squares = np.add.reduceat(left * left, np.arange(0, self.width, SEGMENT), axis=1)
        return codes.astype(np.uint8), np.nextafter(np.ceil(np.sqrt(squares)), np.inf) if self.exact else np.sqrt(squares) * (1 + 1e-9) + 1

    def tables(self, anchors: np.ndarray) -> list[np.ndarray]:
        """Score of each anchor's segment with each centroid."""
        return [anchors[:, SEGMENT * m : SEGMENT * (m + 1)] @ _whole(b, self.exact).T for m, b in enumerate(self.books)]

    def lengths(self, anchors: np.ndarray) -> np.ndarray:
        squares = np.add.reduceat(anchors * anchors, np.arange(0, self.width, SEGMENT), axis=1)
        return _length_up(squares)


class Best:
    """The best `most` of each slot met so far: higher scores first, then smaller ids."""

    def __init__(self, most: int):
        self.most = most
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots that are full now, and the score to match in each."""
        slot, score, ids = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, slot)) if score.dtype != object else np.array(sorted(range(len(slot)), key=lambda k: (slot[k], -score[k], ids[k])), np.int64)
        slot = slot[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, np.int64)
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        kept = order[rank < self.most]
        last = order[rank == self.most - 1]
        full = slot[rank == self.most - 1]
        self.slot, self.score, self.id = slot[rank < self.most], score[kept], ids[kept]
        return full, score[last]


def scan(batches: Iterator[pa.RecordBatch], q: Quantiser, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, most: int) -> list[Best]:
    """The best `most` rows of each anchor's windows [low, high] (anchors x windows), of the same or of other labels.

    One Best a tile of anchors; a slot is the anchor's place in its tile times windows plus the window.
    """
    windows = low.shape[1]
    tops = [Best(most) for _ in range(0, len(ids), TILE_ANCHORS)]
    low = low.copy()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        at = batch.column(0).to_numpy()
        label = batch.column(1).to_numpy()
        fixed = lambda k, kind: np.stack([np.frombuffer(b, kind) for b in batch.column(k).to_pylist()])  # noqa: E731, B023
        codes, residuals = fixed(2, np.uint8), fixed(3, np.float64)
        x = _whole(fixed(4, np.float64), q.exact)
        if not q.exact:
            residuals = np.array([math.ceil(v) for v in residuals.ravel()], object).reshape(residuals.shape)
        for tile, top in enumerate(tops):
            of = slice(tile * TILE_ANCHORS, (tile + 1) * TILE_ANCHORS)
            mine, lo, hi = anchors[of], low[of], high[of]
            tables, lengths = q.tables(mine), q.lengths(mine)
            for begin in range(0, n, TILE_ROWS):
                rows = slice(begin, begin + TILE_ROWS)
                about = reduce(np.add, (t[:, c] for t, c in zip(tables, codes[rows].T)))
                off = lengths @ residuals[rows].T
                most_, least_ = about + off, about - off
                may = np.zeros(about.shape, bool)
                for w in range(windows):
                    may |= (most_ >= lo[:, w, None]) & (least_ <= hi[:, w, None])
                alike = labels[of][:, None] == label[rows][None]
                may &= alike & (ids[of][:, None] != at[rows][None]) if same else ~alike
                a, r = np.nonzero(may)
                if not len(a):
                    continue
                if len(a) * 8 > may.size:
                    score = (mine @ x[rows].T)[a, r]
                else:
                    score = np.concatenate([(mine[a[k : k + 16_384]] * x[rows][r[k : k + 16_384]]).sum(1) for k in range(0, len(a), 16_384)])
                slots, scores, found = [], [], []
                for w in range(windows):
                    yes = np.asarray((score >= lo[a, w]) & (score <= hi[a, w]), bool)
                    slots.append(a[yes] * windows + w)
                    scores.append(score[yes])
                    found.append(at[rows][r[yes]])
                full, bar = top.add(np.concatenate(slots), np.concatenate(scores), np.concatenate(found))
                lo[full // windows, full % windows] = np.maximum(lo[full // windows, full % windows], bar)
    return tops


def _pack(v: np.ndarray) -> list[bytes]:
    """Scores as text, since float64 and Python integers both go this way."""
    return [str(int(s)).encode() for s in v]


def _best(found: DataFrame, most: int) -> DataFrame:
    """The best of what all tasks have found, ranked in each window."""
    score = F.col("score").cast("string").cast("decimal(38,0)")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(score.desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _scan_job(index: DataFrame, q: Quantiser, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, positives: tuple[np.ndarray, np.ndarray] | None, low: np.ndarray, high: np.ndarray, most: int) -> DataFrame:
    """One scan as a frame of FOUND. positives: ids and scores (anchors x windows) in the second scan, None in the first."""
    windows = low.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, top in enumerate(scan(batches, q, ids, labels, anchors, low, high, positives is None, most)):
            a, w = top.slot // windows + tile * TILE_ANCHORS, top.slot % windows
            if len(a):
                if positives is None:
                    head = [pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary())]
                else:
                    head = [pa.array(positives[0][a, w]), pa.array(_pack(positives[1][a, w]), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), *head, pa.array(top.id), pa.array(_pack(top.score), pa.binary())], names=["anchor_id", "positive_id", "positive_score", "id", "score"])

    return index.mapInArrow(run, FOUND)


def whole_numbers(scale: float, width: int) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Vectors as whole numbers, ended with zeros, and which of them stay finite."""

    def of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(column.offsets.to_numpy())
        flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
        x = np.zeros((len(column), width))
        x[np.repeat(np.arange(len(column)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        with np.errstate(over="ignore"):
            x = np.floor(x * scale)
        return x, np.isfinite(x).all(1)

    return of


def build_index(df: DataFrame, id_col: str, label_col: str, vector_col: str, scale: float) -> tuple[DataFrame, Quantiser] | None:
    """Every row's whole-number vector with its codes and residual lengths, as a table; None without rows."""
    vec = F.col(vector_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec"), finite.alias("__ok"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL AND __ok").groupBy("id").agg(F.min(F.struct("label", "vec")).alias("row"))
    rows = materialize(rows.select("id", "row.label", "row.vec"), "vectors")
    most = rows.agg(F.max(F.size("vec")).alias("width"), F.max(F.array_max(F.transform("vec", F.abs))).alias("top")).first()
    if most.width is None:
        return None
    width = max(most.width, 1)
    numbers = whole_numbers(scale, width)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toArrow().column(0).combine_chunks()
    x, good = numbers(sample)
    top = min(float(most.top or 0) * scale + 1, 1e300)
    q = Quantiser(codebooks(np.clip(x[good], -1e150, 1e150), width) if good.any() else [np.zeros((1, min(SEGMENT, width - m))) for m in range(0, width, SEGMENT)], width, width * top * top * 4 < EXACT)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = numbers(batch.column(2))
            batch, x = batch.filter(pa.array(good)), x[good]
            if len(x):
                codes, residuals = q.index(x)
                packed = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (codes, residuals, x)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], names=["id", "label", "codes", "residuals", "vec"])

    return materialize(rows.select("id", "label", "vec").mapInArrow(index, INDEX), "index"), q


def mine_hard_negatives(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = 256.0,
    positives: int = 5, negatives: int = 5, least_percent: int = 80, most_percent: int = 100,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), see RESULT.

    anchor: a condition on the column `id`. For each anchor's best `positives` rows of its label, the best `negatives`
    rows of other labels with least_percent * positive <= 100 * score <= most_percent * positive.
    """
    spark = df.sparkSession
    built = build_index(df, id_col, label_col, vector_col, scale)
    if built is None:
        return spark.createDataFrame([], RESULT)
    index, q = built
    chosen = index.where(anchor)
    n = chosen.count()
    blocks = 1 if n <= ANCHOR_BLOCK else -(-2 * n // ANCHOR_BLOCK)  # ids are distinct, so a hash deals them evenly
    block = F.pmod(F.xxhash64(F.col("id"), F.lit("block")), F.lit(blocks))
    parts = []
    for b in range(blocks if n else 0):
        at = chosen.where(block == b).select("id", "label", "vec").toArrow().sort_by("id")
        ids, labels = (at.column(k).to_numpy().copy() for k in (0, 1))
        vecs = _whole(np.stack([np.frombuffer(v) for v in at.column(2).to_pylist()]), q.exact)
        if not len(ids):
            continue
        far = np.inf if q.exact else 1 << 4096
        first = _best(_scan_job(index, q, ids, labels, vecs, None, np.full((len(ids), 1), -far), np.full((len(ids), 1), far), positives), positives)
        got = first.select("anchor_id", "rank", "id", F.col("score").cast("string")).collect()  # at most `positives` rows an anchor of the block
        kind = float if q.exact else object
        score = np.full((len(ids), positives), -1, kind)  # below zero: no window
        pos = np.full((len(ids), positives), -1, np.int64)
        place = {v: k for k, v in enumerate(ids.tolist())}
        low, high = np.full(score.shape, 1, kind), np.full(score.shape, 0, kind)
        for r in got:
            a, w, s = place[r.anchor_id], r["rank"] - 1, int(r.score)
            score[a, w], pos[a, w] = s, r.id
            low[a, w], high[a, w] = -(-least_percent * s // 100), most_percent * s // 100
        low, high = np.where(low > high, far, low), np.where(low > high, -far, high)
        second = _best(_scan_job(index, q, ids, labels, vecs, (pos, score), low, high, negatives), negatives)
        edge = lambda c: F.greatest(F.least(F.col(c).cast("string").cast("decimal(38,0)"), F.lit(2**63 - 1)), F.lit(-(2**63) + 1)).cast("long").alias(c)
        parts.append(materialize(second.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), edge("positive_score"), edge("score").alias("negative_score")), "negatives"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], RESULT)


def op13(spark, sf_dir: str) -> DataFrame:
    """Contract query: hard negatives of every hundredth vector, against all rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("id") % 100 == 0)


#: The same rows by all pairs of anchors and rows.
OP13_SQL = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS alike, CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ r ON a.vec_id <> r.vec_id
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""
