"""Near, nearest and closest states by pivot cells and the triangle inequality.

The Fubini-Study angle is a metric. Every state lives in the cell of its nearest pivot and visits each cell that its
bounds cannot exclude: one whose pivot is more than twice the radius farther than its own, or farther than the cell's
reach plus the radius, holds nothing within the radius. Inside a cell states are sorted by their angle to the
pivot, and a visitor meets only residents whose angle differs from its own by at most the radius.
Searches without a given radius take one from what a state's own cell already shows.

A cell with many residents or visitors is cut into chunks, so a task holds at most CELL_ROWS of each. Pivots (at most
PIVOTS, spread out over a bounded sample) and one row a cell are all that the driver and every task get. How much is
saved depends on the data: where all angles are alike, as between random states of many qubits, every
state would visit every cell. So the index reckons from its sample what share of the cells is visited; beyond MOST_VISITED
pairs are met by blocks (`pairs.block_pairs`), which sends a row a fixed number of times; `compared` tells the pairs met.

Ids are distinct and not null; states are normalised and of one dimension. No rows give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ketframe.operators.pairs import TILE, block_pairs, to_matrix
from ketframe.operators.rounds import cut

PIVOTS = 512
CELL_ROWS = 1_024
#: Rows a cell is meant to have.
AIM = 512
#: Rows of the sample that pivots are chosen from, for each pivot.
SAMPLE = 4
#: Angles are uncertain by the square root of the precision where states nearly agree.
SLACK = 1e-6
RIGHT_ANGLE = np.pi / 2
#: Share of the cells that a state may visit on average before blocks are cheaper.
MOST_VISITED = 0.25
#: Tables of no more rows are small either way and always go through the cells.
SMALL = 4_096
#: Rows that one batch of visits holds.
VISITS = 8_192
#: Decimals to which overlaps are ranked, so that equal states tie whatever the order of additions.
TIE = 9


def angles(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.arccos(np.minimum(np.abs(left.conj() @ right.T), 1.0))


def spread(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to count rows, each the farthest from those before it."""
    chosen = [0]
    far = angles(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and far.max() > SLACK:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, angles(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


class Index:
    """Rows with their cell and angle, and each cell's reach. keep: further columns to carry."""

    def __init__(self, states: DataFrame, keep: list[str], within: list[str] | None = None):
        self.within, self.carried = within or [], [*(within or []), "id", *keep]
        self.types = dict(states.dtypes)
        states = states.select(*dict.fromkeys([*self.carried, "state"]))
        self.n = n = states.count()
        self.pivots = np.zeros((0, 0))
        if not n:
            return
        count = min(PIVOTS, -(-n // AIM))
        sample = states.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * count).select("state").toPandas()
        self.sample = to_matrix(sample["state"])
        self.pivots = pivots = spread(self.sample, count)

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    d = angles(to_matrix(f["state"]), pivots)
                    yield f.assign(cell=d.argmin(1).astype(np.int32), angle=d.min(1))

        kinds = ", ".join(f"{c} {self.types[c]}" for c in states.columns)
        self.rows = cut(states.mapInPandas(place, f"{kinds}, cell int, angle double"))
        found = self.rows.groupBy("cell").agg(F.max("angle").alias("reach")).collect()  # a row a pivot
        self.reach = np.full(len(pivots), -1.0)
        for r in found:
            self.reach[r.cell] = r.reach

    def all_alike(self, sample: np.ndarray, radius: float | np.ndarray) -> bool:
        """Whether states like those of a sample, with their radii, visit so many cells that blocks are cheaper."""
        if self.n <= SMALL:
            return False
        d = angles(sample, self.pivots)
        r = np.broadcast_to(radius, len(d))[:, None] + SLACK
        go = (d <= d.min(1)[:, None] + 2 * r) & (d <= self.reach + r) & (self.reach >= 0)
        return float(go.sum()) > MOST_VISITED * len(d) * max(1, int((self.reach >= 0).sum()))

    def visits(self, rows: DataFrame, home: bool | None) -> DataFrame:
        """rows (with a column radius) once for each cell they have to see; home: only their own, or only others, or both."""
        pivots, reach = self.pivots, self.reach
        if home:
            return rows

        def see(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if not len(f):
                    continue
                d, r, own = angles(to_matrix(f["state"]), pivots), f["radius"].to_numpy()[:, None] + SLACK, f["cell"].to_numpy()
                go = (d <= f["angle"].to_numpy()[:, None] + 2 * r) & (d <= reach + r) & (reach >= 0)
                go[np.arange(len(f)), own] = home is None
                i, cell = np.nonzero(go)
                for at in range(0, len(i), VISITS):
                    x, c = i[at : at + VISITS], cell[at : at + VISITS]
                    yield f.iloc[x].assign(cell=c.astype(np.int32), angle=d[x, c])

        return rows.mapInPandas(see, rows.schema)

    def meet(self, rows: DataFrame, home: bool | None, found: Callable[[pd.DataFrame, pd.DataFrame, Callable], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
        """found(visitors, residents, overlaps) for the chunks of every cell; see `overlaps`."""
        keys = [*self.within, "cell"]
        visitors = self.visits(rows, home)
        size = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.ceil(F.col("n") / CELL_ROWS).cast("int").alias(name))
        chunks = cut(size(self.rows, "of_r").join(size(visitors, "of_v"), keys))  # a row a group and cell
        deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        columns = [*dict.fromkeys([*rows.columns])]
        v = visitors.join(chunks, keys).withColumn("__v", deal("of_v")).withColumn("__r", every("of_r")).withColumn("__visits", F.lit(True))
        r = self.rows.withColumn("radius", F.lit(0.0)).join(chunks, keys).withColumn("__r", deal("of_r")).withColumn("__v", every("of_v")).withColumn("__visits", F.lit(False))
        picked = [*columns, "__r", "__v", "__visits"]

        def unit(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["angle", "id"], kind="stable")
            left, right = part[part["__visits"]], part[~part["__visits"]]
            if not len(left) or not len(right):
                return _none(schema)
            return pd.concat([*found(left, right, lambda: overlaps(left, right))] or [_none(schema)])

        # Computed once: a plan that holds this twice has lost rows where Spark reused an exchange below it.
        return cut(v.select(*picked).unionByName(r.select(*picked)).groupBy(*keys, "__r", "__v").applyInPandas(unit, schema))


def _none(schema: str) -> pd.DataFrame:
    return pd.DataFrame({c.strip().rsplit(" ", 1)[0]: [] for c in schema.split(",")})


def overlaps(left: pd.DataFrame, right: pd.DataFrame, rows: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in left, places in right, overlaps) of neighbouring visitors and the residents within their radii; both sorted by angle."""
    a, b = to_matrix(left["state"]), to_matrix(right["state"])
    at, radius, to = left["angle"].to_numpy(), left["radius"].to_numpy() + SLACK, right["angle"].to_numpy()
    low, high = np.searchsorted(to, at - radius), np.searchsorted(to, at + radius, "right")
    for k in range(0, len(a), rows):
        i = np.arange(k, min(k + rows, len(a)))
        first, last = int(low[i].min()), int(high[i].max())
        if last > first:
            yield i, np.arange(first, last), np.abs(a[i].conj() @ b[first:last].T)


def _near(states: DataFrame, least_fidelity: float, id_type: str, within: list[str] | None = None) -> DataFrame:
    """Near pairs, and rows of one id with itself that say how many pairs a unit met."""
    schema = f"a {id_type}, b {id_type}, fidelity double, met long"
    index = Index(states, [], within)
    if not len(index.pivots):
        return states.sparkSession.createDataFrame([], schema)

    def found(left: pd.DataFrame, right: pd.DataFrame, each: Callable) -> Iterator[pd.DataFrame]:
        met, a, b = 0, left["id"].to_numpy(), right["id"].to_numpy()
        for i, j, c in each():
            f = c**2
            x, y = np.nonzero((f >= least_fidelity) & (a[i][:, None] < b[j][None]))
            met += c.size
            yield pd.DataFrame({"a": a[i][x], "b": b[j][y], "fidelity": f[x, y], "met": 0})
        yield pd.DataFrame({"a": a[:1], "b": a[:1], "fidelity": 1.0, "met": met})

    radius = float(np.arccos(np.sqrt(min(max(least_fidelity, 0.0), 1.0))))
    if index.all_alike(index.sample, radius):

        def near(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
            f = np.abs(to_matrix(left["state"]).conj() @ to_matrix(right["state"]).T) ** 2
            x, y = np.nonzero(np.triu(f >= least_fidelity, 1) if same else f >= least_fidelity)
            a, b = left["id"].to_numpy()[x], right["id"].to_numpy()[y]
            swap = a > b
            yield pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "fidelity": f[x, y], "met": 0})
            first = left["id"].to_numpy()[:1]
            yield pd.DataFrame({"a": first, "b": first, "fidelity": 1.0, "met": f.size * (1 if same else 2)})

        return block_pairs(states.select(*(within or []), "id", "state"), near, schema, within)
    return index.meet(index.rows.withColumn("radius", F.lit(radius)), None, found, schema)


def near_duplicate_pairs(states: DataFrame, least_fidelity: float, id_type: str = "long", within: list[str] | None = None) -> DataFrame:
    """(a, b, fidelity) of pairs a < b with a fidelity of least_fidelity or more; within: only rows that agree in these columns meet."""
    return _near(states, least_fidelity, id_type, within).where("a <> b").select("a", "b", "fidelity")


def with_neighbours(states: DataFrame, least_fidelity: float, id_type: str = "long") -> DataFrame:
    """(id) of the states that another state comes near to with a fidelity of least_fidelity or more.

    A unit gives each of its rows at most once, however many near pairs there are.
    """
    schema = f"id {id_type}"
    index = Index(states, [])
    if not len(index.pivots):
        return states.sparkSession.createDataFrame([], schema)

    def found(left: pd.DataFrame, right: pd.DataFrame, each: Callable) -> Iterator[pd.DataFrame]:
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        some = np.zeros(len(a), bool)
        for i, j, c in each():
            some[i] |= ((c**2 >= least_fidelity) & (a[i][:, None] != b[j][None])).any(1)
        yield pd.DataFrame({"id": a[some]})

    def of_blocks(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        a = to_matrix(left["state"])
        b = a if same else to_matrix(right["state"])
        some_a = np.zeros(len(a), bool)
        some_b = some_a if same else np.zeros(len(b), bool)
        for i in range(0, len(a), TILE):
            for j in range(i if same else 0, len(b), TILE):
                near = np.abs(a[i : i + TILE].conj() @ b[j : j + TILE].T) ** 2 >= least_fidelity
                if same and i == j:
                    np.fill_diagonal(near, False)
                some_a[i : i + TILE] |= near.any(1)
                some_b[j : j + TILE] |= near.any(0)
        yield pd.DataFrame({"id": left["id"].to_numpy()[some_a]})
        if not same:
            yield pd.DataFrame({"id": right["id"].to_numpy()[some_b]})

    radius = float(np.arccos(np.sqrt(min(max(least_fidelity, 0.0), 1.0))))
    if index.all_alike(index.sample, radius):
        return block_pairs(states.select("id", "state"), of_blocks, schema, tiled=False).distinct()
    return index.meet(index.rows.withColumn("radius", F.lit(radius)), None, found, schema).distinct()


def compared(states: DataFrame, least_fidelity: float, id_type: str = "long") -> DataFrame:
    """(rows, met, found): how many ordered pairs were met to find the near ones."""
    out = _near(states, least_fidelity, id_type)
    return out.agg(F.sum("met").alias("met"), F.count_if(F.col("a") != F.col("b")).alias("found")).select(F.lit(states.count()).alias("rows"), "met", "found")


def nearest(states: DataFrame, k: int, id_type: str = "long", within: list[str] | None = None) -> DataFrame:
    """(id, neighbour, overlap, rank): the k nearest other states of each, ties by the neighbour's id."""
    within = within or []
    index = Index(states, [], within)
    head = [f"{c} {index.types[c]}" for c in within]
    schema = ", ".join([*head, f"id {id_type}", f"neighbour {id_type}", "overlap double"])
    if not len(index.pivots):
        return states.sparkSession.createDataFrame([], schema + ", rank int")

    def found(left: pd.DataFrame, right: pd.DataFrame, each: Callable) -> Iterator[pd.DataFrame]:
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        for i, j, c in each():
            c = np.where(a[i][:, None] == b[j][None], -1.0, c)
            order = np.lexsort((np.broadcast_to(b[j], c.shape), -np.round(c, TIE)), axis=1)[:, :k]
            x = np.repeat(np.arange(len(i)), order.shape[1])
            best = c[x, order.ravel()]
            some = best >= 0
            yield pd.DataFrame({w: left[w].iloc[0] for w in within} | {"id": a[i][x][some], "neighbour": b[j][order.ravel()][some], "overlap": best[some]})

    rank = F.row_number().over(W.partitionBy("id").orderBy(F.round("overlap", TIE).desc(), "neighbour"))
    at_home = cut(index.meet(index.rows.withColumn("radius", F.lit(RIGHT_ANGLE)), True, found, schema).withColumn("rank", rank).where(F.col("rank") <= k))
    worst = at_home.where(F.col("rank") == k).select("id", F.acos(F.least("overlap", F.lit(1.0))).alias("radius"))
    rows = index.rows.join(worst, "id", "left").withColumn("radius", F.coalesce("radius", F.lit(RIGHT_ANGLE)))
    rows = rows.select(*index.rows.columns, "radius")
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * len(index.pivots)).select("state", "radius").toPandas()
    if index.all_alike(to_matrix(some["state"]), some["radius"].to_numpy()):
        best = block_pairs(states.select(*within, "id", "state"), lambda left, right, same: _best_of_blocks(left, right, same, k, within), schema, within, tiled=False)
        return best.withColumn("rank", rank).where(F.col("rank") <= k)
    away = index.meet(rows, False, found, schema)
    return at_home.drop("rank").unionByName(away).withColumn("rank", rank).where(F.col("rank") <= k)


def _best_of_blocks(left: pd.DataFrame, right: pd.DataFrame, same: bool, k: int, within: list[str]) -> Iterator[pd.DataFrame]:
    """The k nearest of the other block for each row of two blocks; rows are in the order of ids, so the smaller place goes first where overlaps tie."""
    a = to_matrix(left["state"])
    b = a if same else to_matrix(right["state"])
    best = [(np.full((len(x), k), -1.0), np.zeros((len(x), k), np.int64)) for x in (a, b)]

    def better(side: int, at: int, c: np.ndarray, first: int) -> None:
        """c: overlaps of the rows from `at` on with others, the first of which has the place `first`."""
        rows, known, who = np.arange(len(c)), *(x[at : at + len(c)] for x in best[side])
        ranked, values, places = np.round(c, TIE), [known], [who]
        for _ in range(min(k, c.shape[1])):
            place = ranked.argmax(1)
            values.append(np.where(ranked[rows, place] < 0, -1.0, c[rows, place])[:, None])
            places.append(place[:, None] + first)
            ranked[rows, place] = -1.0
        values, places = np.hstack(values), np.hstack(places)
        order = np.lexsort((places, -np.round(values, TIE)), axis=1)[:, :k]
        known[:], who[:] = np.take_along_axis(values, order, 1), np.take_along_axis(places, order, 1)

    for i in range(0, len(a), TILE):
        for j in range(i if same else 0, len(b), TILE):
            c = np.abs(a[i : i + TILE].conj() @ b[j : j + TILE].T)
            if same and i == j:
                np.fill_diagonal(c, -1.0)
            better(0, i, c, j)
            if not (same and i == j):
                better(0 if same else 1, j, np.ascontiguousarray(c.T), i)
    for own, other, (overlap, place) in ((left, right, best[0]), (right, left, best[1]))[: 1 if same else 2]:
        row, column = np.nonzero(overlap >= 0)
        ids, others = own["id"].to_numpy(), other["id"].to_numpy()
        yield pd.DataFrame({w: own[w].iloc[0] for w in within} | {"id": ids[row], "neighbour": others[place[row, column]], "overlap": overlap[row, column]})


def closest_across(states: DataFrame, split_col: str, id_type: str = "long") -> DataFrame:
    """(split_a, split_b, overlap): the closest pair of every two splits, split_a < split_b."""
    schema = "split_a string, split_b string, overlap double"
    index = Index(states, [split_col])
    if not len(index.pivots):
        return states.sparkSession.createDataFrame([], schema)

    def found(left: pd.DataFrame, right: pd.DataFrame, each: Callable) -> Iterator[pd.DataFrame]:
        s, t = left[split_col].to_numpy(), right[split_col].to_numpy()
        best: dict = {}
        for i, j, c in each():
            for a in np.unique(s[i]):
                for b in np.unique(t[j]):
                    if a < b:
                        best[a, b] = max(best.get((a, b), -1.0), float(c[np.ix_(s[i] == a, t[j] == b)].max()))
        yield pd.DataFrame([(a, b, c) for (a, b), c in best.items()], columns=["split_a", "split_b", "overlap"]).astype({"overlap": float})

    most = lambda df: df.groupBy("split_a", "split_b").agg(F.max("overlap").alias("overlap"))
    at_home = cut(most(index.meet(index.rows.withColumn("radius", F.lit(RIGHT_ANGLE)), True, found, schema)))
    splits = index.rows.select(F.col(split_col).alias("s")).distinct()  # a row a split
    both = splits.join(splits.select(F.col("s").alias("t")), F.col("s") < F.col("t")).join(at_home, (F.col("s") == F.col("split_a")) & (F.col("t") == F.col("split_b")), "left")
    bound = both.groupBy("s").agg(F.max(F.coalesce(F.acos(F.least("overlap", F.lit(1.0))), F.lit(RIGHT_ANGLE))).alias("radius"))
    rows = index.rows.join(bound.withColumnRenamed("s", split_col), split_col).select(*index.rows.columns, "radius")  # the last split has none to come after it
    away = index.meet(rows, False, found, schema)
    return most(at_home.unionByName(away))
