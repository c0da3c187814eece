"""Operators on pairs of states, by blocks.

Rows are numbered into blocks by a hash of their id. Each pair of blocks is one task-sized unit, which multiplies
tiles of at most TILE rows of either in NumPy. Which pairs exist is a small table of block numbers; each row is sent, packed
with others of its block, to the block pairs that need it, so the shuffle is rows times blocks, not pairs, and what comes out is only what
the caller's function keeps. Blocks grow with the table, up to MOST_ROWS, so there are about BLOCKS of them and the shuffle
grows as the table does; time grows with its square, as all pairs are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The least rows that a block is meant to have, and the most.
BLOCK_ROWS, MOST_ROWS = 1_024, 1 << 16
#: Blocks that a table is meant to have.
BLOCKS = 24
#: Rows of either side that are multiplied at once.
TILE = 512
#: Rows of a block that are packed into one value.
PACKED_ROWS = 4_096
#: Rows that a unit keeps before it sends them, but for what one tile or block gives at once.
SENT_ROWS = 65_536


def to_matrix(column: pd.Series) -> np.ndarray:
    """Rows of real vectors, or of structs with re and im (as dicts or rows), as a matrix."""
    if len(column) and (isinstance(column.iloc[0], dict) or hasattr(column.iloc[0], "asDict")):
        return np.stack([np.asarray(s["re"]) + 1j * np.asarray(s["im"]) for s in column])
    return np.stack(column.to_list()) if len(column) else np.zeros((0, 0))


def packed_blocks(states: DataFrame, k: int, within: list[str]) -> DataFrame:
    """(within, __b, rows): rows of each of k blocks, PACKED_ROWS of them as an Arrow stream."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        out = []
        for at in range(0, table.num_rows, PACKED_ROWS):
            sink = pa.BufferOutputStream()
            part = table.slice(at, PACKED_ROWS)
            with pa.ipc.new_stream(sink, part.schema) as writer:
                writer.write_table(part)
            out.append(sink.getvalue().to_pybytes())
        first = table.select([*within, "__b"]).slice(0, 1)
        return pa.table({**{c: pa.concat_arrays([first[c].combine_chunks()] * len(out)) for c in first.column_names}, "rows": pa.array(out, pa.binary())})

    types = dict(states.dtypes)
    rows = states.withColumn("__b", F.pmod(F.xxhash64("id"), F.lit(k)).cast("int"))
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in within), "__b int, rows binary"])
    return rows.groupBy(*within, "__b").applyInArrow(pack, schema)


def unpacked(parts: list[bytes]) -> pd.DataFrame:
    """The rows of some packed values, in the order of ids."""
    frames = [pa.ipc.open_stream(p).read_all().to_pandas() for p in parts]
    return pd.concat(frames, ignore_index=True).sort_values("id", kind="stable", ignore_index=True)


def block_pairs(states: DataFrame, keep: Callable[[pd.DataFrame, pd.DataFrame, bool], Iterator[pd.DataFrame]], schema: str, within: list[str] | None = None, block_rows: int | None = None, sums: list[str] | None = None, tiled: bool = True) -> DataFrame:
    """Apply keep(left rows, right rows, same rows) to every unordered pair of tiles of every unordered pair of blocks.

    states has columns id and state besides others. within: only rows that agree in these columns
    meet. sums: columns by which what a unit keeps is added up before it is sent. Not tiled: keep gets whole blocks.
    """
    within = within or []
    if within:
        found = states.groupBy(*within).count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
        n, most = found.n or 0, found.most or 0
    else:
        n = most = states.count()
    block_rows = block_rows or min(MOST_ROWS, max(BLOCK_ROWS, -(-n // BLOCKS)))
    k = max(1, -(-most // block_rows))
    packed = packed_blocks(states, k, within)
    other = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("__o")
    sent = packed.select("*", other).select(*within, "__b", "rows", F.least("__b", "__o").alias("__x"), F.greatest("__b", "__o").alias("__y"))
    names = [c.strip().rsplit(" ", 1)[0].strip() for c in schema.split(",")]

    def kept(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        if not tiled:
            yield from keep(left, right, same)
            return
        cut = lambda f: [f.iloc[at : at + TILE] for at in range(0, len(f), TILE)]
        rights = cut(right)
        for i, a in enumerate(cut(left)):
            for j, b in enumerate(rights[i:] if same else rights):
                yield from keep(a, b, same and j == 0)

    def pair(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = (v.as_py() for v in key[-2:])
        of_x, of_y = [], []
        for batch in batches:
            for own, rows in zip(batch["__b"].to_pylist(), batch["rows"].to_pylist()):
                if own == x:
                    of_x.append(rows)
                if own == y:
                    of_y.append(rows)
        if not of_x or not of_y:
            return
        left = unpacked(of_x)
        right = left if x == y else unpacked(of_y)
        out, held = [], 0
        for frame in kept(left, right, x == y):
            if not len(frame):
                continue
            out.append(frame)
            held += len(frame)
            if sums and len(out) > 64:
                out = [pd.concat(out).groupby(sums, as_index=False, dropna=False).sum()]
            elif not sums and held >= SENT_ROWS:  # what a unit keeps is sent as it is found
                yield from _as_batches(pd.concat(out)[names], kinds)
                out, held = [], 0
        if out:
            whole = pd.concat(out)
            yield from _as_batches((whole.groupby(sums, as_index=False, dropna=False).sum() if sums else whole)[names], kinds)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return sent.groupBy(*within, "__x", "__y").applyInArrow(pair, schema)


def _as_batches(frame: pd.DataFrame, kinds: pa.Schema) -> list[pa.RecordBatch]:
    return pa.Table.from_arrays([pa.array(frame[f.name], f.type, from_pandas=True) for f in kinds], schema=kinds).to_batches(SENT_ROWS)


def _overlaps(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    return np.abs(to_matrix(left["state"]).conj() @ to_matrix(right["state"]).T)


def pair_distances(states: DataFrame, id_type: str = "long", within: list[str] | None = None) -> DataFrame:
    """(a, b, overlap) for all unordered pairs, a < b; within adds its columns."""
    within = within or []
    types = dict(states.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in within), f"a {id_type}", f"b {id_type}", "overlap double"])

    def keep(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        c = _overlaps(left, right)
        i, j = np.triu_indices(len(left), 1) if same else np.indices(c.shape).reshape(2, -1)
        a, b = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        swap = a > b
        out = {w: left[w].iloc[0] for w in within} | {"a": np.where(swap, b, a), "b": np.where(swap, a, b), "overlap": c[i, j]}
        yield pd.DataFrame(out)

    return block_pairs(states, keep, schema, within)


#: Angles as whole numbers: DEPTH levels of 2**LEVEL bins each.
LEVEL, DEPTH = 11, 4
KEYS = 1 << LEVEL * DEPTH
#: Values of a bin that are read rather than binned once more.
FEW = 20_000


def angle_keys(overlaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fubini-Study angles, and whole numbers below KEYS in the same order."""
    d = np.arccos(np.minimum(overlaps, 1.0))
    return d, np.minimum((d * (KEYS / (np.pi / 2))).astype(np.int64), KEYS - 1)


def pair_quantiles(states: DataFrame, shares: dict[str, float], within: list[str] | None = None, block_rows: int | None = None) -> DataFrame:
    """(within, pairs, mean_fidelity, a column a share): exact quantiles of the angles of all pairs, with linear interpolation.

    By selection: block pairs count angles into bins, and only the bins that hold a wanted rank are looked into
    again, first by finer bins and, once they hold FEW values, by the values. No pair leaves its block pair but those.
    Equal angles count as one value with a number. A group of one row has no pairs and no row.
    """
    from ketframe.operators.rounds import cut

    groups = within or ["__all"]
    rows = states if within else states.withColumn("__all", F.lit(0))
    types = dict(rows.dtypes)
    head = ", ".join(f"{c} {types[c]}" for c in groups)
    rows = rows.select(*groups, "id", "state")

    def counted(bits: int, targets: DataFrame | None) -> DataFrame:
        """Numbers of angles by target bin and next finer bin."""
        shift, again = LEVEL * DEPTH - bits, targets is not None

        def keep(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
            c, (_, keys) = _pairs_of(left, right, same)
            for target in left["targets"].iloc[0] if again else [0]:
                here = keys >> shift == target
                bins = keys[here] >> (shift - LEVEL) & ((1 << LEVEL) - 1)
                n = np.bincount(bins, minlength=1 << LEVEL)
                some = np.flatnonzero(n)
                yield pd.DataFrame({w: left[w].iloc[0] for w in groups} | {"target": (target << LEVEL) + some, "n": n[some], "squares": np.bincount(bins, weights=c[here] ** 2, minlength=1 << LEVEL)[some]})

        out = block_pairs(rows if targets is None else rows.join(targets, groups), keep, f"{head}, target long, n long, squares double", groups, block_rows, [*groups, "target"])
        return out.groupBy(*groups, "target").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"))

    def holding(counts: DataFrame, wanted: DataFrame) -> DataFrame:
        """For each wanted rank (from 0) the bin that holds it, with how many angles come before the bin."""
        before = F.sum("n").over(W.partitionBy(*groups).orderBy("target").rowsBetween(W.unboundedPreceding, -1))  # at most 2**LEVEL bins a wanted rank
        placed = counts.withColumn("before", F.coalesce(before, F.lit(0)) + (F.col("base") if "base" in counts.columns else 0))
        return placed.join(wanted, groups).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))

    first = cut(counted(0, None))
    totals = first.groupBy(*groups).agg(F.sum("n").alias("pairs"), (F.sum("squares") / F.sum("n")).alias("mean_fidelity"))
    share = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in shares.items()))).alias("s")
    place = F.col("s.q") * (F.col("pairs") - 1)
    ranks = cut(totals.select(*groups, "pairs", "mean_fidelity", share).select(*groups, "pairs", "mean_fidelity", "s.name", (place - F.floor(place)).alias("part"), F.floor(place).alias("low"), F.ceil(place).alias("high")))
    wanted = ranks.select(*groups, F.explode(F.array("low", "high")).alias("rank")).distinct()
    held, bits = cut(holding(first, wanted).select(*groups, "rank", "target", "n", "before")), LEVEL
    while bits < LEVEL * DEPTH and (held.agg(F.max("n")).first()[0] or 0) > FEW:
        finer = counted(bits, held.groupBy(*groups).agg(F.collect_set("target").alias("targets")))  # two bins a share at most
        inside = held.select(*groups, "rank", F.col("target").alias("coarse"), F.col("before").alias("base"))
        joined = finer.withColumn("coarse", F.shiftright("target", LEVEL)).join(inside, [*groups, "coarse"])
        before = F.sum("n").over(W.partitionBy(*groups, "rank").orderBy("target").rowsBetween(W.unboundedPreceding, -1))
        at = joined.withColumn("before", F.coalesce(before, F.lit(0)) + F.col("base"))
        held = cut(at.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).select(*groups, "rank", "target", "n", "before"))
        bits += LEVEL
    shift = LEVEL * DEPTH - bits

    def values(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        _, (d, keys) = _pairs_of(left, right, same)
        for target in left["targets"].iloc[0]:
            value, n = np.unique(d[keys >> shift == target], return_counts=True)
            yield pd.DataFrame({w: left[w].iloc[0] for w in groups} | {"target": target, "value": value, "n": n})

    found = block_pairs(rows.join(held.groupBy(*groups).agg(F.collect_set("target").alias("targets")), groups), values, f"{head}, target long, value double, n long", groups, block_rows, [*groups, "target", "value"])
    found = found.groupBy(*groups, "target", "value").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*groups, "target").orderBy("value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # the few values of a bin
    ranked = found.withColumn("inside", before).join(held.select(*groups, "target", "rank", "before"), [*groups, "target"])
    at = cut(ranked.where((F.col("rank") >= F.col("before") + F.col("inside")) & (F.col("rank") < F.col("before") + F.col("inside") + F.col("n"))).select(*groups, "rank", "value"))
    ends = ranks.join(at.select(*groups, F.col("rank").alias("low"), F.col("value").alias("from")), [*groups, "low"]).join(at.select(*groups, F.col("rank").alias("high"), F.col("value").alias("to")), [*groups, "high"])
    out = ends.groupBy(*groups, "pairs", "mean_fidelity").pivot("name", list(shares)).agg(F.first(F.col("from") + F.col("part") * (F.col("to") - F.col("from"))))
    return out if within else out.drop("__all")


def _pairs_of(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    c = _overlaps(left, right)
    c = c[np.triu_indices(len(left), 1)] if same else c.ravel()
    return c, angle_keys(c)


def knn_graph(states: DataFrame, k: int = 3, quantile: float = 0.75, minimum: float = 0.04, id_type: str = "long", within: list[str] | None = None) -> DataFrame:
    """Undirected edges (a, b, distance, eligible) of the k-nearest graph.

    Eligible edges are at least `minimum` long and no longer than the group's quantile of all distances.
    """
    from ketframe.functions.columns import fs_acos
    from ketframe.operators.metric_index import nearest

    within = within or []
    near = nearest(states, k, id_type, within)
    edges = near.select(*within, F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"), fs_acos(F.col("overlap")).alias("distance")).dropDuplicates(["a", "b"])
    cut = pair_quantiles(states, {"cutoff": quantile}, within).select(*within, "cutoff")
    out = edges.join(cut, within) if within else edges.join(F.broadcast(cut), F.lit(True))  # one row
    return out.withColumn("eligible", (F.col("distance") >= minimum) & (F.col("distance") <= F.col("cutoff")))


def totals_to_others(states: DataFrame, cosine: bool = False) -> DataFrame:
    """(id, total, n): sums over all other states of fidelities, or of signed overlaps of real vectors; no pairs are made.

    Both are linear in the other states: cosines add up to the product with the sum of all vectors, fidelities to
    the quadratic form of the sum of all projectors. What a state has with itself is taken off.
    """
    n = F.lit(states.count() - 1)
    if cosine:
        total = states.select(F.posexplode("state").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
        whole = total.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda v: v["x"]).alias("whole"))  # one vector
        both = states.join(F.broadcast(whole), F.lit(True))
        return both.select("id", (_dot(F.col("state"), F.col("whole")) - _dot(F.col("state"), F.col("state"))).alias("total"), n.alias("n"))
    from ketframe.operators.mmd import densities

    rho = densities(states.withColumn("__all", F.lit(0)), "__all").select("re", "im")  # one matrix
    kind = dict(states.dtypes)["id"]

    def form(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = to_matrix(f["state"]).astype(complex)
                r = (np.asarray(f["re"].iloc[0]) + 1j * np.asarray(f["im"].iloc[0])).reshape(x.shape[1], -1)
                yield pd.DataFrame({"id": f["id"], "total": np.einsum("bi,ij,bj->b", x.conj(), r, x).real - (np.abs(x) ** 2).sum(1) ** 2})

    return states.select("id", "state").join(F.broadcast(rho), F.lit(True)).mapInPandas(form, f"id {kind}, total double").withColumn("n", n)


def _dot(a: Column, b: Column) -> Column:
    from ketframe.functions.columns import dot

    return dot(a, b)
