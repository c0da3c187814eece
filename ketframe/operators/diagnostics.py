"""Diagnostics of candidates, ensembles and corpora of states.

Sources of a study are a frozen subset; they are sent to the candidates by a broadcast whose size
is checked, and candidates stay where they are. Larger tables meet by blocks (`pairs`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ketframe.functions import linalg
from ketframe.operators.metric_index import closest_across, near_duplicate_pairs
from ketframe.operators.pairs import to_matrix

#: Most source states that are sent to every task, 16 kB each at ten qubits.
BROADCAST_STATES = 50_000


def _sent(sources: DataFrame):
    n = sources.count()
    if n > BROADCAST_STATES:
        raise ValueError(f"{n} sources are too many to send to every task; use the block operators")
    f = sources.select("parameter_id", "label", "g", "state").toPandas()
    table = (f["parameter_id"].to_numpy(), f["label"].to_numpy(), f["g"].to_numpy(), to_matrix(f["state"]).astype(complex))
    return sources.sparkSession.sparkContext.broadcast(table)


CANDIDATE = (
    "candidate_id string, label int, norm double, purity double, source_fidelity double, nearest_same double, nearest_same_id string, nearest_same_apart double, nearest_other double, "
    "margin double, energy_drift double, mx double, mz2 double, mx_drift double, mz2_drift double"
)


def candidate_diagnostics(candidates: DataFrame, sources: DataFrame, coupling: float = 1.0, boundary: str = "open") -> DataFrame:
    """One row a candidate (candidate_id, label, source_ids array, state) against the source states.

    Distances to the same and to other classes, also without the candidate's own sources; energies by
    the g of its first source. A class without other members gives nulls.
    """
    shared = _sent(sources)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, labels, gs, states = shared.value
        place = {v: i for i, v in enumerate(ids)}
        for f in frames:
            if not len(f):
                continue
            m = to_matrix(f["state"]).astype(complex)
            overlap = np.sqrt(linalg.fidelity(m, states))
            own = [[place[i] for i in x] for x in f["source_ids"]]
            first = np.array([x[0] for x in own])
            same = labels[None] == f["label"].to_numpy()[:, None]
            apart = same.copy()
            for r, x in enumerate(own):
                apart[r, x] = False
            least = lambda mask: np.where(mask.any(1), linalg.fs_from_overlap(np.where(mask, overlap, -1).max(1)), np.nan)
            (mx, mz2), (sx, sz2) = linalg.observables(m), linalg.observables(states[first])
            norm, a, b = (np.abs(m) ** 2).sum(1), least(same), least(~same)
            drift = linalg.energies(m, gs[first], coupling, boundary) - linalg.energies(states[first], gs[first], coupling, boundary)
            yield pd.DataFrame({
                "candidate_id": f["candidate_id"].to_numpy(), "label": f["label"].to_numpy(), "norm": norm, "purity": norm**2, "source_fidelity": overlap[np.arange(len(m)), first] ** 2,
                "nearest_same": a, "nearest_same_id": ids[np.where(same, overlap, -1).argmax(1)], "nearest_same_apart": least(apart), "nearest_other": b, "margin": b - a, "energy_drift": drift,
                "mx": mx, "mz2": mz2, "mx_drift": mx - sx, "mz2_drift": mz2 - sz2,
            })

    return candidates.select("candidate_id", "label", "source_ids", "state").mapInPandas(rows, CANDIDATE)


def symmetry_audit(states: DataFrame, n_qubits: int, tolerance: float = 1e-10) -> DataFrame:
    """(parameter_id, symmetry, fidelity, commutator, holds) under spin flip, reflection and both."""
    flip = np.arange(2**n_qubits) ^ (2**n_qubits - 1)
    mirror = np.array([int(format(i, f"0{n_qubits}b")[::-1], 2) for i in range(2**n_qubits)])
    maps = {"flip": flip, "reflection": mirror, "both": mirror[flip]}

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            m, h = to_matrix(f["state"]).astype(complex), linalg.hamiltonians(f["g"].to_numpy(), n_qubits)
            for name, at in maps.items():
                moved = np.abs(h[:, at][:, :, at] - h).max((1, 2))
                fidelity = np.abs((m.conj() * m[:, at]).sum(1)) ** 2
                yield pd.DataFrame({"parameter_id": f["parameter_id"].to_numpy(), "symmetry": name, "fidelity": fidelity, "commutator": moved, "holds": (fidelity >= 1 - tolerance) & (moved <= tolerance)})

    return states.select("parameter_id", "g", "state").mapInPandas(rows, "parameter_id string, symmetry string, fidelity double, commutator double, holds boolean")


def dataset_audit(states: DataFrame, n_qubits: int, coupling: float = 1.0, boundary: str = "open") -> DataFrame:
    """One row a class and split: counts, the largest errors of norm, eigen equation, energy, phase and observables, and ranges of g."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            m, g = to_matrix(f["state"]).astype(complex), f["g"].to_numpy()
            h, e = linalg.hamiltonians(g, n_qubits, coupling, boundary), f["energy"].to_numpy()
            mx, mz2 = linalg.observables(m)
            yield pd.DataFrame({
                "label": f["label"].to_numpy(), "split": f["split"].to_numpy(), "g": g, "norm_error": np.abs((np.abs(m) ** 2).sum(1) - 1),
                "residual": np.linalg.norm(np.einsum("bij,bj->bi", h, m) - e[:, None] * m, axis=1), "energy_error": np.abs(linalg.energies(m, g, coupling, boundary) - e),
                "phase_error": np.abs(m - linalg.largest_pivot(m)).max(1), "observable_error": np.maximum(np.abs(mx - f["magnetization_x"]), np.abs(mz2 - f["magnetization_z2"])).to_numpy(),
            })

    errors = ("norm_error", "residual", "energy_error", "phase_error", "observable_error")
    each = states.select("label", "split", "g", "state", "energy", "magnetization_x", "magnetization_z2").mapInPandas(rows, "label int, split string, g double, " + ", ".join(f"{e} double" for e in errors))
    return each.groupBy("label", "split").agg(F.count("*").alias("n"), *(F.max(e).alias(e) for e in errors), F.min("g").alias("g_min"), F.max("g").alias("g_max"))


def numerical_floor(states: DataFrame, n_qubits: int, coupling: float = 1.0, boundary: str = "open") -> DataFrame:
    """(parameter_id, label, distance) of each state to one solved anew at its g: what rounding alone makes."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                again = linalg.ground_states(f["g"].to_numpy(), n_qubits, coupling, boundary)[2]
                c = np.abs((linalg.normalized(to_matrix(f["state"])).conj() * again).sum(1))
                yield pd.DataFrame({"parameter_id": f["parameter_id"], "label": f["label"], "distance": linalg.fs_from_overlap(c)})

    return states.select("parameter_id", "label", "g", "state").mapInPandas(rows, "parameter_id string, label int, distance double")


def freshness(new: DataFrame, reference: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """One row: ids, parameters and canonical digests that two corpora share, projective duplicates, and the nearest pair.

    The three intersections are semi joins of keys; duplicates and the nearest pair come from blocks.
    """

    both = [d.select("parameter_id", "g", digest_column(d).alias("digest")) for d in (new, reference)]
    shared = [both[0].join(both[1].select(k).distinct(), k, "left_semi").agg(F.countDistinct(k).alias(f"shared_{k}")) for k in ("parameter_id", "g", "digest")]
    tagged = new.select(F.concat(F.lit("new/"), "parameter_id").alias("id"), "state", F.lit("new").alias("side")).unionByName(reference.select(F.concat(F.lit("old/"), "parameter_id").alias("id"), "state", F.lit("old").alias("side")))
    pairs = near_duplicate_pairs(tagged.select("id", "state"), 1 - tolerance, "string").where(F.substring("a", 1, 3) != F.substring("b", 1, 3)).agg(F.count("*").alias("duplicates"))
    nearest = closest_across(tagged, "side", "string").agg(F.max("overlap").alias("nearest_overlap"))
    out = shared[0]
    for one in (*shared[1:], pairs, nearest):
        out = out.join(F.broadcast(one), F.lit(True))  # rows of one row
    ok = (F.col("shared_parameter_id") == 0) & (F.col("shared_g") == 0) & (F.col("shared_digest") == 0)
    return out.withColumn("fresh", ok).withColumn("separate", F.col("duplicates") == 0)


def digest_column(states: DataFrame):
    """SHA-256 of the canonical bytes of a state column, global phase removed."""

    @F.pandas_udf("string")
    def digest(state: pd.DataFrame) -> pd.Series:
        m = np.stack(state["re"].to_list()) + 1j * np.stack(state["im"].to_list())
        return pd.Series(linalg.state_digests(linalg.largest_pivot(m)))

    return digest(F.col("state"))


def dataset_hash(states: DataFrame) -> DataFrame:
    """One row: a digest of all rows' ids, g and canonical state digests in the order of ids."""
    row = F.concat_ws("|", "parameter_id", F.format_string("%.17g", "g"), digest_column(states))
    return states.select(row.alias("row")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("row")), "\n").cast("binary"), 256).alias("digest"), F.count("*").alias("n"))


def ensemble_metrics(generated: DataFrame, target: DataFrame) -> DataFrame:
    """(label, mmd, nearest, spread, mx_gap, mz2_gap) of two ensembles of each class; a class of an ensemble is one task."""

    def of(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = (to_matrix(f["state"]).astype(complex) for f in (a, b))
        if not len(x) or not len(y):
            return pd.DataFrame({"label": [key[0]], "mmd": [None], "nearest": [None], "spread": [None], "mx_gap": [None], "mz2_gap": [None]})
        k, own = linalg.fidelity(x, y), linalg.fidelity(x, x)
        off = own[~np.eye(len(x), dtype=bool)]
        (ax, az), (bx, bz) = linalg.observables(x), linalg.observables(y)
        return pd.DataFrame({"label": [key[0]], "mmd": [linalg.mmd(x, y)], "nearest": [k.max(1).mean()], "spread": [off.mean() if len(off) else None], "mx_gap": [ax.mean() - bx.mean()], "mz2_gap": [az.mean() - bz.mean()]})

    return generated.select("label", "state").groupBy("label").cogroup(target.select("label", "state").groupBy("label")).applyInPandas(of, "label int, mmd double, nearest double, spread double, mx_gap double, mz2_gap double")


def outcome_mmd(generated: DataFrame, target: DataFrame) -> DataFrame:
    """(label, per_outcome, pooled): the mean over measurement outcomes of their MMD, and the MMD of all outcomes together."""
    from ketframe.operators.mmd import densities

    tag = F.concat_ws("/", F.lit("g"), F.col("label").cast("string"), F.col("outcome").cast("string"))
    rows = generated.select(tag.alias("k"), "state").unionByName(generated.select(F.concat_ws("/", F.lit("p"), F.col("label").cast("string"), F.lit("")).alias("k"), "state")).unionByName(target.select(F.concat_ws("/", F.lit("t"), F.col("label").cast("string"), F.lit("")).alias("k"), "state"))
    rho = densities(rows, "k").select(F.split("group", "/").alias("s"), "n", "re", "im")
    rho = rho.select(F.col("s")[0].alias("side"), F.col("s")[1].cast("int").alias("label"), F.transform("re", lambda x: x / F.col("n")).alias("re"), F.transform("im", lambda x: x / F.col("n")).alias("im"))
    from ketframe.functions.columns import dot

    t = rho.where("side = 't'").select("label", F.col("re").alias("tr"), F.col("im").alias("ti"))
    d = [F.zip_with(a, b, lambda x, y: x - y) for a, b in (("re", "tr"), ("im", "ti"))]
    each = rho.where("side <> 't'").join(t, "label").select("label", "side", (dot(d[0], d[0]) + dot(d[1], d[1])).alias("mmd"))
    return each.groupBy("label").agg(F.avg(F.when(F.col("side") == "g", F.col("mmd"))).alias("per_outcome"), F.max(F.when(F.col("side") == "p", F.col("mmd"))).alias("pooled"))


def signature_alignment(signatures: DataFrame) -> DataFrame:
    """(a, b, correlation, sign_agreement, conflict) of every two tasks' derivative vectors; signatures: task, v."""
    long = signatures.select("task", F.posexplode("v").alias("pos", "x"))
    a, b = long.select(F.col("task").alias("a"), "pos", "x"), long.select(F.col("task").alias("b"), "pos", F.col("x").alias("y"))
    both = a.join(b, "pos").where("a < b").groupBy("a", "b")
    agree = F.avg((F.signum("x") == F.signum("y")).cast("double"))
    varied = (F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0)
    return both.agg(F.when(varied, F.corr("x", "y")).alias("correlation"), agree.alias("sign_agreement"), (F.sum(F.col("x") * F.col("y")) < 0).alias("conflict"))


def gram_floor(states: DataFrame, kernel: str = "global") -> DataFrame:
    """(label, smallest) eigenvalue of each class's Gram matrix: whether a kernel is positive in numbers."""

    def of(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        m = to_matrix(part["state"]).astype(complex)
        k = linalg.KERNELS[kernel](m, m)
        return pd.DataFrame({"label": [key[0]], "smallest": [float(np.linalg.eigvalsh((k + k.T) / 2)[0])]})

    return states.select("label", "state").groupBy("label").applyInPandas(of, "label int, smallest double")


def group_diversity(states: DataFrame, group_cols: list[str]) -> DataFrame:
    """group_cols, n and the mean fidelity of different members, from the density sum: no pairs."""
    from ketframe.operators.mmd import densities

    rows = states.select(F.to_json(F.struct(*group_cols)).alias("k"), "state")
    rho = densities(rows, "k")
    from ketframe.functions.columns import dot

    total = dot(F.col("re"), F.col("re")) + dot(F.col("im"), F.col("im"))
    kinds = {c: t for c, t in states.dtypes}
    back = F.from_json("group", ", ".join(f"`{c}` {kinds[c]}" for c in group_cols)).alias("g")
    return rho.select(back, "n", F.when(F.col("n") > 1, (total - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("mean_fidelity")).select("g.*", "n", "mean_fidelity")


def nearest_parameters(states: DataFrame) -> DataFrame:
    """(split_a, split_b, gap): the least |g - g'| of a class between two splits, by neighbours in order.

    In the order of g of two splits only, the nearest pair of different splits is a pair of neighbours.
    """
    rows = states.select("label", "split", "g")
    splits = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in (("test", "train"), ("test", "val"), ("train", "val"))]
    two = rows.withColumn("p", F.explode(F.array(*splits))).where((F.col("split") == F.col("p.x")) | (F.col("split") == F.col("p.y")))
    w = W.partitionBy("label", "p").orderBy("g", "split")
    gap = F.when(F.lag("split").over(w) != F.col("split"), F.col("g") - F.lag("g").over(w))
    return two.withColumn("gap", gap).groupBy(F.col("p.x").alias("split_a"), F.col("p.y").alias("split_b")).agg(F.min("gap").alias("gap"))
