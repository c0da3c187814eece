"""Training over a run matrix: one row is one run, and runs are what is distributed.

A run's state table is small (a subset of one frozen table) and is sent to its task by a broadcast
of checked size; the loop of updates stays in one Python worker, since each update is a few matrix
products. A run that fails gives a row with its error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ketframe.functions import circuits, linalg
from ketframe.functions.seeds import generator
from ketframe.operators.pairs import to_matrix

#: Decay of the perturbation and of the rate.
PERTURBATION_DECAY, RATE_DECAY = 0.101, 0.602
#: Largest state table that is broadcast to runs, in rows.
BROADCAST_ROWS = 200_000


def spsa(loss: Callable[[np.ndarray], float], start: np.ndarray, updates: int, rate: float, perturbation: float, rng: np.random.Generator, seen: Callable[[int, np.ndarray], bool] | None = None) -> np.ndarray:
    """Simultaneous perturbation descent; `seen` is called before each update and after the last, and ends the run if true."""
    p = start.copy()
    for step in range(updates + 1):
        if (seen and seen(step, p)) or step == updates:
            break
        delta = rng.choice((-1.0, 1.0), size=p.shape)
        c, a = perturbation / (step + 1) ** PERTURBATION_DECAY, rate / (step + 1) ** RATE_DECAY
        p = p - a * (loss(p + c * delta) - loss(p - c * delta)) / (2 * c) * delta
    return p


def train_classifier(train: tuple[np.ndarray, np.ndarray], val: tuple[np.ndarray, np.ndarray], *, init_seed: int, spsa_seed: int, steps: int, learning_rate: float = 0.15, perturbation: float = 0.1, patience: int | None = None, min_delta: float = 0.0, confirmatory: bool = False) -> dict:
    """Full-batch training; with patience the best validation loss decides, else the last update.

    confirmatory: the frozen protocol (PCG64DXSM streams, 300 updates, last checkpoint).
    """
    if confirmatory and (learning_rate, perturbation, steps, patience) != (0.15, 0.1, 300, None):
        raise ValueError("the confirmatory protocol fixes rate, perturbation, 300 updates and the last checkpoint")
    if not len(train[1]) or not len(val[1]):
        raise ValueError("training needs train and validation states")
    make = generator if confirmatory else np.random.default_rng
    start, rng = make(init_seed).normal(0, 0.1, circuits.CLASSIFIER_PARAMETERS), make(spsa_seed)
    target = 2.0 * np.asarray(train[1]) - 1
    history: list[dict] = []
    best = {"loss": np.inf, "p": start, "step": 0, "stale": 0}

    def seen(step: int, p: np.ndarray) -> bool:
        a, b = circuits.classifier_metrics(*train, p), circuits.classifier_metrics(*val, p)
        history.append({"step": step, "train_loss": a["loss"], "train_accuracy": a["accuracy"], "val_loss": b["loss"], "val_accuracy": b["accuracy"]})
        if b["loss"] < best["loss"] - min_delta:
            best.update(loss=b["loss"], p=p.copy(), step=step, stale=0)
        else:
            best["stale"] += 1
        return patience is not None and best["stale"] >= patience

    last = spsa(lambda p: float(np.mean((circuits.expectations(train[0], p) - target) ** 2)), start, steps, learning_rate, perturbation, rng, seen)
    chosen, step = (best["p"], best["step"]) if patience is not None else (last, len(history) - 1)
    return {"parameters": chosen, "step": step, "history": history, "stopped_early": patience is not None and best["stale"] >= patience}


def robust_spsa(losses: Callable[[np.ndarray], np.ndarray], start: np.ndarray, updates: int, rate: float, perturbation: float, rng: np.random.Generator) -> tuple[np.ndarray, list[float]]:
    """SPSA whose slope is the mean over classes of the median over realisations; losses(p) is (classes, realisations)."""
    p, history = start.copy(), []
    for step in range(updates + 1):
        history.append(float(losses(p).mean()))
        if step == updates:
            break
        delta = rng.choice((-1.0, 1.0), size=p.shape)
        c, a = perturbation / (step + 1) ** PERTURBATION_DECAY, rate / (step + 1) ** RATE_DECAY
        slopes = (losses(p + c * delta) - losses(p - c * delta)) / (2 * c)
        p = p - a * np.median(slopes, axis=1).mean() * delta
    return p, history


RESULT = "run_id string, status string, error string, best_step int, updates int, stopped_early boolean, train_loss double, train_accuracy double, train_f1 double, val_loss double, val_accuracy double, val_f1 double, test_loss double, test_accuracy double, test_f1 double, parameters array<double>"


def run_classifiers(runs: DataFrame, states: DataFrame, *, steps: int, learning_rate: float = 0.15, perturbation: float = 0.1, patience: int | None = None, min_delta: float = 0.0, confirmatory: bool = False) -> DataFrame:
    """One result row for each run. runs: run_id, init_seed, spsa_seed, ids (train ids); states: parameter_id, label, split, state."""
    n = states.count()
    if n > BROADCAST_ROWS:
        raise ValueError(f"{n} states are too many to send to every run; run on subsets of at most {BROADCAST_ROWS}")
    table = states.select("parameter_id", "label", "split", "state").toPandas()
    matrix = to_matrix(table["state"])
    shared = runs.sparkSession.sparkContext.broadcast((table["parameter_id"].to_numpy(), table["label"].to_numpy(), table["split"].to_numpy(), matrix))
    names = [c.split()[0] for c in RESULT.split(", ")]

    def one(run) -> dict:
        ids, labels, splits, m = shared.value
        row = dict.fromkeys(names) | {"run_id": run.run_id}
        try:
            pick = {"train": np.isin(ids, list(run.ids)) & (splits == "train"), "val": splits == "val", "test": splits == "test"}
            parts = {k: (m[at], labels[at]) for k, at in pick.items()}
            done = train_classifier(parts["train"], parts["val"], init_seed=int(run.init_seed), spsa_seed=int(run.spsa_seed), steps=steps, learning_rate=learning_rate, perturbation=perturbation, patience=patience, min_delta=min_delta, confirmatory=confirmatory)
            for k, (x, y) in parts.items():
                got = circuits.classifier_metrics(x, y, done["parameters"])
                row |= {f"{k}_loss": got["loss"], f"{k}_accuracy": got["accuracy"], f"{k}_f1": circuits.macro_f1(y, (circuits.expectations(x, done["parameters"]) >= 0).astype(int))}
            return row | {"status": "completed", "best_step": done["step"], "updates": len(done["history"]) - 1, "stopped_early": done["stopped_early"], "parameters": done["parameters"].tolist()}
        except Exception as e:  # a failed run is a row of its own
            return row | {"status": "failed", "error": repr(e)}

    def every(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for run in f.itertuples():
                yield pd.DataFrame([one(run)], columns=names)

    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.select("run_id", "init_seed", "spsa_seed", "ids").repartition(parts, "run_id").mapInPandas(every, RESULT)


def pending(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs without a valid completed result: resuming skips the others."""
    unit = lambda c: F.col(c).between(0, 1)
    sound = results.where((F.col("status") == "completed") & unit("test_accuracy") & unit("test_f1") & ~F.isnan("test_loss") & F.col("test_loss").isNotNull())
    return runs.join(sound.select("run_id"), "run_id", "left_anti")


def train_diffusion(targets: dict[int, np.ndarray], *, steps: int, layers: int, samples: int, forward_seed: int, source_seed: int, init_seed: int, spsa_seed: int, measurement_seed: int, updates: int, rate: float, perturbation: float, n_ancilla: int = 1, mode: str = "chain", repeats: int = 1) -> dict:
    """Fit the reverse steps of a diffusion model by SPSA on the MMD to the forward ensembles.

    mode: "chain" feeds each step what the one before makes, from Haar states on; "haar" and
    "teacher_forced" fit each step on its own, from Haar states or the forward ensemble.
    """
    if mode not in ("chain", "haar", "teacher_forced"):
        raise ValueError("unknown mode")
    labels = sorted(targets)
    n = linalg.qubits(targets[labels[0]].shape[1])
    forward, angles = circuits.forward_diffusion(targets, steps, forward_seed), circuits.condition_angles(labels)
    parameters = np.random.default_rng(init_seed).normal(0, 0.15, (steps, layers, circuits.reverse_width(n, n_ancilla)))
    draws, shared = np.random.default_rng(measurement_seed), np.random.default_rng(spsa_seed)
    histories: list[list[dict]] = [[] for _ in range(steps)]
    if mode == "chain":
        uniforms = {(s, c): [draws.random(samples)] for s in range(steps) for c in labels}
        current = {c: linalg.haar_states(samples, source_seed + c, n) for c in labels}
    for step in range(steps - 1, -1, -1) if mode == "chain" else range(steps):
        if mode == "chain":
            source, noise, rng = current, {c: uniforms[step, c] for c in labels}, shared
        else:
            source = {c: linalg.haar_states(samples, source_seed + 100 * step + c, n) if mode == "haar" else forward[c][step + 1][:samples] for c in labels}
            noise, rng = {c: [draws.random(samples) for _ in range(repeats)] for c in labels}, np.random.default_rng(spsa_seed + step)
        target = {c: forward[c][step] for c in labels}

        def loss(p: np.ndarray) -> float:
            return circuits.ensemble_loss(source, p, angles, noise, target)  # noqa: B023

        def seen(i: int, p: np.ndarray) -> bool:
            histories[step].append({"iteration": i, "loss": loss(p)})  # noqa: B023
            return False

        parameters[step] = spsa(loss, parameters[step], updates, rate, perturbation, rng, seen)
        if mode == "chain":
            current = {c: circuits.reverse_step(source[c], parameters[step], angles[c], noise[c][0]) for c in labels}
    return {"parameters": parameters, "histories": histories, "angles": angles, "forward": forward, "n_data": n}


FIT = "run_id string, step int, initial_loss double, final_loss double, best_loss double, iterations int, parameters array<array<double>>"


def run_diffusions(runs: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """One row for each run and reverse step.

    runs: run_id, n_qubits, count, samples, steps, layers, updates, rate, perturbation, seed, mode.
    Targets are ground states of both phases drawn from the run's seed.
    """

    def one(run) -> pd.DataFrame:
        rng = np.random.default_rng(run.seed)
        targets = {c: linalg.ground_states(rng.uniform(*span, run.count), run.n_qubits)[2] for c, span in enumerate(((0.2, 0.8), (1.2, 1.8)))}
        seeds = {k: int(run.seed) + i for i, k in enumerate(("forward_seed", "source_seed", "init_seed", "spsa_seed", "measurement_seed"), 1)}
        done = train_diffusion(targets, steps=run.steps, layers=run.layers, samples=run.samples, updates=run.updates, rate=run.rate, perturbation=run.perturbation, mode=run.mode, **seeds)
        losses = [[h["loss"] for h in x] for x in done["histories"]]
        return pd.DataFrame([(run.run_id, s, x[0], x[-1], min(x), len(x) - 1, done["parameters"][s].tolist()) for s, x in enumerate(losses)], columns=[c.split()[0] for c in FIT.split(", ")])

    def every(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for run in f.itertuples():
                yield one(run)

    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(parts, "run_id").mapInPandas(every, FIT)


#: Indices that a bootstrap holds at once.
DRAWS = 1 << 21
#: Places of a group that one task draws from, and resamples that it makes of them.
STRETCH_PLACES, RESAMPLE_BLOCK = 1 << 16, 1_000


def paired_bootstrap(deltas: np.ndarray, seeds, resamples: int = 100_000) -> tuple[float, list[float]]:
    """Mean and percentile interval over resampled pairs; `seeds` is the entropy of the stream."""
    deltas = np.asarray(deltas, float)
    if not len(deltas) or not np.isfinite(deltas).all():
        raise ValueError("finite paired deltas are needed")
    return float(deltas.mean()), np.quantile(_resampled_means(deltas, seeds, resamples), [0.025, 0.975]).tolist()


def _resampled_means(x: np.ndarray, seeds, resamples: int) -> np.ndarray:
    """One stream of draws, taken in pieces of DRAWS at most."""
    rng = np.random.Generator(np.random.PCG64DXSM(np.random.SeedSequence(seeds)))
    step = max(1, DRAWS // len(x))
    return np.concatenate([x[rng.integers(0, len(x), size=(min(step, resamples - at), len(x)))].mean(1) for at in range(0, resamples, step)])


def _drawn(n: int, places: int, stretch: int, seed: int, block: int, resamples: int) -> np.ndarray:
    """How many of n draws with replacement from n places fall into one of their stretches, for each resample of a block.

    The stretches are halved again and again and each half gets a binomial share, so every task finds the same multinomial numbers.
    """
    low, high, m = 0, -(-n // places), np.full(resamples, n)
    while high - low > 1:
        middle = (low + high) // 2
        share = (middle - low) * places / (min(high * places, n) - low * places)
        left = np.random.Generator(np.random.PCG64DXSM(np.random.SeedSequence([seed, block, low, high]))).binomial(m, share)
        low, high, m = (low, middle, left) if stretch < middle else (middle, high, m - left)
    return m


def _stretch_sums(x: np.ndarray, m: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The sum of m[r] draws with replacement from x, for each r."""
    out, at = np.zeros(len(m)), 0
    while at < len(m):
        to = max(at + 1, int(np.searchsorted(np.cumsum(m[at:]), DRAWS, "right")) + at)
        drawn = np.r_[x[rng.integers(0, len(x), int(m[at:to].sum()))], 0.0]
        out[at:to] = np.where(m[at:to] > 0, np.add.reduceat(drawn, np.cumsum(m[at:to]) - m[at:to]), 0.0)
        at = to
    return out


def bootstrap_intervals(deltas: DataFrame, group_col: str, delta_col: str, seed: int = 0, resamples: int = 10_000) -> DataFrame:
    """(group, n, mean, low, high): percentile intervals of the means of a group's paired deltas; no task holds a group.

    A group's deltas in order are cut into stretches of STRETCH_PLACES. A task draws from one stretch for a block of resamples,
    as many as the resample's multinomial shares give it, and sends one sum a resample. A group of one stretch has the
    stream of `paired_bootstrap`.
    """
    from ketframe.functions.columns import finite
    from ketframe.operators import ranks
    from ketframe.operators.rounds import cut

    kind, places = dict(deltas.dtypes)[group_col], STRETCH_PLACES
    rows = deltas.select(F.col(group_col).alias("group"), F.col(delta_col).cast("double").alias("x"))
    counts = cut(rows.groupBy("group", "x").agg(F.count("*").alias("c")))
    sizes = cut(counts.groupBy("group").agg(F.coalesce(F.sum(F.when(finite(F.col("x")), F.col("c"))), F.lit(0)).alias("n")))  # a row a group
    placed = ranks.running_sums(counts.where(finite(F.col("x"))), ["group"], ["x"], {"upto": F.col("c")}).withColumn("first", F.col("upto") - F.col("c"))
    whole = placed.alias("p").join(F.broadcast(sizes.alias("s")), F.col("p.group").eqNullSafe(F.col("s.group"))).select("p.*", "s.n")
    each = whole.withColumn("stretch", F.explode(F.sequence(F.expr(f"first div {places}"), F.expr(f"(upto - 1) div {places}"))))
    inside = F.least("upto", (F.col("stretch") + 1) * places) - F.greatest("first", F.col("stretch") * places)
    blocks = F.when(F.col("n") <= places, F.lit(1)).otherwise(F.lit(-(-resamples // RESAMPLE_BLOCK)))
    sent = each.select("group", "n", "stretch", "x", inside.alias("c"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    parts = int(deltas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.repartition(parts, "group", "stretch", "block")  # little data and much work, so not to be coalesced

    def draw(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        group, stretch, block = key
        part, n = part.sort_values("x", kind="stable"), int(part["n"].iloc[0])
        x = np.repeat(part["x"].to_numpy(float), part["c"].to_numpy())
        if n <= places:
            means, begin = _resampled_means(x, seed, resamples), 0
        else:
            begin = int(block) * RESAMPLE_BLOCK
            m = _drawn(n, places, int(stretch), seed, int(block), min(RESAMPLE_BLOCK, resamples - begin))
            means = _stretch_sums(x, m, np.random.Generator(np.random.PCG64DXSM(np.random.SeedSequence([seed, int(block), int(stretch)])))) / n
        out = pd.DataFrame({"resample": np.arange(begin, begin + len(means)), "mean": means})
        if block == 0:  # the share of the deltas' own mean
            out.loc[len(out)] = (-1, x.mean() if n <= places else x.sum() / n)
        return out.assign(group=group)[["group", "resample", "mean"]]

    sums = sent.groupBy("group", "stretch", "block").applyInPandas(draw, f"group {kind}, resample int, mean double")
    means = sums.groupBy("group", "resample").agg(F.sum("mean").alias("mean"))  # a row a group and resample

    def interval(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        own = part["resample"] < 0
        low, high = np.quantile(part.loc[~own, "mean"], [0.025, 0.975])
        return pd.DataFrame({"group": [key[0]], "mean": part.loc[own, "mean"].to_numpy(), "low": [low], "high": [high]})

    found = means.groupBy("group").applyInPandas(interval, f"group {kind}, mean double, low double, high double")
    return sizes.alias("s").join(found.alias("f"), F.col("s.group").eqNullSafe(F.col("f.group")), "left").select("s.group", "s.n", "f.mean", "f.low", "f.high")


def directional_derivatives(loss: Callable[[np.ndarray], float], p: np.ndarray, directions: np.ndarray, epsilon: float) -> pd.DataFrame:
    """First and second central differences along unit directions, and the norm-weighted gradient sketch."""
    centre = loss(p)
    rows = []
    for i, d in enumerate(directions):
        up, down = loss(p + epsilon * d), loss(p - epsilon * d)
        rows.append((i, (up - down) / (2 * epsilon), (up - 2 * centre + down) / epsilon**2))
    return pd.DataFrame(rows, columns=["direction", "derivative", "curvature"])
