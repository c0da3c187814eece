"""The reference's studies as dataflows over the operators: sweeps, arms beside a control, kernels, gradients.

A study is a function of a session and a few parameters that returns its table of results. Driver
work is the plan; what grows (states, candidates, runs, directions) is a frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ketframe.functions import circuits, linalg
from ketframe.operators import audit, generate, sampling, training


def subset_ids(dataset: DataFrame, sizes: list[int], subset_seed: int) -> DataFrame:
    """(size, ids): nested class-balanced train subsets in the order of one seeded shuffle."""
    spark = dataset.sparkSession
    train = dataset.where("split = 'train'").select("parameter_id", "label", "pos").orderBy("pos").toPandas()  # one frozen table's ids
    ranks = sampling.shuffled_ranks(spark, train, subset_seed)
    rows = sampling.nested_subsets(dataset.where("split = 'train'").select("parameter_id", "label").join(ranks, "parameter_id"), sizes, rank="rank")
    return rows.groupBy("size").agg(F.array_sort(F.collect_list("parameter_id")).alias("ids"))


def baseline_sweep(dataset: DataFrame, sizes: list[int], seeds: list[tuple[int, int]], subset_seed: int = 31415, steps: int = 300, patience: int = 40, min_delta: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """(runs, summary): every size by every seed pair, and mean and population deviation by size."""
    spark = dataset.sparkSession
    pairs = spark.createDataFrame([(i, *s) for i, s in enumerate(seeds)], "repeat int, init_seed long, spsa_seed long")
    runs = subset_ids(dataset, sizes, subset_seed).join(F.broadcast(pairs), F.lit(True))
    runs = runs.withColumn("run_id", F.format_string("n%03d-r%d", "size", "repeat"))
    done = training.run_classifiers(runs, dataset, steps=steps, patience=patience, min_delta=min_delta)
    out = runs.select("run_id", "size", "repeat").join(done, "run_id")
    ok = F.col("status") == "completed"
    stats = [f(F.when(ok, F.col(c))).alias(f"{c}_{n}") for c in ("test_accuracy", "test_f1", "test_loss") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return out, out.groupBy("size").agg(F.count_if(ok).alias("completed"), F.count_if(~ok).alias("failed"), *stats)


def select_candidates(pool: DataFrame, budget: int, ratios: list[float], order: list[str], source: str = "source_id") -> DataFrame:
    """(ratio, label, candidate): sources of a class take turns; the first ratio * budget are taken."""
    placed = sampling.round_robin(pool, source, order, within=["label"])
    each = F.explode(F.array(*(F.lit(float(r)) for r in ratios)))
    return placed.withColumn("ratio", each).where(F.col("position") < F.floor(F.col("ratio") * budget))


def arms_study(dataset: DataFrame, real_ids: list[str], arms: dict[str, DataFrame], seeds: list[tuple[int, int]], steps: int = 300, patience: int | None = 40) -> tuple[DataFrame, DataFrame]:
    """(runs, comparison): each arm adds its states to the same real ones; arms are compared by paired seeds.

    arms: name -> (ratio, parameter_id, label, state) of synthetic states.
    """
    spark = dataset.sparkSession
    base = dataset.select("parameter_id", "label", "split", "state")
    table, cells = base, spark.createDataFrame([("real", 0.0, real_ids)], "arm string, ratio double, ids array<string>")
    for name, rows in arms.items():
        own = rows.withColumn("parameter_id", F.concat(F.lit(f"{name}/"), "parameter_id"))
        table = table.unionByName(own.select("parameter_id", "label", F.lit("train").alias("split"), "state").dropDuplicates(["parameter_id"]))
        ids = own.groupBy("ratio").agg(F.collect_set("parameter_id").alias("extra"))
        cells = cells.unionByName(ids.select(F.lit(name).alias("arm"), "ratio", F.concat(F.array(*(F.lit(i) for i in real_ids)), "extra").alias("ids")))
    pairs = spark.createDataFrame([(i, *s) for i, s in enumerate(seeds)], "repeat int, init_seed long, spsa_seed long")
    runs = cells.join(F.broadcast(pairs), F.lit(True)).withColumn("run_id", F.format_string("%s-%.2f-%d", "arm", "ratio", "repeat"))
    out = runs.select("run_id", "arm", "ratio", "repeat").join(training.run_classifiers(runs, table, steps=steps, patience=patience), "run_id")
    cell = out.withColumn("cell", F.when(F.col("arm") == "real", "real").otherwise(F.format_string("%s-%.2f", "arm", "ratio")))
    named = cells.where("arm <> 'real'").select(F.format_string("%s-%.2f", "arm", "ratio").alias("cell")).distinct()
    names = sorted(r.cell for r in named.collect())  # the arms of a study
    deltas = audit.paired_deltas(cell, ["repeat"], "cell", "test_accuracy", "real", names)
    return out, audit.win_tie_loss(deltas, "arm")


def unitary_study(dataset: DataFrame, budget: int, strengths: list[float], ratios: list[float], seeds: list[tuple[int, int]], steps: int = 60) -> tuple[DataFrame, DataFrame]:
    """(pool summary, comparison): state-local unitaries, gated by train physics, as an arm beside real states."""
    ids = subset_ids(dataset, [budget], 31415).first().ids
    sources = dataset.where(F.col("parameter_id").isin(ids))
    gate = generate.fit_gate(dataset, 4)
    pool = generate.through_gate(generate.augment_by_unitary(sources, 4, strengths, [0]), gate)
    by = pool.groupBy("label", "operator", F.abs("strength").alias("strength"))
    summary = by.agg(F.count("*").alias("n"), F.avg(F.col("accepted").cast("double")).alias("rate"), F.avg("source_fidelity").alias("fidelity"), F.min("source_fidelity").alias("least"), F.countDistinct("source_id").alias("sources"))
    good = pool.where("accepted and strength <> 0")
    picked = select_candidates(good, budget, ratios, ["source_fidelity", "synthetic_id"])
    arm = picked.select("ratio", F.col("synthetic_id").alias("parameter_id"), "label", "state")
    return summary, arms_study(dataset, ids, {"unitary": arm}, seeds, steps)[1]


def geometry_study(dataset: DataFrame, budget: int, ratios: list[float], seeds: list[tuple[int, int]], steps: int = 60, run_seed: int = 0) -> DataFrame:
    """Geodesic points, distance-matched random controls and independent tangents as arms beside real states."""
    ids = subset_ids(dataset, [budget], 31415).first().ids
    sources = dataset.where(F.col("parameter_id").isin(ids))
    points = generate.geodesic_pool(sources, "random", run_seed)
    controls = generate.matched_controls(points, sources, run_seed)
    each = F.explode(F.array(*(F.lit(float(r)) for r in ratios)))
    first = lambda df, order, name: df.withColumn("n", F.row_number().over(W.partitionBy("label").orderBy(order))).withColumn("ratio", each).where(F.col("n") <= F.col("ratio") * budget).select("ratio", F.col(name).alias("parameter_id"), "label", "state")
    placed = controls.join(points.select(F.col("candidate_id").alias("geometry_id"), "position"), "geometry_id")
    tangents = generate.tangent_pool(sources, "random", run_seed).withColumn("ratio", F.explode("member")).where(F.col("ratio").isin([float(r) for r in ratios]))
    arms = {
        "geodesic": first(points, "position", "candidate_id"), "control": first(placed, "position", "candidate_id"),
        "tangent": tangents.select("ratio", F.col("synthetic_id").alias("parameter_id"), "label", "state"),
    }
    return arms_study(dataset, ids, arms, seeds, steps)[1]


#: Ratios of the calibration grid, the radius that wins a tie, and its tolerances.
CALIBRATION_RATIOS, TIE = (0.5, 1.0, 2.0), ("medium", 1.0)
NORM_TOLERANCE, TANGENT_TOLERANCE, DISPLACEMENT_TOLERANCE = 1e-10, 1e-12, 1e-10


def radius_calibration(datasets: dict[str, DataFrame], budget: int = 10, run_seeds: tuple[int, ...] = (0, 1, 2), subset_seed: int = 31415) -> tuple[DataFrame, DataFrame]:
    """(cells, decision) of tangent pools over data sets, classes, seeds, radii and ratios; train states only.

    A cell holds the first budget * ratio states of a pool. A radius and ratio is eligible if all its cells are
    valid and full, nothing in them is a near-duplicate and no displacement is off; of those that reach
    most anchors the one of the fixed tie-break is selected, or none.
    """
    sources = None
    for name, dataset in datasets.items():
        ids = subset_ids(dataset, [budget], subset_seed).select(F.explode("ids").alias("parameter_id"))
        part = dataset.join(F.broadcast(ids), "parameter_id", "left_semi").select(F.lit(name).alias("dataset"), "label", "parameter_id", "state")
        sources = part if sources is None else sources.unionByName(part)
    pools = generate.tangent_pools(sources, list(run_seeds), list(generate.RADII), int(budget * max(CALIBRATION_RATIOS)))
    requested = F.floor(budget * F.col("ratio"))
    rows = pools.withColumn("ratio", F.explode(F.array(*(F.lit(r) for r in CALIBRATION_RATIOS)))).where(F.col("index") < requested)
    sound = (F.col("norm_error") <= NORM_TOLERANCE) & (F.col("tangent_overlap") <= TANGENT_TOLERANCE) & (F.col("tangent_norm_error") <= TANGENT_TOLERANCE)
    n = F.count("*")
    cells = rows.groupBy("dataset", "label", "run_seed", F.col("radius_name").alias("radius"), "ratio").agg(
        F.first(requested).alias("requested"), n.alias("accepted"), (n / (n + F.sum("redraws"))).alias("acceptance_rate"), F.sum("redraws").alias("failed_redraws"),
        (F.countDistinct("anchor_id") / budget).alias("anchor_coverage"), F.max("error").alias("displacement_error"),
        (F.count_if(F.col("nearest_infidelity") < generate.NEAR_INFIDELITY) / n).alias("source_near_rate"), (F.sum("near_earlier") / F.greatest(F.lit(1), n * (n - 1) / 2)).alias("pair_near_rate"),
        (F.countDistinct("state_hash") == n).alias("all_different"), F.bool_and(sound).alias("valid"),
    )
    grid = cells.groupBy("radius", "ratio").agg(
        F.count("*").alias("cells"), F.count_if("valid").alias("valid_cells"), F.sum("requested").alias("requested"), F.sum("accepted").alias("accepted"), F.min("acceptance_rate").alias("acceptance_rate"),
        F.min("anchor_coverage").alias("anchor_coverage"), F.max("source_near_rate").alias("source_near_rate"), F.max("pair_near_rate").alias("pair_near_rate"), F.max("displacement_error").alias("displacement_error"), F.sum("failed_redraws").alias("failed_redraws"),
    )
    eligible = (F.col("valid_cells") == F.col("cells")) & (F.col("accepted") == F.col("requested")) & (F.col("source_near_rate") == 0) & (F.col("pair_near_rate") == 0) & (F.col("displacement_error") <= DISPLACEMENT_TOLERANCE)
    best = F.max(F.when(F.col("eligible"), F.col("anchor_coverage"))).over(W.partitionBy())  # nine rows
    grid = grid.withColumn("eligible", eligible).withColumn("best", best)
    chosen = F.col("eligible") & (F.col("anchor_coverage") == F.col("best")) & (F.col("radius") == TIE[0]) & (F.col("ratio") == TIE[1])
    return cells, grid.withColumn("selected", F.coalesce(chosen, F.lit(False))).drop("best")


KERNEL_ROW = "run int, label int, kernel string, mmd double, mx_error double, mz2_error double"


def kernel_study(spark: SparkSession, seeds: list[int], count: int = 12, layers: int = 2, updates: int = 32) -> tuple[DataFrame, DataFrame]:
    """(rows, correlations): each kernel's MMD of generated states beside the error of their physics; a model is a task."""

    def one(seed: int) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        targets = {c: linalg.ground_states(rng.uniform(*span, count), 4)[2] for c, span in enumerate(((0.2, 0.8), (1.2, 1.8)))}
        model = training.train_diffusion(targets, steps=2, layers=layers, samples=count, forward_seed=seed, source_seed=seed + 1, init_seed=seed + 2, spsa_seed=seed + 3, measurement_seed=seed + 4, updates=updates, rate=0.3, perturbation=0.1)
        made = circuits.generate(model["parameters"], model["angles"], sorted(targets), count, seed + 5, seed + 6, 4)
        rows = []
        for c in targets:
            a, b = linalg.observables(made[c]), linalg.observables(targets[c])
            rows += [(seed, c, k, linalg.mmd(made[c], targets[c], k), abs(a[0].mean() - b[0].mean()), abs(a[1].mean() - b[1].mean())) for k in linalg.KERNELS]
        return pd.DataFrame(rows, columns=["run", "label", "kernel", "mmd", "mx_error", "mz2_error"])

    def every(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for seed in f["run"]:
                yield one(int(seed))

    runs = spark.createDataFrame([(s,) for s in seeds], "run int").repartition(len(seeds), "run")
    rows = runs.mapInPandas(every, KERNEL_ROW)
    scored = rows.withColumn("error", F.col("mx_error") + F.col("mz2_error"))
    from ketframe.functions.columns import safe_corr

    return rows, scored.groupBy("kernel").agg(F.count("*").alias("n"), safe_corr(F.col("mmd"), F.col("error")).alias("pearson"))


def gradient_study(spark: SparkSession, seed: int = 0, count: int = 6, realisations: int = 3, directions: int = 32, epsilon: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(derivatives, conflicts) of single-task losses at one parameter point.

    A row of derivatives is a (class, realisation, direction) cell, and cells are dealt out to tasks;
    a task's signature is its vector of derivatives. conflicts has each task's mean cosine to the
    others and the weight it would get.
    """
    rng = np.random.default_rng(seed)
    spans = ((0.2, 0.8), (1.2, 1.8))
    targets = {c: linalg.ground_states(rng.uniform(*s, count), 4)[2] for c, s in enumerate(spans)}
    sources = {c: [linalg.haar_states(count, seed + 100 * c + r, 4) for r in range(realisations)] for c in targets}
    uniforms = rng.random((realisations, count))
    point = rng.normal(0, 0.15, (2, circuits.reverse_width(4)))
    turns = rng.normal(size=(directions, *point.shape))
    turns /= np.linalg.norm(turns.reshape(directions, -1), axis=1)[:, None, None]
    context = spark.sparkContext.broadcast((targets, sources, uniforms, point, turns))

    def every(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        targets, sources, uniforms, point, turns = context.value
        angles = circuits.condition_angles(targets)
        for f in frames:
            rows = []
            for c, r, d in zip(f["label"], f["realisation"], f["direction"]):
                loss = lambda p, c=c, r=r: linalg.mmd(circuits.reverse_step(sources[c][r], p, angles[c], uniforms[r]), targets[c])
                got = training.directional_derivatives(loss, point, turns[d : d + 1], epsilon).iloc[0]
                rows.append((c, r, d, got["derivative"], got["curvature"]))
            yield pd.DataFrame(rows, columns=["label", "realisation", "direction", "derivative", "curvature"])

    cells = spark.range(2 * realisations * directions).select((F.col("id") % 2).cast("int").alias("label"), (F.floor(F.col("id") / 2) % realisations).cast("int").alias("realisation"), F.floor(F.col("id") / (2 * realisations)).cast("int").alias("direction"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cells.repartition(n, "label", "realisation", "direction").mapInPandas(every, "label int, realisation int, direction int, derivative double, curvature double")
    order = F.array_sort(F.collect_list(F.struct("direction", "derivative")))
    signature = rows.groupBy("label", "realisation").agg(F.transform(order, lambda x: x["derivative"]).alias("v"))
    from ketframe.functions.columns import safe_cosine

    a = signature.select("label", "realisation", F.col("v").alias("a"))
    b = signature.select(F.col("label").alias("other"), F.col("realisation").alias("other_realisation"), F.col("v").alias("b"))
    both = a.join(F.broadcast(b), (F.col("label") != F.col("other")) | (F.col("realisation") != F.col("other_realisation")))  # a handful of tasks
    scored = both.groupBy("label", "realisation").agg(F.avg(F.coalesce(safe_cosine(F.col("a"), F.col("b"))["cosine"], F.lit(0.0))).alias("score"))
    weight = F.exp(5 * F.col("score")) / F.sum(F.exp(5 * F.col("score"))).over(W.partitionBy("label"))
    return rows, scored.withColumn("weight", weight)
