"""Queries over the reference's operators, and the SQL each is held against.

The embeddings table is a table of real six-qubit states once its float vectors are cast to doubles
and normalised; label is the class, and a digest of the id deals the rows out to splits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ketframe.functions import columns as C
from ketframe.operators import audit, diagnostics, envelope, generate, metric_index, mmd, pairs, sampling, training
from ketframe.operators.rounds import cut, shared_folder
from ketframe.plans import studies
from ketframe.sources import json_tree, npz, snapshots, tables

QUBITS = 6

#: SQL of the states: id, label, split and v.
STATES_SQL = """
s AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
st AS (SELECT id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v,
        CASE WHEN substr(md5(CAST(id AS VARCHAR)), 1, 1) < 'b' THEN 'train' WHEN substr(md5(CAST(id AS VARCHAR)), 1, 1) < 'e' THEN 'val' ELSE 'test' END AS split FROM s)
"""
R = lambda x, digits=6: f"round({x}, {digits}) + 0.0"
DOT = "list_dot_product(a.v, b.v)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, split and state; the small file is dealt out to all cores before work on it."""
    digit = F.substring(F.md5(F.col("vec_id").cast("string").cast("binary")), 1, 1)
    split = F.when(digit < "b", "train").when(digit < "e", "val").otherwise("test")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf_dir, "embeddings").repartition(n, "vec_id").select(F.col("vec_id").alias("id"), "label", split.alias("split"), C.unit(F.col("embedding")).alias("state"))


# Pairs ---------------------------------------------------------------------------------------


def pair_fidelity_by_label(spark, sf):
    out = pairs.pair_quantiles(states(spark, sf), {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["label"])
    return out.select("label", "pairs", *(C.rounded(F.col(c)).alias(c) for c in ("mean_fidelity", "q25", "q50", "q75")))


PAIRS_SQL = f"""p AS (SELECT a.label, a.id AS a, b.id AS b, abs({DOT}) AS c, acos(least(abs({DOT}), 1.0)) AS d FROM st a JOIN st b ON a.label = b.label AND a.id < b.id)"""
PAIR_FIDELITY_SQL = f"""WITH {STATES_SQL}, {PAIRS_SQL} SELECT label, count(*) AS pairs, {R('avg(c * c)')} AS mean_fidelity, {R('quantile_cont(d, 0.25)')} AS q25, {R('quantile_cont(d, 0.5)')} AS q50, {R('quantile_cont(d, 0.75)')} AS q75 FROM p GROUP BY label"""


def nearest_in_class(spark, sf):
    near = metric_index.nearest(states(spark, sf), 1, within=["label"])
    return near.select("label", "id", "neighbour", C.rounded(C.fs_stable(F.col("overlap"))).alias("distance"))


NEAREST_SQL = f"""WITH {STATES_SQL}, p AS (SELECT a.label, a.id, b.id AS neighbour, abs({DOT}) AS c, row_number() OVER (PARTITION BY a.id ORDER BY abs({DOT}) DESC, b.id) AS n FROM st a JOIN st b ON a.label = b.label AND a.id <> b.id)
SELECT label, id, neighbour, {R('atan2(sqrt(greatest((1 - c) * (1 + c), 0.0)), c)')} AS distance FROM p WHERE n = 1"""


def knn_edges(spark, sf):
    out = pairs.knn_graph(states(spark, sf), k=3, within=["label"])
    return out.select("label", "a", "b", C.rounded(F.col("distance")).alias("distance"), "eligible")


KNN_SQL = f"""WITH {STATES_SQL}, {PAIRS_SQL}, both_ AS (SELECT label, a AS id, b AS other, c, d FROM p UNION ALL SELECT label, b, a, c, d FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, other) AS r FROM both_), cut AS (SELECT label, quantile_cont(d, 0.75) AS q FROM p GROUP BY label),
e AS (SELECT DISTINCT label, least(id, other) AS a, greatest(id, other) AS b, d FROM n WHERE r <= 3)
SELECT label, a, b, {R('d')} AS distance, d >= 0.04 AND d <= q AS eligible FROM e JOIN cut USING (label)"""


def near_duplicate_states(spark, sf):
    out = metric_index.near_duplicate_pairs(states(spark, sf), 0.25)
    return out.select("a", "b", C.rounded(F.col("fidelity")).alias("fidelity"))


NEAR_DUPLICATE_SQL = f"""WITH {STATES_SQL} SELECT a.id AS a, b.id AS b, {R(f'{DOT} * {DOT}')} AS fidelity FROM st a JOIN st b ON a.id < b.id WHERE {DOT} * {DOT} >= 0.25"""


def unlike_all_others(spark, sf):
    """States that no other of the table comes near: the anti join of near duplicates."""
    s = states(spark, sf)
    return s.select("id", "label").join(metric_index.with_neighbours(s, 0.25), "id", "left_anti")


UNLIKE_SQL = f"""WITH {STATES_SQL} SELECT id, label FROM st a WHERE NOT EXISTS (SELECT 1 FROM st b WHERE a.id <> b.id AND {DOT} * {DOT} >= 0.25)"""


def closest_between_splits(spark, sf):
    out = metric_index.closest_across(states(spark, sf), "split")
    return out.select("split_a", "split_b", C.rounded(C.fs_stable(F.col("overlap"))).alias("distance"))


CLOSEST_SQL = f"""WITH {STATES_SQL}, p AS (SELECT a.split AS split_a, b.split AS split_b, max(abs({DOT})) AS c FROM st a JOIN st b ON a.split < b.split GROUP BY 1, 2)
SELECT split_a, split_b, {R('atan2(sqrt(greatest((1 - c) * (1 + c), 0.0)), c)')} AS distance FROM p"""


def _three_qubits(spark, sf):
    """States of three qubits: the others are found in zero, which leaves the first eight amplitudes."""
    s = states(spark, sf)
    return s.select("id", "label", "split", C.unit(F.slice("state", 1, 8)).alias("state"))


THREE_SQL = f"{STATES_SQL}, tq AS (SELECT id, label, split, list_transform(v[1:8], lambda x: x / sqrt(list_dot_product(v[1:8], v[1:8]))) AS v FROM st)"


def near_projected_states(spark, sf):
    """Near states of three qubits, where few pivot cells have to be seen."""
    out = metric_index.near_duplicate_pairs(_three_qubits(spark, sf), 0.97)
    return out.select("a", "b", C.rounded(F.col("fidelity")).alias("fidelity"))


NEAR_PROJECTED_SQL = f"WITH {THREE_SQL} SELECT a.id AS a, b.id AS b, {R(f'{DOT} * {DOT}')} AS fidelity FROM tq a JOIN tq b ON a.id < b.id WHERE {DOT} * {DOT} >= 0.97"


def nearest_projected(spark, sf):
    """The two nearest other states of three qubits."""
    near = metric_index.nearest(_three_qubits(spark, sf), 2)
    return near.select("id", "neighbour", "rank", C.rounded(C.fs_stable(F.col("overlap"))).alias("distance"))


NEAREST_PROJECTED_SQL = f"""WITH {THREE_SQL}, p AS (SELECT a.id, b.id AS neighbour, abs({DOT}) AS c, row_number() OVER (PARTITION BY a.id ORDER BY abs({DOT}) DESC, b.id) AS n FROM tq a JOIN tq b ON a.id <> b.id)
SELECT id, neighbour, CAST(n AS INTEGER) AS rank, {R('atan2(sqrt(greatest((1 - c) * (1 + c), 0.0)), c)')} AS distance FROM p WHERE n <= 2"""


def fidelity_totals(spark, sf):
    """Mean fidelity of each state to all others."""
    m = pairs.totals_to_others(states(spark, sf))
    return m.select("id", "n", C.rounded(F.col("total") / F.col("n")).alias("score"))


FIDELITY_TOTALS_SQL = f"""WITH {STATES_SQL} SELECT a.id, count(*) AS n, {R(f'avg({DOT} * {DOT})')} AS score FROM st a JOIN st b ON a.id <> b.id GROUP BY a.id"""


def conflict_scores(spark, sf):
    m = pairs.totals_to_others(states(spark, sf), cosine=True)
    return m.select("id", "n", C.rounded(F.col("total") / F.col("n")).alias("score"))


CONFLICT_SQL = f"""WITH {STATES_SQL} SELECT a.id, count(*) AS n, {R(f'avg({DOT})')} AS score FROM st a JOIN st b ON a.id <> b.id GROUP BY a.id"""


def conflict_weights(spark, sf):
    """Softmax weights of scores in each class, their effective sample size and class totals."""
    m = pairs.totals_to_others(states(spark, sf), cosine=True).withColumn("score", F.col("total") / F.col("n"))
    e = m.join(states(spark, sf).select("id", "label"), "id").withColumn("e", F.exp(5 * F.col("score")))
    w = e.withColumn("w", F.col("e") / F.sum("e").over(W.partitionBy("label")))
    out = w.groupBy("label").agg(F.count("*").alias("n"), F.min("w").alias("least"), F.max("w").alias("most"), (1 / F.sum(F.col("w") * F.col("w"))).alias("effective"))
    return out.select("label", "n", *(C.rounded(F.col(c)).alias(c) for c in ("least", "most", "effective")))


WEIGHTS_SQL = f"""WITH {STATES_SQL}, m AS (SELECT a.id, a.label, exp(5 * avg({DOT})) AS e FROM st a JOIN st b ON a.id <> b.id GROUP BY a.id, a.label),
w AS (SELECT label, e / sum(e) OVER (PARTITION BY label) AS w FROM m) SELECT label, count(*) AS n, {R('min(w)')} AS least, {R('max(w)')} AS most, {R('1 / sum(w * w)')} AS effective FROM w GROUP BY label"""


def cosine_groups(spark, sf):
    """Cosines of all pairs in groups: same class or not, with sign shares."""
    s = states(spark, sf)
    rows = audit.cosine_groups(s)
    return rows.select("same_class", "pairs", *(C.rounded(F.col(c)).alias(c) for c in ("mean", "positive", "negative")))


COSINE_SQL = f"""WITH {STATES_SQL} SELECT a.label = b.label AS same_class, count(*) AS pairs, {R(f'avg({DOT})')} AS mean, {R(f'avg(CASE WHEN {DOT} > 0 THEN 1.0 ELSE 0.0 END)')} AS positive, {R(f'avg(CASE WHEN {DOT} < 0 THEN 1.0 ELSE 0.0 END)')} AS negative FROM st a JOIN st b ON a.id < b.id GROUP BY 1"""


def fs_metric(spark, sf):
    """Both distance formulas for each state and the one after it, with their difference."""
    s = states(spark, sf)
    after = s.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("state").alias("t"))
    c = F.abs(C.dot(F.col("state"), F.col("t")))
    m = s.join(after, "id").select("id", "other", c.alias("c"))
    return m.select("id", "other", C.rounded(F.col("c")).alias("overlap"), C.rounded(F.col("c") ** 2).alias("fidelity"), C.rounded(C.fs_acos(F.col("c"))).alias("by_acos"), C.rounded(C.fs_stable(F.col("c"))).alias("by_atan2"), (F.abs(C.fs_acos(F.col("c")) - C.fs_stable(F.col("c"))) < 1e-7).alias("agree"))


FS_METRIC_SQL = f"""WITH {STATES_SQL}, m AS (SELECT a.id, b.id AS other, abs({DOT}) AS c FROM st a JOIN st b ON b.id = a.id + 1)
SELECT id, other, {R('c')} AS overlap, {R('c * c')} AS fidelity, {R('acos(least(c, 1.0))')} AS by_acos, {R('atan2(sqrt(greatest((1 - c) * (1 + c), 0.0)), c)')} AS by_atan2, abs(acos(least(c, 1.0)) - atan2(sqrt(greatest((1 - c) * (1 + c), 0.0)), c)) < 1e-7 AS agree FROM m"""


# Projections and observables -----------------------------------------------------------------


def _observed(spark, sf):
    s = states(spark, sf)
    return s.select("id", "label", "split", C.magnetization_x(F.col("state"), QUBITS).alias("mx"), C.magnetization_z2(F.col("state"), QUBITS).alias("mz2"))


OBSERVED_SQL = f"""{STATES_SQL}, o AS (SELECT id, label, split, (SELECT sum(v[i + 1] * v[xor(i, 1 << q) + 1]) FROM generate_series(0, 63) t(i), generate_series(0, 5) u(q)) / 6 AS mx,
 (SELECT sum(v[i + 1] * v[i + 1] * power((6 - 2 * bit_count(i)) / 6.0, 2)) FROM generate_series(0, 63) t(i)) AS mz2 FROM st)"""


def state_observables(spark, sf):
    return _observed(spark, sf).select("id", "label", C.rounded(F.col("mx")).alias("mx"), C.rounded(F.col("mz2")).alias("mz2"))


STATE_OBSERVABLES_SQL = f"WITH {OBSERVED_SQL} SELECT id, label, {R('mx')} AS mx, {R('mz2')} AS mz2 FROM o"


def observable_means(spark, sf):
    o = _observed(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.avg("mx").alias("mx"), F.stddev_pop("mx").alias("mx_std"), F.avg("mz2").alias("mz2"), F.stddev_pop("mz2").alias("mz2_std"))
    return o.select("label", "n", *(C.rounded(F.col(c)).alias(c) for c in ("mx", "mx_std", "mz2", "mz2_std")))


OBSERVABLE_MEANS_SQL = f"WITH {OBSERVED_SQL} SELECT label, count(*) AS n, {R('avg(mx)')} AS mx, {R('stddev_pop(mx)')} AS mx_std, {R('avg(mz2)')} AS mz2, {R('stddev_pop(mz2)')} AS mz2_std FROM o GROUP BY label"


def class_scores(spark, sf):
    """Loss, accuracy and macro F1 of a threshold on an observable as a predictor of a binary target, by split."""
    o = _observed(spark, sf).select("split", (F.col("label") >= 5).cast("int").alias("y"), (F.col("mx") >= 0).cast("int").alias("p"), "mx")
    rows = audit.binary_scores(o, "split", "y", "p", "mx")
    return rows.select("split", "n", *(C.rounded(F.col(c)).alias(c) for c in ("loss", "accuracy", "macro_f1")))


CLASS_SCORES_SQL = f"""WITH {OBSERVED_SQL}, x AS (SELECT split, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, CASE WHEN mx >= 0 THEN 1 ELSE 0 END AS p, mx FROM o),
c AS (SELECT split, count(*) AS n, avg(power(mx - (2 * y - 1), 2)) AS loss, avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS accuracy,
 count(*) FILTER (y = 1 AND p = 1) AS h1, count(*) FILTER (y = 0 AND p = 0) AS h0, sum(y) + sum(p) AS t1, 2 * count(*) - sum(y) - sum(p) AS t0 FROM x GROUP BY split)
SELECT split, n, {R('loss')} AS loss, {R('accuracy')} AS accuracy, {R('((CASE WHEN t1 > 0 THEN 2.0 * h1 / t1 ELSE 0.0 END) + (CASE WHEN t0 > 0 THEN 2.0 * h0 / t0 ELSE 0.0 END)) / 2')} AS macro_f1 FROM c"""


def train_gate(spark, sf):
    """Ranges of train observables by class, and how many of all rows pass them."""
    o = _observed(spark, sf)
    gate = o.where("split = 'train'").groupBy("label").agg(F.min("mx").alias("a"), F.max("mx").alias("b"), F.min("mz2").alias("c"), F.max("mz2").alias("d"))
    ok = F.col("mx").between(F.col("a"), F.col("b")) & F.col("mz2").between(F.col("c"), F.col("d"))
    return o.join(F.broadcast(gate), "label").groupBy("label", "split").agg(F.count("*").alias("n"), F.count_if(ok).alias("accepted"))


TRAIN_GATE_SQL = f"""WITH {OBSERVED_SQL}, g AS (SELECT label, min(mx) AS a, max(mx) AS b, min(mz2) AS c, max(mz2) AS d FROM o WHERE split = 'train' GROUP BY label)
SELECT label, split, count(*) AS n, count(*) FILTER (mx BETWEEN a AND b AND mz2 BETWEEN c AND d) AS accepted FROM o JOIN g USING (label) GROUP BY label, split"""


def _energy_lines(spark, sf):
    """Each state's energy as a line in the field strength, and a strength of its own."""
    s = states(spark, sf).where(F.col("label").isNotNull())
    v = F.col("state")
    g = F.lit(0.2) + (F.col("id") % 97) / F.lit(60.0)
    mx = C.magnetization_x(v, QUBITS)
    return s.select("id", "label", "split", g.alias("g"), (-QUBITS * mx).alias("slope"), (-C.domain_walls(v, QUBITS)).alias("height"), mx.alias("mx"), C.magnetization_z2(v, QUBITS).alias("mz2"))


ENERGY_SQL = f"""{OBSERVED_SQL}, en AS (SELECT o.id, o.label, o.split, 0.2 + (o.id % 97) / 60.0 AS g, -6 * mx AS m, mx, mz2,
 -(SELECT sum(v[i + 1] * v[i + 1] * (5 - 2 * bit_count(xor(i, i >> 1) & 31))) FROM generate_series(0, 63) t(i)) AS c FROM o JOIN st ON st.id = o.id AND st.label = o.label)"""


def energy_excess(spark, sf):
    """The largest energy that another state of the class has at a state's field strength, and by how much it is more than its own."""
    e = envelope.largest_other(_energy_lines(spark, sf), ["label"], "g", "slope", "height")
    own = F.col("slope") * F.col("g") + F.col("height")
    return e.select("id", "label", C.rounded(own).alias("energy"), C.rounded(F.col("largest_other")).alias("largest_other"), C.rounded(F.col("largest_other") - own).alias("excess"))


ENERGY_EXCESS_SQL = f"""WITH {ENERGY_SQL}, x AS (SELECT a.id, any_value(a.label) AS label, any_value(a.m * a.g + a.c) AS own, max(b.m * a.g + b.c) AS best FROM en a JOIN en b ON a.label = b.label AND a.id <> b.id GROUP BY a.id)
SELECT id, label, {R('own')} AS energy, {R('best')} AS largest_other, {R('best - own')} AS excess FROM x"""


def energy_gate(spark, sf):
    """The acceptance gate that train states give, and how many states of each split pass it at twice their field strength."""
    rows = _energy_lines(spark, sf)
    gate = generate.fit_gate_of(rows.where("split = 'train'").select("label", "g", "slope", "height", "mx", "mz2"))
    moved = rows.select("label", "split", F.lit(1.0).alias("norm"), F.col("mx").alias("magnetization_x"), F.col("mz2").alias("magnetization_z2"), (F.col("slope") * F.col("g")).alias("energy_drift"))
    out = generate.through_gate(moved, gate).groupBy("label", "split").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"))
    return out.join(F.broadcast(gate.select("label", C.rounded(F.col("max_excess")).alias("max_excess"))), "label")


ENERGY_GATE_SQL = f"""WITH {ENERGY_SQL}, tr AS (SELECT * FROM en WHERE split = 'train'),
x AS (SELECT a.label, max((b.m * a.g + b.c) - (a.m * a.g + a.c)) AS most FROM tr a JOIN tr b ON a.label = b.label AND a.id <> b.id GROUP BY a.label),
r AS (SELECT label, min(mx) AS a, max(mx) AS b, min(mz2) AS c, max(mz2) AS d FROM tr GROUP BY label)
SELECT en.label, split, count(*) AS n, count(*) FILTER (mx BETWEEN a AND b AND mz2 BETWEEN r.c AND d AND m * g <= most + 1e-12) AS accepted, any_value({R('most')}) AS max_excess FROM en JOIN x USING (label) JOIN r USING (label) GROUP BY en.label, split"""


def hashed_targets(spark, sf):
    """A digest picks the lower or upper bound of a row's support; the row moves half way to it."""
    l = table(spark, sf, "part").select("p_partkey", "p_size")
    h = C.json_hash(C.quoted(F.lit("target")), F.col("p_partkey"))
    low = F.substring(h, 16, 1).isin(*"02468ace")
    goal = F.when(low, F.lit(0.0)).otherwise(F.lit(50.0))
    return l.select("p_partkey", h.alias("digest"), C.rounded(F.col("p_size") + (goal - F.col("p_size")) * 0.5).alias("target"))


HASHED_TARGETS_SQL = """WITH h AS (SELECT p_partkey, p_size, sha256('["target",' || p_partkey || ']') AS d FROM part)
SELECT p_partkey, d AS digest, round(CAST(p_size AS DOUBLE) + (CASE WHEN substr(d, 16, 1) IN ('0','2','4','6','8','a','c','e') THEN 0.0 ELSE 50.0 END - p_size) * 0.5, 6) + 0.0 AS target FROM h"""


# Kernel distances ----------------------------------------------------------------------------


def class_mmd(spark, sf):
    out = mmd.density_mmd(states(spark, sf), "label")
    return out.select("a", "b", C.rounded(F.col("mmd")).alias("mmd"))


CLASS_MMD_SQL = f"""WITH {STATES_SQL}, k AS (SELECT a.label AS x, b.label AS y, avg({DOT} * {DOT}) AS m FROM st a CROSS JOIN st b GROUP BY 1, 2)
SELECT p.x AS a, p.y AS b, {R('greatest(q.m + r.m - 2 * p.m, 0.0)')} AS mmd FROM k p JOIN k q ON q.x = p.x AND q.y = p.x JOIN k r ON r.x = p.y AND r.y = p.y WHERE p.x < p.y"""


def mmd_contributions(spark, sf):
    """Each aligned pair of rows' share of the MMD between two classes, aligned by rank of id."""
    s = states(spark, sf)
    rank = F.row_number().over(W.partitionBy("label").orderBy("id"))
    r = s.select("label", rank.alias("id"), "state")
    both = r.where("label in (0, 1)").groupBy("id").agg(F.count("*").alias("n")).where("n = 2").select("id")
    pick = lambda c: r.where(F.col("label") == c).join(both, "id").select("id", "state")
    out = mmd.contributions(pick(0), pick(1))
    return out.select(F.col("id").cast("long").alias("id"), C.rounded(F.col("contribution"), 7).alias("contribution"))


CONTRIBUTIONS_SQL = f"""WITH {STATES_SQL}, r AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY id) AS id, v FROM st WHERE label IN (0, 1)),
p AS (SELECT g.id, g.v AS g, t.v AS t FROM r g JOIN r t ON g.id = t.id AND g.label = 0 AND t.label = 1), n AS (SELECT count(*) AS n FROM p),
x AS (SELECT a.id, sum(power(list_dot_product(a.g, b.g), 2) + power(list_dot_product(a.t, b.t), 2) - power(list_dot_product(a.g, b.t), 2) - power(list_dot_product(a.t, b.g), 2)) AS s FROM p a CROSS JOIN p b GROUP BY a.id)
SELECT id, round(s / (n * n), 7) + 0.0 AS contribution FROM x CROSS JOIN n"""


def split_mmd(spark, sf):
    """MMD of validation against train states in each class, by the class's two mean density matrices."""
    s = states(spark, sf).where("split <> 'test'").withColumn("g", F.concat(F.format_string("%02d", "label"), F.lit(" "), F.col("split")))
    out = mmd.density_mmd(s, "g").where(F.substring("a", 1, 2) == F.substring("b", 1, 2))
    return out.select(F.substring("a", 1, 2).cast("int").alias("label"), C.rounded(F.col("mmd")).alias("mmd"))


SPLIT_MMD_SQL = f"""WITH {STATES_SQL}, k AS (SELECT a.label, a.split AS x, b.split AS y, avg({DOT} * {DOT}) AS m FROM st a JOIN st b ON a.label = b.label WHERE a.split <> 'test' AND b.split <> 'test' GROUP BY 1, 2, 3)
SELECT p.label, {R('greatest(q.m + r.m - 2 * p.m, 0.0)')} AS mmd FROM k p JOIN k q ON q.label = p.label AND q.x = 'train' AND q.y = 'train' JOIN k r ON r.label = p.label AND r.x = 'val' AND r.y = 'val' WHERE p.x = 'train' AND p.y = 'val'"""


def cancellation(spark, sf):
    """Norm of the mean vector over the mean norm, by class."""
    s = states(spark, sf).select("label", F.posexplode("state").alias("pos", "x"))
    means = s.groupBy("label", "pos").agg(F.avg("x").alias("m"))
    return means.groupBy("label").agg(C.rounded(F.sqrt(F.sum(F.col("m") * F.col("m")))).alias("ratio"))


CANCELLATION_SQL = f"""WITH {STATES_SQL}, x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM st), m AS (SELECT label, pos, avg(x) AS m FROM x GROUP BY 1, 2)
SELECT label, {R('sqrt(sum(m * m))')} AS ratio FROM m GROUP BY label"""


# Statistics ----------------------------------------------------------------------------------


def finite_stats(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type").agg(*C.finite_stats(F.col("value")))
    return e.select("event_type", "n", *(C.rounded(F.col(c)).alias(c) for c in ("mean", "median", "std", "min", "max")))


FINITE_STATS_SQL = f"SELECT event_type, count(value) AS n, {R('avg(value)')} AS mean, {R('median(value)')} AS median, {R('stddev_pop(value)')} AS std, {R('min(value)')} AS min, {R('max(value)')} AS max FROM events GROUP BY event_type"
SHARES = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def quantile_summary(spark, sf):
    q = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), *C.quantiles(F.col("l_extendedprice"), SHARES))
    return q.select("l_returnflag", "n", *(C.rounded(F.col(c), 4).alias(c) for c in SHARES))


QUANTILE_SQL = "SELECT l_returnflag, count(*) AS n, " + ", ".join(f"{R(f'quantile_cont(l_extendedprice, {q})', 4)} AS {n}" for n, q in SHARES.items()) + " FROM lineitem GROUP BY l_returnflag"


def ks_statistics(spark, sf):
    e = table(spark, sf, "events")
    first = e.agg(F.min("event_type")).first()[0]
    out = audit.ks(e, "event_type", "value", first)
    return out.select("group", C.rounded(F.col("statistic")).alias("statistic"))


KS_SQL = f"""WITH t AS (SELECT min(event_type) AS b FROM events), g AS (SELECT DISTINCT event_type AS g FROM events, t WHERE event_type <> b),
c AS (SELECT event_type AS g, value AS x, count(*) AS n FROM events GROUP BY 1, 2), base AS (SELECT x, n AS m FROM c, t WHERE g = b),
p AS (SELECT g, x, sum(n) AS n, sum(m) AS m FROM (SELECT g.g, x, 0 AS n, m FROM g CROSS JOIN base UNION ALL SELECT c.g, x, n, 0 FROM c, t WHERE c.g <> b) GROUP BY 1, 2),
d AS (SELECT g, abs(sum(n) OVER (PARTITION BY g ORDER BY x) / sum(n) OVER (PARTITION BY g) - sum(m) OVER (PARTITION BY g ORDER BY x) / sum(m) OVER (PARTITION BY g)) AS d FROM p)
SELECT g AS "group", {R('max(d)')} AS statistic FROM d GROUP BY g"""


def robust_floor(spark, sf):
    out = audit.robust_floor(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    return out.select("group", *(C.rounded(F.col(c), 4).alias(c) for c in ("largest", "median", "mad", "bound")))


ROBUST_SQL = f"""WITH m AS (SELECT o_orderpriority AS g, median(o_totalprice) AS median, max(o_totalprice) AS largest FROM orders GROUP BY 1),
d AS (SELECT g, median, largest, median(abs(o_totalprice - median)) AS mad FROM orders JOIN m ON g = o_orderpriority GROUP BY 1, 2, 3)
SELECT g AS "group", {R('largest', 4)} AS largest, {R('median', 4)} AS median, {R('mad', 4)} AS mad, {R('greatest(largest, median + 6 * 1.4826 * mad)', 4)} AS bound FROM d"""


def isolated_gap(spark, sf):
    out = audit.isolated_gap(table(spark, sf, "events"), "event_type", "value", ratio=1.0, share=1.0)
    return out.select("group", *(C.rounded(F.col(c)).alias(c) for c in ("below", "above", "threshold")))


GAP_SQL = f"""WITH x AS (SELECT DISTINCT event_type AS g, value AS x FROM events WHERE value > 0), y AS (SELECT g, x, lead(x) OVER (PARTITION BY g ORDER BY x) AS y FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY y / x DESC, x) AS n FROM y WHERE y IS NOT NULL)
SELECT g AS "group", {R('x')} AS below, {R('y')} AS above, {R('sqrt(x * y)')} AS threshold FROM r WHERE n = 1"""


def correlations(spark, sf):
    l = table(spark, sf, "lineitem")
    p = l.groupBy(F.col("l_returnflag").alias("group")).agg(C.safe_corr(F.col("l_quantity"), F.col("l_extendedprice")).alias("pearson"))
    out = audit.spearman(l, "l_returnflag", "l_quantity", "l_extendedprice").join(p, "group")
    return out.select("group", "n", C.rounded(F.col("pearson")).alias("pearson"), C.rounded(F.col("spearman")).alias("spearman"))


CORRELATION_SQL = f"""WITH r AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y,
 rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS ry FROM lineitem)
SELECT g AS "group", count(*) AS n, {R('corr(x, y)')} AS pearson, {R('corr(rx, ry)')} AS spearman FROM r GROUP BY g"""


def grouping_sets(spark, sf):
    """Statistics of each class, of each split, and of all rows."""
    o = _observed(spark, sf)
    o.createOrReplaceTempView("ketframe_observed")
    q = spark.sql("SELECT label, split, count(*) AS n, avg(mx) AS mean, stddev_pop(mx) AS std, min(mx) AS least, max(mx) AS most FROM ketframe_observed GROUP BY GROUPING SETS ((label), (split), ())")
    return q.select("label", "split", "n", *(C.rounded(F.col(c)).alias(c) for c in ("mean", "std", "least", "most")))


GROUPING_SQL = f"WITH {OBSERVED_SQL} SELECT label, split, count(*) AS n, {R('avg(mx)')} AS mean, {R('stddev_pop(mx)')} AS std, {R('min(mx)')} AS least, {R('max(mx)')} AS most FROM o GROUP BY GROUPING SETS ((label), (split), ())"


def paired_arms(spark, sf):
    """Event types as arms beside the first of them, for each user: wins, ties and losses."""
    e = table(spark, sf, "events")
    arms = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # the arms of a study
    d = audit.paired_deltas(e, ["user_id"], "event_type", "value", arms[0], arms[1:])
    out = audit.win_tie_loss(d, "arm")
    return out.select("arm", "n", C.rounded(F.col("mean"), 5).alias("mean"), C.rounded(F.col("std"), 5).alias("std"), "wins", "ties", "losses")


PAIRED_SQL = f"""WITH m AS (SELECT user_id, event_type AS arm, avg(value) AS v FROM events GROUP BY 1, 2), b AS (SELECT min(event_type) AS b FROM events),
d AS (SELECT a.arm, a.v - c.v AS d FROM m a JOIN m c USING (user_id), b WHERE c.arm = b AND a.arm <> b)
SELECT arm, count(*) AS n, {R('avg(d)', 5)} AS mean, {R('stddev_samp(d)', 5)} AS std, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties, count(*) FILTER (d < 0) AS losses FROM d GROUP BY arm"""


def leave_one_out(spark, sf):
    out = audit.leave_one_out(table(spark, sf, "lineitem"), "l_linenumber", "l_quantity")
    return out.select("group", "n", C.rounded(F.col("mean")).alias("mean"))


LEAVE_ONE_OUT_SQL = f"""SELECT g AS "group", count(*) AS n, {R('avg(l_quantity)')} AS mean FROM lineitem JOIN (SELECT DISTINCT l_linenumber AS g FROM lineitem) ON l_linenumber <> g GROUP BY g"""


def distribution_shift(spark, sf):
    o = _observed(spark, sf).withColumn("drawn", F.col("split") == "val")
    out = audit.distribution_shift(o, "label", "drawn", "mx")
    return out.select("group", C.rounded(F.col("mean_shift")).alias("mean_shift"), C.rounded(F.col("variance_ratio")).alias("variance_ratio"), "overlap")


SHIFT_SQL = f"""WITH {OBSERVED_SQL}, a AS (SELECT label, avg(mx) AS m, stddev_pop(mx) AS s, var_pop(mx) AS v, min(mx) AS l, max(mx) AS h FROM o WHERE split <> 'val' GROUP BY label),
b AS (SELECT label, avg(mx) AS m, var_pop(mx) AS v, min(mx) AS l, max(mx) AS h FROM o WHERE split = 'val' GROUP BY label)
SELECT a.label AS "group", {R('abs(b.m - a.m) / a.s')} AS mean_shift, {R('b.v / a.v')} AS variance_ratio, greatest(a.l, b.l) <= least(a.h, b.h) AS overlap FROM a LEFT JOIN b USING (label)"""


def clipping(spark, sf):
    """How many account balances are below zero and below a tolerance, by nation."""
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.count_if(F.col("c_acctbal") < -100).alias("clearly"), C.rounded(F.avg(F.greatest("c_acctbal", F.lit(0.0))), 4).alias("clipped_mean"))
    return c


CLIPPING_SQL = f"SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS negative, count(*) FILTER (c_acctbal < -100) AS clearly, {R('avg(greatest(c_acctbal, 0.0))', 4)} AS clipped_mean FROM customer GROUP BY c_nationkey"


# Samples and sets ----------------------------------------------------------------------------


def nested_subsets(spark, sf):
    s = states(spark, sf).where("split = 'train'").select(F.col("id").alias("parameter_id"), "label")
    order = s.withColumn("rank", F.sha2(F.concat(F.lit("subset"), F.col("parameter_id").cast("string")).cast("binary"), 256))
    out = sampling.nested_subsets(order, [2, 5, 10], rank="rank")
    return out.select(F.col("parameter_id").alias("id"), "label", "size")


NESTED_SQL = f"""WITH {STATES_SQL}, r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('subset' || id)) AS n FROM st WHERE split = 'train')
SELECT id, label, size FROM r JOIN (VALUES (2), (5), (10)) t(size) ON n <= size"""


def round_robin(spark, sf):
    """Nations of each region take turns: customers in the order of a digest."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    digest = F.sha2(F.concat(F.lit("turn"), F.col("c_custkey").cast("string")).cast("binary"), 256)
    out = sampling.round_robin(c.withColumn("h", digest), "n_name", ["h"], within=["n_regionkey"])
    return out.select("n_regionkey", "c_custkey", "position")


ROUND_ROBIN_SQL = """WITH d AS (SELECT n_regionkey, n_name, c_custkey, row_number() OVER (PARTITION BY n_regionkey, n_name ORDER BY sha256('turn' || c_custkey)) AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT n_regionkey, c_custkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY depth, n_name) - 1 AS INTEGER) AS position FROM d"""


def anchor_schedule(spark, sf):
    """Twenty indices a class over its train states in the order of a digest, with ratio membership."""
    s = states(spark, sf).where("split = 'train'").select("id", "label")
    digest = F.sha2(F.concat(F.lit("anchor"), F.col("id").cast("string")).cast("binary"), 256)
    out = sampling.anchor_schedule(s.withColumn("h", digest), 200, [F.col("h")], {0.5: 50, 1.0: 100, 2.0: 200}, within=["label"])
    return out.select("label", "id", F.col("index").cast("long").alias("position"), F.col("depth").cast("long").alias("depth"), F.array_join(F.transform("member", lambda x: x.cast("string")), ",").alias("member"))


ANCHOR_SQL = f"""WITH {STATES_SQL}, r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('anchor' || id)) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM st WHERE split = 'train'),
x AS (SELECT label, id, d * n + r AS position, d AS depth FROM r JOIN generate_series(0, 199) t(d) ON d * n + r < 200)
SELECT label, id, position, depth, CASE WHEN position < 50 THEN '0.5,1.0,2.0' WHEN position < 100 THEN '1.0,2.0' ELSE '2.0' END AS member FROM x"""


def key_overlaps(spark, sf):
    """Keys that customers, orders and their buyers share."""
    t = lambda n: table(spark, sf, n)
    frames = {"buyers": t("orders").select(F.col("o_custkey").alias("k")), "customers": t("customer").select(F.col("c_custkey").alias("k")), "suppliers": t("supplier").select(F.col("s_suppkey").alias("k")), "users": t("events").select(F.col("user_id").alias("k"))}
    return audit.overlap_counts(frames, "k")


_SETS = {"buyers": "SELECT o_custkey FROM orders", "customers": "SELECT c_custkey FROM customer", "suppliers": "SELECT s_suppkey FROM supplier", "users": "SELECT user_id FROM events"}
OVERLAP_SQL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS shared FROM ({_SETS[a]} INTERSECT {_SETS[b]})" for a in _SETS for b in _SETS if a < b)


def manifest_audit(spark, sf):
    return tables.manifest_audit(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k")


MANIFEST_SQL = """WITH a AS (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT count(a.k) AS left_keys, count(b.k) AS right_keys, count(*) FILTER (a.n > 1) AS left_repeated, count(*) FILTER (b.n > 1) AS right_repeated,
 count(*) FILTER (b.k IS NULL) AS only_left, count(*) FILTER (a.k IS NULL) AS only_right FROM a FULL JOIN b ON a.k = b.k"""


def state_table_audit(spark, sf):
    """One row a split: counts, the largest norm error before and after normalising, classes."""
    raw = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), C.dot(F.col("embedding").cast("array<double>"), F.col("embedding").cast("array<double>")).alias("norm2"))
    s = states(spark, sf).join(raw, "id")
    return s.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("label").alias("classes"), (F.max(F.abs(F.col("norm2") - 1)) < 1e-6).alias("raw_close"), (F.max(F.abs(C.dot(F.col("state"), F.col("state")) - 1)) < 1e-12).alias("unit"))


STATE_AUDIT_SQL = f"""WITH {STATES_SQL}, x AS (SELECT st.*, list_dot_product(e, e) AS n2 FROM st JOIN s USING (id))
SELECT split, count(*) AS n, count(DISTINCT label) AS classes, max(abs(n2 - 1)) < 1e-6 AS raw_close, max(abs(list_dot_product(v, v) - 1)) < 1e-12 AS unit FROM x GROUP BY split"""


def run_matrix(spark, sf):
    """Regime by repeat by budget with block numbers, times the arms of a study."""
    grid = spark.range(0, 48).select((F.col("id") / 24).cast("int").alias("regime"), ((F.col("id") % 24) / 8).cast("int").alias("repeat"), ((F.col("id") % 8) / 2).cast("int").alias("budget"), (F.col("id") % 2).cast("int").alias("arm"))
    block = F.format_string("block/%02d", F.col("regime") * 12 + F.col("repeat") * 4 + F.col("budget"))
    return grid.select("regime", "repeat", "budget", "arm", block.alias("block"), F.sha2(F.concat_ws("|", block, F.col("arm").cast("string")).cast("binary"), 256).alias("run_id"))


RUN_MATRIX_SQL = """SELECT CAST(r AS INTEGER) AS regime, CAST(p AS INTEGER) AS repeat, CAST(b AS INTEGER) AS budget, CAST(a AS INTEGER) AS arm, printf('block/%02d', r * 12 + p * 4 + b) AS block, sha256(printf('block/%02d', r * 12 + p * 4 + b) || '|' || a) AS run_id
FROM generate_series(0, 1) t(r), generate_series(0, 2) u(p), generate_series(0, 3) v(b), generate_series(0, 1) w(a)"""


def contract_checks(spark, sf):
    """Checks of the order table by year: unique keys, no nulls, known customers; PASS or the failing names."""
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("known"))
    x = o.join(c, "o_custkey", "left").groupBy(F.year("o_orderdate").alias("y")).agg((F.count("*") == F.countDistinct("o_orderkey")).alias("unique_keys"), (F.count_if(F.col("known").isNull()) == 0).alias("known_customers"), (F.max("o_totalprice") < 400_000).alias("price_limit"))
    checks = x.select("y", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("ok")) for n in ("unique_keys", "known_customers", "price_limit")))).alias("c")).select("y", "c.*")
    out = audit.gate_status(checks, "y", "name", "ok")
    return out.select(F.col("group").alias("year"), "status", F.array_join("blocking", ",").alias("blocking"))


CONTRACT_SQL = """WITH x AS (SELECT year(o_orderdate) AS y, count(*) = count(DISTINCT o_orderkey) AS u, count(*) FILTER (c_custkey IS NULL) = 0 AS k, max(o_totalprice) < 400000 AS p FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1),
f AS (SELECT y, concat_ws(',', CASE WHEN NOT k THEN 'known_customers' END, CASE WHEN NOT p THEN 'price_limit' END, CASE WHEN NOT u THEN 'unique_keys' END) AS b FROM x)
SELECT CAST(y AS INTEGER) AS year, CASE WHEN b = '' THEN 'PASS' ELSE 'BLOCKED' END AS status, b AS blocking FROM f"""


def study_decisions(spark, sf):
    """Named checks on each class's statistics, and GO only where all hold."""
    o = _observed(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.avg("mx").alias("m"), F.stddev_pop("mz2").alias("s"))
    out = audit.decide(o, {"enough": F.col("n") >= 40, "centred": F.abs(F.col("m")) < 0.1, "spread": F.col("s") > 0.01})
    return out.select("label", "enough", "centred", "spread", F.array_join("failed", ",").alias("failed"), "decision")


DECISION_SQL = f"""WITH {OBSERVED_SQL}, x AS (SELECT label, count(*) >= 40 AS enough, abs(avg(mx)) < 0.1 AS centred, stddev_pop(mz2) > 0.01 AS spread FROM o GROUP BY label)
SELECT label, enough, centred, spread, concat_ws(',', CASE WHEN NOT enough THEN 'enough' END, CASE WHEN NOT centred THEN 'centred' END, CASE WHEN NOT spread THEN 'spread' END) AS failed, CASE WHEN enough AND centred AND spread THEN 'GO' ELSE 'NO-GO' END AS decision FROM x"""


def resumable_runs(spark, sf):
    """Orders still to do: those without a valid finished line, the anti join of a resumed run."""
    lines = table(spark, sf, "lineitem")
    done = lines.where((F.col("l_linestatus") == "F") & F.col("l_discount").between(0, 1)).select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(done, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


RESUMABLE_SQL = "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F' AND l_discount BETWEEN 0 AND 1)"


# Without SQL: seeded generators, circuits and training ---------------------------------------

#: The published generator configuration of the random data set.
ISING = {
    "n_qubits": 4, "J": 1.0, "boundary": "open", "phase_regions": {"ferromagnetic": [0.2, 0.8], "paramagnetic": [1.2, 1.8]}, "samples_per_class": 200,
    "dataset_seed": 1729, "split_seed": 2718, "split_strategy": "random", "split_ratios": {"train": 0.7, "val": 0.15, "test": 0.15},
}


#: The published configuration of the blocked data set.
BLOCKED = ISING | {"split_strategy": "blocked", "blocked_g_gap": 0.02}


def _states_of(spark, config: dict) -> DataFrame:
    return generate.ising_dataset(spark, config, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ising_states(spark, sf):
    """The state table of both phases, solved in Arrow batches."""
    return _states_of(spark, ISING)


def _sources(spark, sf, size: int = 10) -> DataFrame:
    d = ising_states(spark, sf)
    return sampling.nested_subsets(d.where("split = 'train'"), [size], seed=1).drop("size")


def unitary_augmentation(spark, sf):
    s = _sources(spark, sf)
    rows = generate.augment_by_unitary(s, 4, [0.0, 0.05, 0.1, 0.2, 0.4, 0.8], [0, 1])
    return generate.through_gate(rows, generate.fit_gate(ising_states(spark, sf), 4)).drop("state")


def geodesic_pool(spark, sf):
    return generate.geodesic_pool(_sources(spark, sf), "random", 0).drop("state")


def matched_controls(spark, sf):
    s = _sources(spark, sf)
    return generate.matched_controls(generate.geodesic_pool(s, "random", 0), s, 0).drop("state")


def tangent_pool(spark, sf):
    return generate.tangent_pool(_sources(spark, sf), "random", 0).drop("state")


def confirmatory_tangents(spark, sf):
    return generate.confirmatory_batch(_sources(spark, sf), {0: 0.2, 1: 0.1}, 15007963261698017722).drop("state")


def rdm_kernel_mmd(spark, sf):
    """MMD between the splits of each class by the mean fidelity of one-qubit reduced states."""
    out = mmd.qubit_kernel_mmd(states(spark, sf), "split", QUBITS, ["label"])
    return out.select("label", "a", "b", C.rounded(F.col("mmd")).alias("mmd"))


RDM_SQL = f"""WITH {STATES_SQL}, r AS (SELECT id, label, split, q, (SELECT sum(v[i + 1] * v[xor(i, 1 << q) + 1]) FROM generate_series(0, 63) t(i)) AS x,
 (SELECT sum(v[i + 1] * v[i + 1] * CASE WHEN (i >> q) & 1 = 1 THEN -1 ELSE 1 END) FROM generate_series(0, 63) t(i)) AS z FROM st, generate_series(0, 5) u(q)),
f AS (SELECT *, sqrt(greatest(1 - x * x - z * z, 0.0)) AS s FROM r),
k AS (SELECT a.label, a.split AS a, b.split AS b, avg((1 + a.x * b.x + a.z * b.z + a.s * b.s) / 2) AS m FROM f a JOIN f b ON a.label = b.label AND a.q = b.q GROUP BY 1, 2, 3)
SELECT p.label, p.a, p.b, {R('greatest(x.m + y.m - 2 * p.m, 0.0)')} AS mmd FROM k p JOIN k x ON x.label = p.label AND x.a = p.a AND x.b = p.a JOIN k y ON y.label = p.label AND y.a = p.b AND y.b = p.b WHERE p.a < p.b"""


def two_qubit_kernel_mmd(spark, sf):
    """MMD between the splits of the whole table by the mean fidelity of two-qubit reduced states of three qubits."""
    out = mmd.blocked_kernel_mmd(_three_qubits(spark, sf), "split", "2-rdm", ["label"])
    return out.select("label", "a", "b", C.rounded(F.col("mmd")).alias("mmd"))


def classifier_training(spark, sf):
    """The published sweep: four sizes and three seeds on the random and the blocked data set, a run a task."""
    out = None
    for name, config in (("random", ISING), ("blocked", BLOCKED)):
        runs, _ = studies.baseline_sweep(_states_of(spark, config), [10, 25, 50, 100], [(1000 + i, 2000 + i) for i in range(3)])
        runs = runs.withColumn("dataset", F.lit(name)).drop("parameters")
        out = runs if out is None else out.unionByName(runs)
    return out


def radius_calibration(spark, sf):
    """The calibration grid of tangent radii and ratios over both data sets, and which of it is selected."""
    return studies.radius_calibration({"random": _states_of(spark, ISING), "blocked": _states_of(spark, BLOCKED)})[1]


def kernel_study(spark, sf):
    """How each kernel's MMD follows the error of the physics over a few models."""
    return studies.kernel_study(spark, [1, 2, 3, 4])[1]


def gradient_study(spark, sf):
    """Mean cosine of each task's derivatives to the others', and the weight that follows."""
    return studies.gradient_study(spark)[1]


def diffusion_training(spark, sf):
    """Two-qubit diffusion models in the three source modes."""
    runs = spark.createDataFrame([(m, 2, 16, 16, 2, 3, 64, 0.3, 0.1, 7, m) for m in ("chain", "haar", "teacher_forced")], "run_id string, n_qubits int, count int, samples int, steps int, layers int, updates int, rate double, perturbation double, seed int, mode string")
    return training.run_diffusions(runs).drop("parameters")


def diffusion_trajectories(spark, sf):
    d = _sources(spark, sf)
    rows = d.withColumn("row", F.row_number().over(W.partitionBy("label").orderBy("parameter_id")) - 1).select("label", "row", "state")
    return generate.diffusion_trajectories(rows, 3, 11).select("label", "row", "t", F.size("state.re").alias("size"))


def constrained_split(spark, sf):
    """A split of the state table in which near states stay together."""
    d = ising_states(spark, sf).select(F.col("parameter_id").alias("id"), "label", "state")
    return sampling.constrained_split(d, {"train": 140, "val": 30, "test": 30}, 1e-5, 15007963261698017722)


def component_split(spark, sf):
    """Rows of each class and split of a new split that parts no near states where such a split exists, and how many near pairs it parts.

    Where one component of near states is larger than any quota no split has both; the quotas hold and `parted` tells.
    """
    s = states(spark, sf).select("id", "label", "state")
    near = cut(metric_index.near_duplicate_pairs(s, 0.25).select("a", "b"))
    got = sampling.component_split(s, {"train": 0.7, "val": 0.15, "test": 0.15}, 0.25, 5, near=near, part_large=True)
    parted = near.join(got.select(F.col("id").alias("a"), F.col("split").alias("x")), "a").join(got.select(F.col("id").alias("b"), F.col("split").alias("y")), "b").agg(F.count_if(F.col("x") != F.col("y")).alias("parted"), F.count("*").alias("near_pairs"))
    return got.groupBy("label", "split").agg(F.count("*").alias("n")).join(F.broadcast(parted), F.lit(True))  # one row


COMPONENT_SPLIT_SQL = f"""WITH {STATES_SQL}, q AS (SELECT label, count(*) AS n FROM st GROUP BY 1), p AS (SELECT count(*) AS near_pairs FROM st a JOIN st b ON a.id < b.id WHERE {DOT} * {DOT} >= 0.25),
r AS (SELECT label, 'train' AS split, round(n * CAST(0.7 AS DOUBLE)) AS n FROM q UNION ALL SELECT label, 'val', round(n * CAST(0.85 AS DOUBLE)) - round(n * CAST(0.7 AS DOUBLE)) FROM q UNION ALL SELECT label, 'test', n - round(n * CAST(0.85 AS DOUBLE)) FROM q)
SELECT label, split, CAST(n AS BIGINT) AS n, CAST(0 AS BIGINT) AS parted, near_pairs FROM r CROSS JOIN p"""


def greedy_unique(spark, sf):
    return sampling.greedy_unique(states(spark, sf), "label", 0.75)


GREEDY_SQL = f"""WITH RECURSIVE {STATES_SQL}, r AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY id) AS n, v FROM st),
e AS (SELECT b.label, b.n, list(a.n) FILTER (a.n IS NOT NULL) AS earlier FROM r b LEFT JOIN r a ON a.label = b.label AND a.n < b.n AND {DOT} * {DOT} >= 0.25 GROUP BY 1, 2),
g AS (SELECT DISTINCT label, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept FROM r
 UNION ALL SELECT g.label, e.n, CASE WHEN e.earlier IS NOT NULL AND list_has_any(g.kept, e.earlier) THEN g.kept ELSE list_append(g.kept, e.n) END FROM g JOIN e ON e.label = g.label AND e.n = g.n + 1)
SELECT label AS "group", max(n) AS n, max(len(kept)) AS "unique" FROM g GROUP BY label"""


def bootstrap_intervals(spark, sf):
    e = table(spark, sf, "events")
    arms = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]
    d = audit.paired_deltas(e, ["user_id"], "event_type", "value", arms[0], arms[1:])
    return training.bootstrap_intervals(d, "arm", "delta", seed=3)


def redrawn_corpus(spark, sf):
    from ketframe.functions.seeds import named_seed

    regions = {"random": [(0, 0.2, 0.8, 40), (1, 1.2, 1.8, 40)], "blocked_g": [(0, 0.2, 0.6, 40), (1, 1.2, 1.6, 40)]}
    return generate.redrawn_corpus(spark, regions, 4, {r: named_seed(7, f"dataset.{r}") for r in regions}).drop("state")


# Ensembles and corpora -----------------------------------------------------------------------


def group_diversity(spark, sf):
    """Mean fidelity of different members of each class and split."""
    out = diagnostics.group_diversity(states(spark, sf), ["label", "split"])
    return out.select("label", "split", "n", C.rounded(F.col("mean_fidelity")).alias("mean_fidelity"))


DIVERSITY_SQL = f"""WITH {STATES_SQL}, n AS (SELECT label, split, count(*) AS n FROM st GROUP BY 1, 2), p AS (SELECT a.label, a.split, avg({DOT} * {DOT}) AS f FROM st a JOIN st b ON a.label = b.label AND a.split = b.split AND a.id <> b.id GROUP BY 1, 2)
SELECT label, split, n, {R('f')} AS mean_fidelity FROM n LEFT JOIN p USING (label, split)"""


def outcome_mmd(spark, sf):
    """Validation and test states as two outcomes beside the train states of each class."""
    s = states(spark, sf).withColumn("outcome", (F.col("split") == "val").cast("int"))
    out = diagnostics.outcome_mmd(s.where("split <> 'train'"), s.where("split = 'train'"))
    return out.select("label", C.rounded(F.col("per_outcome")).alias("per_outcome"), C.rounded(F.col("pooled")).alias("pooled"))


OUTCOME_SQL = f"""WITH {STATES_SQL}, x AS (SELECT label, v, 'g' || split AS k FROM st WHERE split <> 'train' UNION ALL SELECT label, v, 'p' FROM st WHERE split <> 'train' UNION ALL SELECT label, v, 't' FROM st WHERE split = 'train'),
k AS (SELECT a.label, a.k AS x, b.k AS y, avg({DOT} * {DOT}) AS m FROM x a JOIN x b ON a.label = b.label GROUP BY 1, 2, 3),
d AS (SELECT p.label, p.x, q.m + r.m - 2 * p.m AS d FROM k p JOIN k q ON q.label = p.label AND q.x = p.x AND q.y = p.x JOIN k r ON r.label = p.label AND r.x = 't' AND r.y = 't' WHERE p.y = 't' AND p.x <> 't')
SELECT label, {R("avg(d) FILTER (x <> 'p')")} AS per_outcome, {R("max(d) FILTER (x = 'p')")} AS pooled FROM d GROUP BY label"""


def signature_alignment(spark, sf):
    """Correlation, sign agreement and conflict of the classes' mean vectors."""
    s = states(spark, sf).select("label", F.posexplode("state").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda y: y["x"])
    out = diagnostics.signature_alignment(s.groupBy(F.col("label").alias("task")).agg(v.alias("v")))
    return out.select("a", "b", C.rounded(F.col("correlation")).alias("correlation"), C.rounded(F.col("sign_agreement")).alias("sign_agreement"), "conflict")


ALIGNMENT_SQL = f"""WITH {STATES_SQL}, x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM st), m AS (SELECT label, pos, avg(x) AS x FROM x GROUP BY 1, 2)
SELECT a.label AS a, b.label AS b, {R('corr(a.x, b.x)')} AS correlation, {R('avg(CASE WHEN sign(a.x) = sign(b.x) THEN 1.0 ELSE 0.0 END)')} AS sign_agreement, sum(a.x * b.x) < 0 AS conflict FROM m a JOIN m b ON a.pos = b.pos AND a.label < b.label GROUP BY 1, 2"""


def nearest_parameters(spark, sf):
    """The least difference of an observable of a class between splits."""
    out = diagnostics.nearest_parameters(_observed(spark, sf).select("label", "split", F.col("mx").alias("g")))
    return out.select("split_a", "split_b", C.rounded(F.col("gap"), 8).alias("gap"))


NEAREST_PARAMETERS_SQL = f"""WITH {OBSERVED_SQL} SELECT a.split AS split_a, b.split AS split_b, {R('min(abs(a.mx - b.mx))', 8)} AS gap FROM o a JOIN o b ON a.label = b.label AND a.split < b.split GROUP BY 1, 2"""


def candidate_diagnostics(spark, sf):
    s = _sources(spark, sf)
    p = generate.geodesic_pool(s, "random", 0)
    return diagnostics.candidate_diagnostics(p.select("candidate_id", "label", F.array("source_a", "source_b").alias("source_ids"), "state"), s)


def symmetry_audit(spark, sf):
    return diagnostics.symmetry_audit(ising_states(spark, sf), 4)


def dataset_audit(spark, sf):
    return diagnostics.dataset_audit(ising_states(spark, sf), 4)


def numerical_floor(spark, sf):
    return audit.robust_floor(diagnostics.numerical_floor(ising_states(spark, sf), 4), "label", "distance")


def freshness(spark, sf):
    """A corpus of other seeds against the published one."""
    other = generate.ising_dataset(spark, ISING | {"dataset_seed": 99, "samples_per_class": 40})
    return diagnostics.freshness(other, ising_states(spark, sf))


def ensemble_metrics(spark, sf):
    d = ising_states(spark, sf)
    return diagnostics.ensemble_metrics(d.where("split = 'val'"), d.where("split = 'train'"))


def gram_floor(spark, sf):
    return diagnostics.gram_floor(_sources(spark, sf, 25), "1-rdm")


# Sources --------------------------------------------------------------------------------------


def npz_states(spark, sf):
    """The table written as NPZ archives and read back, digests checked: what each state has come back as."""
    path = f"{shared_folder(spark)}/npz-{uuid.uuid4().hex}"
    npz.write_npz(states(spark, sf).where(F.col("label").isNotNull()), path)
    v = F.col("state")
    return npz.read_npz(spark, path, verify="true").select("id", "label", "split", F.size(v).alias("amplitudes"), C.rounded(F.element_at(v, 1)).alias("first"), C.rounded(F.element_at(v, -1)).alias("last"), C.rounded(C.dot(v, v)).alias("norm"))


NPZ_SQL = f"WITH {STATES_SQL} SELECT id, label, split, CAST(len(v) AS INTEGER) AS amplitudes, {R('v[1]')} AS first, {R('v[-1]')} AS last, {R('list_dot_product(v, v)')} AS norm FROM st WHERE label IS NOT NULL"


def json_harvest(spark, sf):
    """Sizes and names at any depth of a report for each part; a tenth of the reports are cut off and give none."""
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_type")
    inner = F.struct(F.col("p_type").alias("name"), F.lit(1).alias("other"))
    runs = F.array(F.struct(F.col("p_brand").alias("name"), F.when(F.lit(False), inner).alias("inner")), F.struct(F.lit(None).cast("string").alias("name"), inner.alias("inner")))
    report = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.struct(F.col("p_size").alias("size"), runs.alias("runs")).alias("result")))
    told = F.when(F.col("p_partkey") % 10 == 0, F.substring(report, 1, 25)).otherwise(report)
    rows = p.select("p_partkey", told.alias("report"))
    bad = json_tree.unparsed(rows, "report").select("p_partkey", F.lit("").alias("path"), F.lit("unread").alias("name"), F.lit("").alias("value"))
    return json_tree.scalars(rows, "report", ["size", "name"]).unionByName(bad)


JSON_HARVEST_SQL = """WITH p AS (SELECT * FROM part WHERE p_partkey % 10 <> 0)
SELECT p_partkey, '$.result.size' AS path, 'size' AS name, CAST(p_size AS VARCHAR) AS value FROM p
UNION ALL SELECT p_partkey, '$.result.runs[0].name', 'name', '"' || p_brand || '"' FROM p
UNION ALL SELECT p_partkey, '$.result.runs[1].inner.name', 'name', '"' || p_type || '"' FROM p
UNION ALL SELECT p_partkey, '', 'unread', '' FROM part WHERE p_partkey % 10 = 0"""


def table_tree(spark, sf):
    """Tree of digests over the parts' keys, brands and sizes."""
    return snapshots.digest_tree(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), 2)


TREE_SQL = """WITH r AS (SELECT sha256(string_agg(strlen(x) || ':' || x || ';', '' ORDER BY k)) AS d FROM (
  SELECT p_partkey, unnest([p_brand, CAST(p_partkey AS VARCHAR), CAST(p_size AS VARCHAR)]) AS x, unnest([1, 2, 3]) AS k FROM part) GROUP BY p_partkey),
l AS (SELECT substr(d, 1, 2) AS node, CAST(count(*) AS BIGINT) AS n, sha256(string_agg(d || '*1', ',' ORDER BY d)) AS digest FROM r GROUP BY 1),
m AS (SELECT substr(node, 1, 1) AS up, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(node || ':' || digest, ',' ORDER BY node)) AS digest FROM l GROUP BY 1)
SELECT 2 AS level, node, n, digest FROM l UNION ALL SELECT 1, up, n, digest FROM m
UNION ALL SELECT 0, '', CAST(sum(n) AS BIGINT), sha256(string_agg(up || ':' || digest, ',' ORDER BY up)) FROM m"""


def changed_table_rows(spark, sf):
    """What an altered table has more and less than the first, found by descending both trees."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    other = p.where(F.col("p_partkey") % 101 != 5).withColumn("p_size", F.when(F.col("p_partkey") % 97 == 3, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return snapshots.changed_rows(p, other.unionByName(p.where(F.col("p_partkey") % 89 == 7)), 3)


CHANGED_ROWS_SQL = """WITH p AS (SELECT p_partkey, p_brand, p_size FROM part),
o AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 97 = 3 THEN p_size + 1 ELSE p_size END AS p_size FROM p WHERE p_partkey % 101 <> 5 UNION ALL SELECT * FROM p WHERE p_partkey % 89 = 7),
c AS (SELECT p_partkey, p_brand, p_size, sum(n) AS n FROM (SELECT *, 1 AS n FROM p UNION ALL SELECT *, -1 FROM o) GROUP BY ALL)
SELECT CASE WHEN n > 0 THEN 'removed' ELSE 'added' END AS change, CAST(abs(n) AS BIGINT) AS copies, p_partkey, p_brand, p_size FROM c WHERE n <> 0"""


_QUERIES = {
    "pair_fidelity_by_label": (pair_fidelity_by_label, PAIR_FIDELITY_SQL), "nearest_in_class": (nearest_in_class, NEAREST_SQL), "knn_edges": (knn_edges, KNN_SQL),
    "near_duplicate_states": (near_duplicate_states, NEAR_DUPLICATE_SQL), "unlike_all_others": (unlike_all_others, UNLIKE_SQL), "closest_between_splits": (closest_between_splits, CLOSEST_SQL),
    "near_projected_states": (near_projected_states, NEAR_PROJECTED_SQL), "nearest_projected": (nearest_projected, NEAREST_PROJECTED_SQL), "fidelity_totals": (fidelity_totals, FIDELITY_TOTALS_SQL),
    "component_split": (component_split, COMPONENT_SPLIT_SQL), "two_qubit_kernel_mmd": (two_qubit_kernel_mmd, None), "conflict_scores": (conflict_scores, CONFLICT_SQL), "conflict_weights": (conflict_weights, WEIGHTS_SQL), "cosine_groups": (cosine_groups, COSINE_SQL), "fs_metric": (fs_metric, FS_METRIC_SQL),
    "state_observables": (state_observables, STATE_OBSERVABLES_SQL), "observable_means": (observable_means, OBSERVABLE_MEANS_SQL), "class_scores": (class_scores, CLASS_SCORES_SQL),
    "train_gate": (train_gate, TRAIN_GATE_SQL), "energy_excess": (energy_excess, ENERGY_EXCESS_SQL), "energy_gate": (energy_gate, ENERGY_GATE_SQL), "hashed_targets": (hashed_targets, HASHED_TARGETS_SQL), "class_mmd": (class_mmd, CLASS_MMD_SQL), "mmd_contributions": (mmd_contributions, CONTRIBUTIONS_SQL),
    "split_mmd": (split_mmd, SPLIT_MMD_SQL), "cancellation": (cancellation, CANCELLATION_SQL), "finite_stats": (finite_stats, FINITE_STATS_SQL), "quantile_summary": (quantile_summary, QUANTILE_SQL),
    "ks_statistics": (ks_statistics, KS_SQL), "robust_floor": (robust_floor, ROBUST_SQL), "isolated_gap": (isolated_gap, GAP_SQL), "correlations": (correlations, CORRELATION_SQL),
    "grouping_sets": (grouping_sets, GROUPING_SQL), "paired_arms": (paired_arms, PAIRED_SQL), "leave_one_out": (leave_one_out, LEAVE_ONE_OUT_SQL), "distribution_shift": (distribution_shift, SHIFT_SQL),
    "clipping": (clipping, CLIPPING_SQL), "nested_subsets": (nested_subsets, NESTED_SQL), "round_robin": (round_robin, ROUND_ROBIN_SQL), "anchor_schedule": (anchor_schedule, ANCHOR_SQL),
    "key_overlaps": (key_overlaps, OVERLAP_SQL), "manifest_audit": (manifest_audit, MANIFEST_SQL), "state_table_audit": (state_table_audit, STATE_AUDIT_SQL), "run_matrix": (run_matrix, RUN_MATRIX_SQL),
    "contract_checks": (contract_checks, CONTRACT_SQL), "study_decisions": (study_decisions, DECISION_SQL), "resumable_runs": (resumable_runs, RESUMABLE_SQL),
    "ising_states": (ising_states, None), "unitary_augmentation": (unitary_augmentation, None), "geodesic_pool": (geodesic_pool, None), "matched_controls": (matched_controls, None),
    "tangent_pool": (tangent_pool, None), "confirmatory_tangents": (confirmatory_tangents, None), "rdm_kernel_mmd": (rdm_kernel_mmd, RDM_SQL), "classifier_training": (classifier_training, None),
    "diffusion_training": (diffusion_training, None), "diffusion_trajectories": (diffusion_trajectories, None), "constrained_split": (constrained_split, None), "greedy_unique": (greedy_unique, GREEDY_SQL),
    "bootstrap_intervals": (bootstrap_intervals, None), "redrawn_corpus": (redrawn_corpus, None),
    "group_diversity": (group_diversity, DIVERSITY_SQL), "outcome_mmd": (outcome_mmd, OUTCOME_SQL), "signature_alignment": (signature_alignment, ALIGNMENT_SQL), "nearest_parameters": (nearest_parameters, NEAREST_PARAMETERS_SQL),
    "candidate_diagnostics": (candidate_diagnostics, None), "symmetry_audit": (symmetry_audit, None), "dataset_audit": (dataset_audit, None), "numerical_floor": (numerical_floor, None),
    "freshness": (freshness, None), "ensemble_metrics": (ensemble_metrics, None), "gram_floor": (gram_floor, None),
    "npz_states": (npz_states, NPZ_SQL), "json_harvest": (json_harvest, JSON_HARVEST_SQL), "table_tree": (table_tree, TREE_SQL), "changed_table_rows": (changed_table_rows, CHANGED_ROWS_SQL),
    "radius_calibration": (radius_calibration, None), "kernel_study": (kernel_study, None), "gradient_study": (gradient_study, None),
}


#: Over generated states or lists of runs; they read no table, so they are run by tests and studies, not registered.
GENERATED = {
    "ising_states", "unitary_augmentation", "geodesic_pool", "matched_controls", "tangent_pool", "confirmatory_tangents", "classifier_training", "diffusion_training",
    "diffusion_trajectories", "constrained_split", "redrawn_corpus", "candidate_diagnostics", "symmetry_audit", "dataset_audit", "numerical_floor", "freshness",
    "ensemble_metrics", "gram_floor", "radius_calibration", "kernel_study", "gradient_study", "run_matrix",
}


def every_query():
    return {name: q for name, (q, _) in _QUERIES.items()}


def every_sql():
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}


def queries():
    return {name: q for name, q in every_query().items() if name not in GENERATED}


def oracle_sql():
    return {name: sql for name, sql in every_sql().items() if name not in GENERATED}
