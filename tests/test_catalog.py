"""Every query with SQL against it, and the others for rows and a stable schema."""

import pytest

from ketframe.plans import catalog
from tests.duck import same_rows

SQL = catalog.every_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    same_rows(catalog.every_query()[name](spark, sf), SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalog.every_query()) - set(SQL) - {"classifier_training", "diffusion_training"}))
def test_rows(spark, name):
    df = catalog.every_query()[name](spark, "/root/testdata/sf0.001")
    assert len(df.collect()) > 0


def test_published_sweep(spark):
    """Means and deviations of the test accuracy that are published for this sweep."""
    from pyspark.sql import functions as F

    runs = catalog.every_query()["classifier_training"](spark, "/root/testdata/sf0.001")
    rows = runs.groupBy("dataset", "size").agg(F.count_if(F.col("status") == "completed").alias("n"), F.avg("test_accuracy").alias("mean"), F.stddev_pop("test_accuracy").alias("std")).collect()
    got = {(r.dataset, r["size"]): (round(r["mean"], 4), round(r["std"], 4)) for r in rows}
    assert len(got) == 8 and all(r.n == 3 for r in rows)
    assert got["random", 10] == (0.9222, 0.0079) and got["random", 100] == (0.9944, 0.0079)
    assert got["blocked", 10] == (0.9, 0.072) and got["blocked", 100] == (0.7722, 0.0283)
