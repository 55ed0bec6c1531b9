"""The sliced order rules against straightforward per-key loops, with one key holding a third of the rows."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators.ordering import (
    beside, exact_percentiles, first_n_by, first_of_island, hash_sample, join_null_safe, previous_row,
)


def skewed_rows(n, seed, span):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.34 else f"k{rng.randrange(40)}", rng.randrange(span), i) for i in range(n)]


def by_key(rows):
    groups = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups[row[0]].append(row)
    return groups


@pytest.mark.parametrize("gap", [60, 300, 3600])
def test_first_of_island_equals_loop(spark, gap):
    rows = skewed_rows(4000, gap, 200_000)
    expected = set()
    for group in by_key(rows).values():
        before = None
        for row in group:
            if before is None or row[1] - before >= gap:
                expected.add(row)
            before = row[1]
    df = spark.createDataFrame(rows, "k string, t long, id long")
    assert {tuple(r) for r in first_of_island(df, ["k"], "t", gap, ["id"]).collect()} == expected


def test_island_edges(spark):
    times = [0, 3599, 7199, 10799, 14398]
    df = spark.createDataFrame([("a", t, t) for t in times] + [(None, 5, 1), (None, 6, 2)], "k string, t long, id long")
    got = first_of_island(df, ["k"], "t", 3600, ["id"])
    # 3600 apart opens a run, 3599 does not; a NULL key is a key of its own.
    assert sorted((r.k or "", r.t) for r in got.collect()) == [("", 5), ("a", 0), ("a", 7199), ("a", 10799)]


def test_previous_row_equals_loop(spark):
    rows = skewed_rows(4000, 5, 40_000)
    expected = {}
    for group in by_key(rows).values():
        for before, row in zip([None, *group], group):
            expected[row[2]] = before[2] if before else None
    df = spark.createDataFrame(rows, "k string, t long, id long")
    got = previous_row(df, ["k"], "t", ["id"], ["id"])
    assert {r.id: r.prev_id for r in got.collect()} == expected
    # Used beside itself the plan must still answer the same.
    total = got.agg(F.sum("prev_id").alias("a")).withColumn("b", got.agg(F.sum("prev_id")).scalar()).first()
    assert total.a == total.b == sum(v for v in expected.values() if v is not None)


def test_percentiles_equal_numpy(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "b", None]), round(rng.lognormvariate(0, 2), 3)) for _ in range(5000)] + [("one", 4.0), ("void", None)]
    points = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0, "p0": 0.0}
    got = {r.g: r for r in exact_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", points).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g in got:
        values = [v for k, v in rows if k == g and v is not None]
        for name, p in points.items():
            assert got[g][name] == pytest.approx(np.percentile(values, p * 100), rel=1e-12)


def test_weighted_percentiles_repeat_rows(spark):
    rows = [(i % 17, i % 5 + 1) for i in range(300)]
    values = [v for v, n in rows for _ in range(n)]
    df = spark.createDataFrame(rows, "v int, n int")
    row = exact_percentiles(df, [], "v", {"p5": 0.05, "p50": 0.5, "p95": 0.95}, "n").first()
    assert [row.p5, row.p50, row.p95] == pytest.approx(list(np.percentile(values, [5, 50, 95])))
    assert exact_percentiles(df.where("v < 0"), [], "v", {"p50": 0.5}).count() == 0


def test_first_n_by_takes_the_smallest(spark):
    ids = [f"d{random.Random(i).randrange(10**6):07d}" for i in range(3000)]
    df = spark.createDataFrame([(i,) for i in set(ids)], "id string")
    n = spark.range(777).agg(F.count(F.lit(1)))
    assert sorted(r.id for r in first_n_by(df, "id", n).collect()) == sorted(set(ids))[:777]
    assert first_n_by(df, "id", spark.range(10**5).agg(F.count(F.lit(1)))).count() == len(set(ids))
    assert first_n_by(df, "id", spark.range(0).agg(F.count(F.lit(1)))).count() == 0
    assert first_n_by(df.limit(0), "id", n).count() == 0
    assert [r.id for r in first_n_by(df, "id", spark.range(1).agg(F.count(F.lit(1)))).collect()] == [min(ids)]


def test_first_n_by_orders_one_range_only(spark):
    df = spark.createDataFrame([(f"d{i:05d}",) for i in range(2000)], "id string")
    plan = first_n_by(df, "id", spark.range(50).agg(F.count(F.lit(1))))._jdf.queryExecution().optimizedPlan().toString()
    # Outside the subquery that finds the threshold nothing is ordered or joined: the rows are filtered.
    assert "Window" not in plan.split("Subquery")[0].split("scalar-subquery")[0]


def test_hash_sample_does_not_depend_on_partitions(spark):
    df = spark.range(1000)
    first = sorted(r.id for r in hash_sample(df, 50, ["id"], 3).collect())
    assert first == sorted(r.id for r in hash_sample(df.repartition(13), 50, ["id"], 3).collect()) and len(set(first)) == 50
    assert first != sorted(r.id for r in hash_sample(df, 50, ["id"], 4).collect())


def test_null_safe_join_and_beside(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, x int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, y int")
    assert {tuple(r) for r in join_null_safe(left, right, ["k"]).collect()} == {("a", 1, 10), (None, 2, 20)}
    row = beside(spark.range(1).select(F.lit(1).alias("a")), spark.range(1).select(F.lit("x").alias("b"))).first()
    assert (row.a, row.b) == (1, "x")
