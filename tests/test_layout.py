"""Tables stored by device: whole, in like parts, and joined without moving rows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sightline.operators import affinity, layout

ATTRS = [("a", "A"), ("b", "B"), ("c", "C")]
SEEN = (
    "device_hash string, market_id long, c17 long, lon double, lat double, mp_value double, core_date date, device_time long"
)


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(3000):
        lat = rnd.randint(0, 3) / 4.0
        device = rnd.choice(["hot", None, *[f"d{k}" for k in range(80)]] if i % 3 else ["hot"])
        rows.append((device, rnd.choice([1, 2, 3]), rnd.choice([None, 7, 8, 9]), 2 * lat, lat,
                     rnd.choice([None, 0.5, 1.0, 2.0]), None, rnd.randint(0, 86399)))
    seen = spark.createDataFrame(rows, SEEN).withColumn("core_date", F.to_date(F.lit("2024-01-02")))
    likes = {(f"d{k}", rnd.choice("abcd")) for k in range(60) for _ in range(2)} | {("hot", "a"), ("hot", "b"), (None, "a")}
    likes = spark.createDataFrame(sorted(likes, key=str), "device_hash string, audience_attribute string")
    markets = spark.createDataFrame([(1, "one"), (2, "two")], "market_id long, marketname string")
    return seen, likes, markets


def _reports(seen, likes, markets):
    return [
        affinity.affinity_penetration(seen, likes, markets), affinity.affinity_heatmap(seen, likes, min_devices=2),
        affinity.affinity_overlap(seen, likes, ATTRS), affinity.affinity_hourly(seen, likes, tz="UTC"),
        affinity.affinity_index(seen, likes),
    ]


@pytest.mark.parametrize("heavy_rows", [200, 10_000])
def test_reports_on_stored_tables(spark, tables, heavy_rows):
    seen, likes, markets = tables
    stored = layout.store_bucketed(spark, "device_hash", {"t_seen": seen, "t_likes": likes}, 4, heavy_rows)
    heavy = {r.device_hash for r in stored["t_seen"].heavy.select("device_hash").distinct().collect()}
    assert heavy == ({"hot", None} if heavy_rows == 200 else {None})
    assert {r.device_hash for r in stored["t_likes"].heavy.collect()} == heavy
    for name, df in (("t_seen", seen), ("t_likes", likes)):
        assert Counter(map(tuple, stored[name].whole.collect())) == Counter(map(tuple, df.collect()))
    plain = _reports(seen, likes, markets)
    # Stored or not, and where only one side is.
    for other in (_reports(stored["t_seen"], stored["t_likes"], markets), _reports(seen, stored["t_likes"], markets)):
        for a, b in zip(plain, other):
            near = lambda df: Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
            assert near(a) == near(b)


def test_light_rows_are_not_moved_by_device(spark, tables):
    seen, likes, markets = tables
    stored = layout.store_bucketed(spark, "device_hash", {"p_seen": seen, "p_likes": likes}, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for got, plain in zip(_reports(*[stored[n].light for n in ("p_seen", "p_likes")], markets), _reports(seen, likes, markets)):
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Bucketed: true" in plan
            # Up to the join nothing is shuffled by device; a later grouping may have its own keys.
            moved = re.compile(r"Exchange hashpartitioning\(device_hash#\d+, \d+\)")
            assert not moved.search(plan)
            assert moved.search(plain._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_number_of_buckets_and_empty_tables(spark, tables, monkeypatch):
    seen, likes, markets = tables
    monkeypatch.setattr(layout, "BUCKET_ROWS", 500)
    stored = layout.store_bucketed(spark, "device_hash", {"n_seen": seen, "n_likes": likes.limit(0)})
    described = {r.col_name: r.data_type for r in spark.sql("DESCRIBE EXTENDED n_seen_light").collect()}
    assert described["Num Buckets"] == "8"
    assert affinity.affinity_penetration(stored["n_seen"], stored["n_likes"], markets).collect() == []
    again = layout.store_bucketed(spark, "device_hash", {"n_seen": seen.limit(0)})
    assert again["n_seen"].whole.count() == 0
