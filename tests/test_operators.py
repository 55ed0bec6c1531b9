"""Operator edge cases on small hand-made tables."""

import datetime as dt
import gzip
import hashlib
import math
import random
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sightline.functions.cells import cell, curve_key
from sightline.functions.geodesy import distance_m
from sightline.functions.scalars import uniform
from sightline.operators import (
    affinity, diffusion, events, matching, multiplier, ordering, quality, reach, spatial, storage, studies,
)
from sightline.sources import pings as ping_source

DAY = dt.date(2025, 1, 2)
T0 = 1735776000  # 2025-01-02 00:00 UTC
LAT, LON = 29.95, -90.08


# ---- storage

def test_rows_along_the_curve_are_skipped_by_both_axes(spark, tmp_path):
    import pyarrow.parquet as pq

    side = 360 / 2**17  # a cell of zoom 17
    rows = spark.range(512 * 512).select(
        F.lit(DAY).alias("core_date"), (10 + (F.col("id") % 512) * side + side / 2).alias("lat"),
        (20 + F.floor(F.col("id") / 512) * side + side / 2).alias("lon"),
    ).withColumn("c17", cell(F.col("lat"), F.col("lon"), 17))
    band = lambda s, first: (s.min, s.max, first + 100 * side, first + 164 * side)
    conf = {"spark.sql.shuffle.partitions": "256", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    read = {}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for name, sort in (("cells", ["c17"]), ("curve", [curve_key(F.col("c17"))])):
            path = tmp_path / name
            storage.write_partitions(rows, str(path), sort=sort)
            metas = [pq.ParquetFile(f).metadata for f in path.rglob("*.parquet")]
            groups = [m.row_group(i) for m in metas for i in range(m.num_row_groups)]
            assert len(groups) > 200 and sum(g.num_rows for g in groups) == 512 * 512
            read[name] = 0
            for g in groups:
                at = {g.column(i).path_in_schema: g.column(i).statistics for i in range(g.num_columns)}
                bands = band(at["lat"], 10), band(at["lon"], 20)
                read[name] += all(low <= upto and high >= begin for low, high, begin, upto in bands)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    # A box of an eighth of each side, 256 files of two columns of cells: an eighth of them by cell, some (256 ** 0.5 / 8 + 2) ** 2 along the curve.
    assert read["curve"] <= 16 < 32 <= read["cells"], read


def test_upsert_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    source = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    once = storage.upsert(target, source, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, storage.upsert(once, source, ["k"]).collect())) == sorted(map(tuple, once.collect()))


def test_upsert_partitions_touches_only_its_days(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(dt.date(2025, 1, d), k, "old") for d in (1, 2, 3) for k in (1, 2)]
    storage.write_partitions(spark.createDataFrame(rows, "core_date date, k int, v string"), path, sort=["k"])
    untouched = {p.name for p in (tmp_path / "t" / "core_date=2025-01-01").iterdir()}
    new = spark.createDataFrame([(dt.date(2025, 1, 2), 2, "new"), (dt.date(2025, 1, 4), 1, "new")], "core_date date, k int, v string")
    for _ in range(2):
        storage.upsert_partitions(spark, path, new, ["core_date", "k"], sort=["k"])
        got = sorted((str(r.core_date), r.k, r.v) for r in spark.read.parquet(path).collect())
        assert got == [
            ("2025-01-01", 1, "old"), ("2025-01-01", 2, "old"), ("2025-01-02", 1, "old"), ("2025-01-02", 2, "new"),
            ("2025-01-03", 1, "old"), ("2025-01-03", 2, "old"), ("2025-01-04", 1, "new"),
        ]
    assert untouched == {p.name for p in (tmp_path / "t" / "core_date=2025-01-01").iterdir()}


def test_upsert_opens_only_the_days_of_its_source(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(dt.date(2025, 1, d), 1, "old") for d in range(1, 8)]
    storage.write_partitions(spark.createDataFrame(rows, "core_date date, k int, v string"), path)
    source = spark.createDataFrame([(3, 1)], "d int, k int").select(F.make_date(F.lit(2025), F.lit(1), "d").alias("core_date"), "k")
    read = storage.days_of(spark.read.parquet(path), source)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2025-01-03" in plan and read.count() == 1
    assert len(read.inputFiles()) >= 1


def test_upsert_that_fails_leaves_the_old_day(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(DAY, 1, "old")], "core_date date, k int, v string")
    storage.write_partitions(old, path)

    def broken(*args, **kwargs):
        raise OSError("no space")

    monkeypatch.setattr(storage, "write_partitions", broken)
    with pytest.raises(OSError):
        storage.upsert_partitions(spark, path, old.withColumn("v", F.lit("new")), ["core_date", "k"])
    assert [r.v for r in spark.read.parquet(path).collect()] == ["old"]


def test_scratch_tables_go_after_their_block(spark):
    with storage.scratch(spark):
        table = storage.save_table(spark.range(3).toDF("a"), storage.new_path(spark, "t"))
        files = table.inputFiles()
        assert table.count() == 3 and files
    assert not Path(files[0].removeprefix("file://")).exists()


def test_broadcast_limit_counts_bytes(spark):
    narrow = spark.range(200_000)
    assert storage.fits(narrow) and not storage.fits(narrow.withColumn("a", F.array(F.lit(1))))


def test_large_hash_sample_is_the_first_by_hash(spark):
    df = spark.range(30_000).select(F.col("id").cast("string").alias("k"))
    large = {r.k for r in ordering.hash_sample(df, 5000, ["k"]).collect()}
    hashed = sorted((hashlib.md5(f"{i}:0".encode()).hexdigest(), str(i)) for i in range(30_000))
    assert large == {k for _, k in hashed[:5000]}
    assert ordering.hash_sample(df.limit(10), 5000, ["k"]).count() == 10


def test_radius_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(LAT, LON), (LAT + 1, LON), (LAT, LON + 1)], "lat double, lon double").write.parquet(path)
    near = spatial.within_radius(spark.read.parquet(path), "lat", "lon", LAT, LON, 100)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = near._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):]
    assert near.count() == 1 and "GreaterThanOrEqual(lon,-90.08" in pushed and "GreaterThanOrEqual(lat,29.94" in pushed
    # Over the 180th meridian and around a pole only one band is left.
    edge = spark.createDataFrame([(10.0, 179.9999), (10.0, -179.9999), (89.9999, 90.0), (89.9999, -90.0)], "lat double, lon double")
    assert spatial.within_radius(edge, "lat", "lon", 10.0, 180.0, 100).count() == 2
    assert spatial.within_radius(edge, "lat", "lon", 90.0, 0.0, 100).count() == 2


def test_dwell_joins_points_before_devices_are_shuffled(spark, tmp_path):
    path = str(tmp_path / "p")
    ping_table(spark, [("a", T0 + i, LAT, LON) for i in range(6)]).write.parquet(path)
    pois = spark.createDataFrame([(1, "x", LAT, LON)], "poi_id long, poi_name string, poi_lat double, poi_lon double")
    devices = spark.createDataFrame([("a",)], "device_hash string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = studies.poi_dwell(spark.read.parquet(path), devices, pois)
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got.count() == 1 and plan.index("LeftSemi") < plan.index("BroadcastHashJoin")


# ---- ingest

def raw_line(i, ts=T0):
    return "\t".join(map(str, ["dev%d" % i, ts + i, LAT, LON, 1, 5, "10.0.0.1", "ua", 3, "mk", "ios", "17", "c", "USA", "m-1"]))


def test_ingest_round_trip_and_modes(spark, tmp_path):
    folder = tmp_path / "m-1/2025/01/02"
    folder.mkdir(parents=True)
    for part in range(3):
        with gzip.open(folder / f"part-{part:05d}.gz", "wt") as f:
            f.write("\n".join(raw_line(part * 10 + i) for i in range(10)) + "\n")
    out = str(tmp_path / "out")
    paths = ping_source.backfill_paths(str(tmp_path), ["m-1"], DAY, DAY)
    ping_source.ingest_pings(spark, paths, out)
    table = spark.read.parquet(out)
    assert table.count() == 30 and set(table.columns) == set(ping_source.INGESTED_COLUMNS)
    assert table.select("core_date").distinct().collect()[0][0] == DAY
    ping_source.ingest_pings(spark, paths, out)
    assert spark.read.parquet(out).count() == 30
    ping_source.ingest_pings(spark, paths, out, mode="append")
    assert spark.read.parquet(out).count() == 60
    with pytest.raises(AnalysisException):
        ping_source.ingest_pings(spark, ping_source.backfill_paths(str(tmp_path), ["none"], DAY, DAY), out)


def test_ingested_column_order(spark):
    raw = spark.createDataFrame([], ping_source.RAW_SCHEMA)
    assert ping_source.index_pings(raw).columns == ping_source.INGESTED_COLUMNS and len(ping_source.INGESTED_COLUMNS) == 23


def test_backfill_paths_follow_the_calendar():
    days = ping_source.backfill_paths("s", ["a", "b"], dt.date(2024, 2, 28), dt.date(2024, 3, 1))
    assert days == [f"s/{m}/2024/{d}/part-*.gz" for d in ("02/28", "02/29", "03/01") for m in "ab"]
    parts = ping_source.backfill_paths("s", ["a"], DAY, DAY, 50)
    assert len(parts) == 50 and parts[-1] == "s/a/2025/01/02/part-00049.gz"


# ---- multiplier

def multiplier_inputs(spark):
    pings = spark.createDataFrame(
        [("a", T0, 1, 10, 100), ("a", T0 + 5, 1, 10, 100), ("b", T0 + 9, 1, 10, 100), ("c", T0 + 3600, 1, 20, 200), ("d", T0, 9, 30, 300)],
        "device_hash string, unix_ts long, dma_code long, c11 long, c14 long",
    ).withColumn("core_date", F.to_date(F.timestamp_seconds("unix_ts")))
    pop = spark.createDataFrame([(100, 8), (10, 1), (200, 1)], "cell long, pop long")
    dma = spark.createDataFrame([(1, "m1"), (1, "m2")], "dma_code long, markethash string")
    info = spark.createDataFrame([("m1", 7, '{"marketpop": 9}'), ("m2", 8, '{"marketpop": 0}')], "markethash string, marketid long, marketmetrics string")
    return pings, pop, dma, info


def test_base_multiplier_counts_devices_once(spark):
    pings, pop, dma, info = multiplier_inputs(spark)
    base = multiplier.base_multiplier(pings, pop, dma, info, DAY, DAY)
    got = {(r.resolution, r.cell, r.bin_start): float(r.multiplier) for r in base.collect()}
    # Two devices for 8 people; no population and too small a ratio give 1; the unmapped dma has no market row.
    assert got == {
        (7, 100, T0): 4.0, (7, 200, T0 + 3600): 1.0, (7, 300, T0): 1.0, (5, 10, T0): 1.0, (5, 20, T0): 1.0, (5, 30, T0): 1.0,
        (100, 7, T0): 3.0, (100, 8, T0): 1.0,
    }


def test_rollup_caps_and_averages(spark):
    fine = (14 << 52) | (8 << 26) | 8
    coarse = (11 << 52) | (1 << 26) | 1
    first_child = (17 << 52) | (64 << 26) | 64
    base = spark.createDataFrame(
        [(DAY, 7, fine, T0, 2.0), (DAY, 7, fine, T0 + 3600, 5000.0), (DAY, 5, coarse, T0, 4.0), (DAY, 100, 3, T0, 6.0)],
        "core_date date, resolution int, cell long, bin_start long, multiplier double",
    )
    got = multiplier.rollup_multiplier(base, spark.createDataFrame([(first_child, 3)], "cell long, market_id long"), DAY, DAY)
    assert {r.bin_start: (float(r.multiplier), r.bin_end, r.time_bin_1h) for r in got.collect()} == {
        T0: (4.0, T0 + 3599, T0 // 3600), T0 + 3600: (1000.0, T0 + 7199, T0 // 3600 + 1),
    }


def test_weighted_totals_equal_row_by_row(spark):
    rows = [(DAY, T0 // 3600, i % 3, i % 2, 0.25 * (i % 4)) for i in range(60)]
    exposures = spark.createDataFrame(rows, "core_date date, time_bin_1h long, c14 long, market_id int, decayed_value double")
    mult = spark.createDataFrame([(DAY, T0 // 3600, 1, 3.0)], "core_date date, time_bin_1h long, c14 long, multiplier double")
    slow = multiplier.apply_multiplier(exposures, mult).groupBy("market_id").agg(F.sum("mp_value").alias("v"))
    fast = multiplier.weighted_totals(exposures, mult, ["market_id"]).groupBy("market_id").agg(F.sum("mp_value").alias("v"))
    assert dict(map(tuple, slow.collect())) == pytest.approx(dict(map(tuple, fast.collect())))


# ---- matching

def frame_tables(spark, **changes):
    frame = {
        "frame_id": 1, "site_id": 1, "owner_id": 1, "market_id": 1, "process_id": 1, "frame_type": "STATIC", "exposition_angle": 0.0,
        "exposition_width": 60.0, "frame_width": 3.0, "frame_height": 2.0, "frame_elevation": 5.0, "site_lat": LAT, "site_lon": LON,
    }
    other = {**frame, "frame_id": 2, "owner_id": 2, "frame_type": "DIGITAL", "exposition_angle": 180.0, **changes}
    schema = (
        "frame_id long, site_id long, owner_id long, market_id long, process_id long, frame_type string, exposition_angle double, "
        "exposition_width double, frame_width double, frame_height double, frame_elevation double, site_lat double, site_lon double"
    )
    names = [f.split()[0] for f in schema.split(", ")]
    frames = spark.createDataFrame([tuple(f[n] for n in names) for f in (frame, other)], schema)
    meta = spark.createDataFrame([(1, "METER", 8.0)], "process_id long, dimension_unit string, min_noticing_radial double")
    return frames, meta, frames.select("site_id", "site_lat", "site_lon").distinct()


def ping_table(spark, rows):
    df = spark.createDataFrame(rows, "device_hash string, unix_ts long, lat double, lon double")
    return df.withColumns({
        "core_date": F.to_date(F.timestamp_seconds("unix_ts")), "device_ip": F.lit("ip"), "device_os": F.lit("os"),
        "c14": cell(F.col("lat"), F.col("lon"), 14), "c17": cell(F.col("lat"), F.col("lon"), 17),
    })


def test_match_keeps_the_facing_half_and_the_radius(spark):
    frames, meta, sites = frame_tables(spark)
    north, south, far = LAT + 0.0005, LAT - 0.0005, LAT + 0.002
    pings = ping_table(spark, [("n", T0, north, LON), ("s", T0, south, LON), ("far", T0, far, LON)])
    got = matching.stage1(frames, meta, sites, pings, DAY, DAY)
    assert {(r.device_hash, r.frame_id) for r in got.collect()} == {("n", 1), ("s", 2)}
    assert got.columns == matching.STAGE1_COLUMNS
    assert matching.stage1(frames, meta, sites, pings, DAY, DAY, customer_ids=[1]).count() == 1
    assert matching.stage1(frames, meta, sites, pings, DAY, DAY, frame_ids=[]).count() == 0
    assert matching.stage1(frames, meta, sites, pings, DAY, DAY, market_ids=[5]).count() == 0


@pytest.mark.parametrize("limit", [0, 2])
def test_match_is_the_same_when_nothing_fits_a_broadcast(spark, monkeypatch, limit):
    frames, meta, sites = frame_tables(spark)
    pings = ping_table(spark, [(f"d{i % 7}", T0 + i * 500, LAT + (i % 9 - 4) * 3e-4, LON + (i % 5 - 2) * 3e-4) for i in range(150)])
    columns = ["device_hash", "device_time", "frame_id"]
    broadcast = sorted(map(tuple, matching.stage1(frames, meta, sites, pings, DAY, DAY).select(*columns).collect()))
    monkeypatch.setattr(matching, "fits", lambda df: df.count() <= limit)
    monkeypatch.setattr(matching, "sized", lambda df, rows: df)
    assert broadcast and broadcast == sorted(map(tuple, matching.stage1(frames, meta, sites, pings, DAY, DAY).select(*columns).collect()))


def test_radius_floor_and_missing_process(spark):
    frames, meta, _ = frame_tables(spark, process_id=99, frame_width=30.0)
    got = {r.frame_id: r.match_radius for r in matching.frame_proximity(frames, meta).collect()}
    assert got == {1: 150.0, 2: 150.0}
    frames, meta, _ = frame_tables(spark, frame_width=30.0)
    assert matching.frame_proximity(frames, meta).where("frame_id = 2").first().match_radius > 600


def test_dedupe_static_passes_digital_and_drops_untyped(spark):
    frames, meta, sites = frame_tables(spark, exposition_angle=0.0)
    north = LAT + 0.0005
    pings = ping_table(spark, [("n", T0 + s, north, LON) for s in (0, 3599, 7199, 7200)])
    prox = matching.frame_proximity(frames, meta)
    matches = matching.frame_device_match(prox, matching.site_cells(sites, prox), pings, DAY, DAY)
    got = matching.dedupe_static(matches)
    assert sorted((r.frame_type, r.device_time - T0) for r in got.collect()) == [
        ("DIGITAL", 0), ("DIGITAL", 3599), ("DIGITAL", 7199), ("DIGITAL", 7200), ("STATIC", 0), ("STATIC", 7199),
    ]
    untyped = matches.withColumn("frame_type", F.lit(None).cast("string"))
    assert matching.dedupe_static(untyped).count() == 0
    by_column = matching.dedupe_static(matches.drop("time_bin_1h"))
    assert by_column.count() == got.count()


def test_covers_of_several_zooms_prefilter_each_ping_once(spark):
    sites = spark.createDataFrame([(1, LAT, LON), (2, LAT + 0.001, LON), (3, LAT + 0.02, LON + 0.02)], "site_id long, site_lat double, site_lon double")
    proximity = spark.createDataFrame([(1, 2600.0), (2, 150.0), (3, 700.0), (3, 40.0)], "site_id long, match_radius double")
    covered = matching.site_cells(sites, proximity)
    zooms = matching.cover_zooms(covered)
    assert len(zooms) > 1 and zooms[-1] == matching.SITE_ZOOM
    assert covered.where("site_id = 1").count() < 200
    rnd = random.Random(4)
    pings = ping_table(spark, [(f"d{i}", T0 + i, LAT + rnd.uniform(-0.05, 0.05), LON + rnd.uniform(-0.05, 0.05)) for i in range(3000)])
    got = [r.device_hash for r in matching.device_prefilter(pings, covered, DAY, DAY).collect()]
    assert len(got) == len(set(got))
    near = {
        r.device_hash for r in pings.crossJoin(F.broadcast(sites.join(proximity, "site_id"))).where(
            distance_m(F.col("lat"), F.col("lon"), F.col("site_lat"), F.col("site_lon")) <= F.col("match_radius")
        ).collect()
    }
    assert near <= set(got) and len(got) < 3 * len(near)
    assert matching.device_prefilter(pings, covered.limit(0), DAY, DAY).count() == 0


@pytest.mark.parametrize("offset, hits", [(-31, 0), (-30, 1), (0, 1), (7200, 1), (7230, 1), (7231, 0)])
def test_adplay_buffer(spark, offset, hits):
    frames, meta, sites = frame_tables(spark)
    south, start = LAT - 0.0005, T0 + 3600
    pings = ping_table(spark, [("s", start + offset, south, LON)])
    plays = spark.createDataFrame([(1, 2, 5, start, start + 7200, DAY, DAY)], "site_id long, frame_id long, creative_id long, start_epoch long, end_epoch long, start_date date, end_date date")
    rows = matching.adplay_interval_join(matching.stage1(frames, meta, sites, pings, DAY, DAY), plays, DAY, DAY)
    row = rows.first()
    assert rows.count() == 1 and (row.creative_id == 5) == bool(hits)


def test_adplay_must_span_the_period_unless_told(spark):
    frames, meta, sites = frame_tables(spark)
    pings = ping_table(spark, [("s", T0 + 60, LAT - 0.0005, LON)])
    plays = spark.createDataFrame([(1, 2, 5, T0, T0 + 7200, DAY, DAY)], "site_id long, frame_id long, creative_id long, start_epoch long, end_epoch long, start_date date, end_date date")
    seen, after = matching.stage1(frames, meta, sites, pings, DAY, DAY), DAY + dt.timedelta(days=1)
    assert matching.adplay_interval_join(seen, plays, DAY, after).first().creative_id is None
    assert matching.adplay_interval_join(seen, plays, DAY, after, spanning=False).first().creative_id == 5


def test_adplay_of_sightings_whose_day_is_not_that_of_their_time(spark):
    frames, meta, sites = frame_tables(spark)
    pings = ping_table(spark, [("early", T0 - 3 * 86400, LAT - 0.0005, LON), ("late", T0 + 9 * 86400, LAT - 0.0005, LON)])
    pings = pings.withColumn("core_date", F.lit(DAY))
    plays = spark.createDataFrame(
        [(1, 2, 7, T0 - 30 * 86400, T0 + 30 * 86400, DAY, DAY)],
        "site_id long, frame_id long, creative_id long, start_epoch long, end_epoch long, start_date date, end_date date",
    )
    seen = matching.stage1(frames, meta, sites, pings, DAY, DAY)
    for spanning in (True, False):
        got = matching.adplay_interval_join(seen, plays, DAY, DAY, spanning=spanning).collect()
        assert {(r.device_hash, r.creative_id) for r in got} == {("early", 7), ("late", 7)}
    assert matching.adplay_interval_join(seen.limit(0), plays, DAY, DAY, spanning=False).count() == 0


def test_angle_zero_and_unknown_unit_fall_to_the_least_radius(spark):
    frames, _, _ = frame_tables(spark, process_id=2, frame_width=30.0)
    meta = spark.createDataFrame([(1, "METER", 0.0), (2, "YARD", 8.0)], "process_id long, dimension_unit string, min_noticing_radial double")
    assert {r.frame_id: r.match_radius for r in matching.frame_proximity(frames, meta).collect()} == {1: 150.0, 2: 150.0}


def test_a_hot_device_hour_is_split(spark):
    """One device and no device hold most pings of an hour: rebalanced pairs leave no task with most of them."""
    frames, meta, sites = frame_tables(spark)
    pings = ping_table(spark, [
        (None if i % 2 else "zero", T0 + i % 3000, LAT + (i % 9 - 4) * 1e-4, LON + (i % 5 - 2) * 1e-4) for i in range(30_000)
    ])
    prox = matching.frame_proximity(frames, meta)
    settings = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.1",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        matches = matching.frame_device_match(prox, matching.site_cells(sites, prox), pings.repartition(8), DAY, DAY)
        sizes = [r[0] for r in matches.groupBy(F.spark_partition_id().alias("p")).count().select("count").collect()]
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert sum(sizes) > 10_000 and max(sizes) < 0.4 * sum(sizes)


def test_bands_and_decay(spark):
    df = spark.createDataFrame([(d,) for d in (0.0, 29.9, 30.0, 56.24, 56.25, 74.9, 75.0, 112.5, 150.0)], "d double")
    r = F.lit(150.0)
    got = df.select(
        matching.viewability(F.col("d"), r).alias("band"),
        matching.decay(F.col("d"), r / 2, r, F.lit(10.0), F.lit(350.0), F.lit(60.0)).alias("w"),
        matching.decay(F.lit(0.0), r / 2, r, F.lit(60.0), F.lit(0.0), F.lit(60.0)).alias("side"),
        matching.decay(F.lit(0.0), r / 2, r, F.lit(170.0), F.lit(0.0), F.lit(180.0)).alias("wide"),
    ).collect()
    assert [x.band for x in got] == ["LIKELY_TO_SEE"] * 2 + ["OPPORTUNITY_TO_SEE"] * 2 + ["CHANCE_TO_SEE"] * 2 + ["DECAYED"] * 3
    assert [round(x.w, 6) for x in got] == [1, 1, 1, 1, 1, 1, 1, 0.5, 0] and got[0].side == 0.5 and got[0].wide == 1.0


def test_stage_tables_round_trip(spark, tmp_path):
    frames, meta, sites = frame_tables(spark)
    pings = ping_table(spark, [("n", T0, LAT + 0.0005, LON), ("s", T0, LAT - 0.0005, LON)])
    first, second = str(tmp_path / "s1"), str(tmp_path / "s2")
    rows = matching.stage1(frames, meta, sites, pings, DAY, DAY)
    for expected in (2, 4):
        matching.write_stage1(rows, first)
        assert spark.read.parquet(first).count() == expected
    plays = spark.createDataFrame([], "site_id long, frame_id long, creative_id long, start_epoch long, end_epoch long, start_date date, end_date date")
    out = matching.stage2(spark.read.parquet(first), plays, DAY, DAY)
    assert out.columns == matching.STAGE2_COLUMNS and out.count() == 3  # the digital copy merges, the static rows pass
    matching.write_stage2(out, second)
    assert spark.read.parquet(second).count() == 3


def test_pings_to_reports(spark):
    """The stages chain: matching and multiplier output feed the reports as they are."""
    frames, meta, sites = frame_tables(spark)
    rows = [(f"d{i}", T0 + i * 600, LAT + (0.0004 if i % 2 else -0.0004), LON) for i in range(12)]
    pings = ping_table(spark, rows).withColumns({"c11": cell(F.col("lat"), F.col("lon"), 11), "dma_code": F.lit(1).cast("long")})
    _, _, dma, info = multiplier_inputs(spark)
    pop = pings.select(F.col("c14").alias("cell"), F.lit(120).cast("long").alias("pop")).distinct()
    base = multiplier.base_multiplier(pings, pop, dma, info, DAY, DAY)
    mult = multiplier.rollup_multiplier(base, spark.createDataFrame([], "cell long, market_id long"), DAY, DAY).withColumnRenamed("cell", "c14")
    plays = spark.createDataFrame([(1, 2, 5, T0, T0 + 7200, DAY, DAY)], "site_id long, frame_id long, creative_id long, start_epoch long, end_epoch long, start_date date, end_date date")
    exposures = matching.stage2(matching.stage1(frames, meta, sites, pings, DAY, DAY), plays, DAY, DAY)
    assert exposures.count() == 12
    report = events.event_weighted_hourly(exposures, frames, mult, DAY, LAT, LON)
    # Six devices an hour over two hours; 120 people / 6 devices = 20, averaged with the coarse level's 1.
    assert report.agg(F.sum("freq_gross")).first()[0] == 12.0
    assert {round(r.weight_gross / r.freq_gross, 6) for r in report.collect()} == {10.5}
    likes = spark.createDataFrame([("d0", "x"), ("d1", "x")], "device_hash string, audience_attribute string")
    assert studies.exposure_affinity_points(exposures, likes).count() == 2
    assert quality.totals_compare(exposures, exposures).where("source = 'ratio'").first().total_matches == 1.0
    assert quality.null_creative_groups(exposures).first().n == 6


# ---- diffusion

def diffusion_tables(spark, copies=400):
    rows = [("d", T0, LAT, LON)] * copies + [(f"d{i}", T0 + i, LAT + (i % 5) * 4e-4, LON + (i % 7) * 4e-4) for i in range(200)]
    return ping_table(spark, rows).withColumn("market_id", F.lit(1).cast("long"))


def test_diffusion_keeps_rows_and_moves_to_neighbours(spark):
    pings = diffusion_tables(spark)
    weights = diffusion.baseline_weights(pings, DAY, DAY)
    cdf = diffusion.neighbour_cdf(diffusion.neighbour_pairs(weights), diffusion.cell_probability(weights))
    ends = diffusion.cdf_max(cdf).agg(F.min("max_cdf"), F.max("max_cdf")).first()
    assert list(ends) == pytest.approx([1.0, 1.0])
    staged = diffusion.stage_region(pings)
    steps = diffusion.diffuse_steps(staged, cdf, 7, cut_every=3)
    for step in steps:
        assert step.agg(F.sum("copies")).first()[0] == 600
    first = steps[0].join(cdf, (steps[0].src == cdf.src) & (steps[0].cur == cdf.nbr), "left_anti")
    assert first.count() == 0
    moved = diffusion.parity_writeback(staged, diffusion.jitter_to_child(steps[-1]))
    assert moved.count() == 600 and moved.columns == pings.columns
    assert moved.where("device_hash = 'd'").select("lat", "lon").distinct().count() == 1
    snapshots = diffusion.density_snapshots(steps)
    assert {r.iter: r.n for r in snapshots.groupBy("iter").agg(F.sum("ping_count").alias("n")).collect()} == {i: 600 for i in range(1, 8)}


def test_guided_hop_is_the_first_neighbour_that_reaches_the_draw(spark):
    steps = {1: [0.03125, 0.0312500001, 0.5, 0.5, 0.9999], 2: [1.0], 3: [1e-9, 0.2, 0.2000001, 0.96875, 1.0], 4: [0.4, 0.6]}
    cdf = spark.createDataFrame([(1, 1, s, 10 * s + i, c) for s, cs in steps.items() for i, c in enumerate(cs)],
                                "market_id long, c14 long, src long, nbr long, cdf double")
    hops = diffusion.hop_table(cdf)
    assert all(len(r.guide) == diffusion.GUIDE + 1 for r in hops.collect())
    rows = spark.range(500).selectExpr("id as row_id", "1L as market_id", "1L as c14", "id % 6 as src", "id % 6 as cur")
    drawn = rows.withColumn("r", uniform(F.col("row_id"), 4, 7))
    draws = {x.row_id: x.r for x in drawn.collect()}
    for x in diffusion.diffuse_hop(rows, hops, 4, 7).collect():
        cs = steps.get(x.src)
        reach = [i for i, c in enumerate(cs or []) if c >= draws[x.row_id]]
        assert x.cur == (10 * x.src + (reach or [len(cs) - 1])[0] if cs else x.src)


def test_diffusion_without_baseline_stays(spark):
    pings = diffusion_tables(spark, 3)
    weights = diffusion.baseline_weights(pings, DAY, DAY).where("c20 < 0")
    cdf = diffusion.neighbour_cdf(diffusion.neighbour_pairs(weights), diffusion.cell_probability(weights))
    last = diffusion.diffuse(diffusion.stage_region(pings), cdf, 2)
    assert last.where("cur <> src").count() == 0


def test_stage_region_filters(spark):
    pings = diffusion_tables(spark, 3).withColumns({"dma_code": F.lit(803), "provider": F.lit("a"), "ingestion_time": F.lit("2025-01-05 10:00:00").cast("timestamp")})
    c14 = pings.first().c14
    keep = dict(day=DAY, dma_code=803, provider="a", ingest_date=dt.date(2025, 1, 5))
    some = diffusion.stage_region(pings, cells=[c14], **keep).count()
    assert some == diffusion.stage_region(pings, cells=pings.where(F.col("c14") == c14), **keep).count() > 0
    for change in (dict(day=dt.date(2025, 1, 9)), dict(dma_code=1), dict(provider="b"), dict(ingest_date=DAY)):
        assert diffusion.stage_region(pings, **{**keep, **change}).count() == 0


# ---- reports and studies

def exposure_rows(spark, rows):
    schema = "device_hash string, asset_id long, device_time long, market_id long, owner_id long, mp_value double, c17 long, lat double, lon double, match_distance_meter double"
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("core_date", F.to_date(F.timestamp_seconds("device_time")))


def test_transition_gaps_skip_equal_assets(spark):
    rows = [("a", a, T0 + t, 1, 1, 1.0, 1, 0.0, 0.0, 1.0) for a, t in ((1, 0), (1, 10), (2, 40), (3, 7240), (3, 7300))]
    row = reach.transition_gaps(exposure_rows(spark, rows), 2).first()
    assert (row.transitions, row.devices, row.avg_seconds, row.median_seconds) == (2, 1, 3615.0, 3615.0)
    assert row.min_minutes == 0.5 and row.max_hours == 2.0
    assert reach.transition_gaps(exposure_rows(spark, rows), 4).first().transitions is None


def test_cell_density_counts(spark):
    rows = [(f"d{i % 3}", i % 2, T0 + i * 3600, 1, 1, 0.5, 9, LAT, LON, 10.0) for i in range(24)]
    row = reach.cell_density(exposure_rows(spark, rows)).first()
    assert (row.exposure_count, row.unique_devices, row.unique_assets, row.days_active) == (24, 3, 2, 1)
    assert (row.morning_devices, row.afternoon_devices, row.evening_devices) == (3, 3, 3)
    assert row.total_impressions == 12.0 and row.avg_distance_m == 10.0
    assert reach.cell_density(exposure_rows(spark, rows), min_rows=25).count() == 0
    assert reach.cell_density(exposure_rows(spark, rows), market_id=2).count() == 0


def test_daypart_share(spark):
    rows = [("a", 1, T0 + h * 3600, 1, 1, 1.0, 9, 0.0, 0.0, 1.0) for h in range(24)]
    row = reach.daypart_share(exposure_rows(spark, rows), tz="UTC").first()
    assert (row.morning_pct, row.afternoon_pct, row.evening_pct) == (45.83, 29.17, 25.0)


def test_affinity_index_labels(spark):
    rows = [(f"d{i}", 1, T0, 1, 1, 1.0, 9, 0.0, 0.0, 1.0) for i in range(100)]
    likes = [(f"d{i}", name) for name, n in (("strong", 19), ("over", 16), ("even", 13), ("under", 11)) for i in range(n)]
    affinities = spark.createDataFrame(likes, "device_hash string, audience_attribute string")
    got = {r.affinity: r.interpretation for r in affinity.affinity_index(exposure_rows(spark, rows), affinities).collect()}
    assert got == {"strong": affinity.STRONG_OVER, "over": affinity.OVER, "even": affinity.PARITY, "under": affinity.UNDER}


def test_marginal_reach_ignores_null_devices(spark):
    base = spark.createDataFrame([("a", 1.0), (None, 1.0)], "device_hash string, decayed_value double")
    added = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", 0.5)], "device_hash string, decayed_value double")
    extra = {"market_id": F.lit(1), "owner_id": F.lit(1), "core_date": F.lit(DAY), "time_bin_1h": F.lit(1).cast("long"), "c14": F.lit(1).cast("long")}
    mult = spark.createDataFrame([], "core_date date, time_bin_1h long, c14 long, multiplier double")
    row = reach.marginal_reach(base.withColumns(extra), added.withColumns(extra), mult).first()
    assert (row.base_devices, row.marginal_devices, row.marginal_weighted_reach, row.device_lift_pct) == (1, 2, 1.0, 200.0)


def test_owner_and_market_scope(spark):
    rows = [("a", 1, T0, m, o, 1.0, 9, 0.0, 0.0, 1.0) for m in (1, 88) for o in (1, 2)]
    exposures = exposure_rows(spark, rows).withColumns({
        "viewability": F.lit("OPPORTUNITY_TO_SEE"), "decayed_value": F.lit(0.5), "time_bin_1h": F.lit(1).cast("long"), "c14": F.lit(1).cast("long"),
    })
    paths = spark.createDataFrame([(1, 1, 1, DAY, 1609.344, 0, 3600)], "asset_id long, market_id long, owner_id long, core_date date, path_length double, start_time long, end_time long")
    mult = spark.createDataFrame([], "core_date date, time_bin_1h long, c14 long, multiplier double")
    row = reach.impressions_total(exposures, mult, paths, owner_id=1, start=DAY, end=DAY, exclude_markets=[88], n_assets=2).first()
    assert (row.impressions_gross, row.matched_exposures, row.markets, round(row.miles_per_asset, 3)) == (0.5, 1, 1, 0.5)


def test_reach_sketches_are_within_their_error_and_replace_a_day(spark, tmp_path):
    rnd, path = random.Random(6), str(tmp_path / "sketches")
    seen = [(DAY + dt.timedelta(days=rnd.randrange(4)), rnd.choice([1, 1, 1, 2, None]), f"d{rnd.randrange(20_000)}") for _ in range(40_000)]
    seen += [(DAY, 1, None)] * 3
    rows = spark.createDataFrame(seen, "core_date date, market_id int, device_hash string").repartition(6)
    reach.write_reach_sketches(reach.daily_reach_sketches(rows), path)
    stored = spark.read.parquet(path)
    error = 5 * 1.04 / 2 ** (reach.SKETCH_LG_K / 2)

    def check(got, rows):
        expected = len({d for *_, d in rows} - {None})
        assert abs(got.devices - expected) <= error * expected and got.exposures == len(rows)

    check(reach.reach_from_sketches(stored).first(), seen)
    for r in reach.reach_from_sketches(stored, ["market_id"], DAY, DAY + dt.timedelta(days=1)).collect():
        check(r, [x for x in seen if x[1] == r.market_id and x[0] <= DAY + dt.timedelta(days=1)])
    # A day loaded again replaces its own sketches and no other's.
    again = [(DAY, 1, f"new{i}") for i in range(100)]
    reach.write_reach_sketches(reach.daily_reach_sketches(spark.createDataFrame(again, rows.schema)), path)
    check(reach.reach_from_sketches(spark.read.parquet(path)).first(), again + [x for x in seen if x[0] != DAY])
    # A second medium of which half is new.
    first = reach.daily_reach_sketches(spark.createDataFrame([(DAY, 1, f"d{i}") for i in range(4000)], rows.schema))
    second = reach.daily_reach_sketches(spark.createDataFrame([(DAY, 2, f"d{i}") for i in range(2000, 6000)], rows.schema))
    row = reach.marginal_reach_from_sketches(first, second).first()
    assert abs(row.base_devices - 4000) < 4000 * error and abs(row.combined_devices - 6000) < 6000 * error
    assert row.marginal_devices == row.combined_devices - row.base_devices
    assert tuple(reach.marginal_reach_from_sketches(first.limit(0), second.limit(0)).first()) == (0, 0, 0)


def test_control_group_size_and_membership(spark):
    pings = ping_table(spark, [(f"u{i:02d}", T0 + i, LAT, LON) for i in range(20)] + [("elsewhere", T0, LAT + 1, LON)])
    exposed = pings.where("device_hash in ('u03', 'u04', 'u05')").select("device_hash", "c17")
    got = studies.control_group(pings, exposed)
    assert {r.device_hash for r in got.collect()} == {"u00", "u01", "u02"}
    rate = studies.conversion_rate(got, spark.createDataFrame([("u00",), ("u00",), ("zz",)], "device_hash string"), 1).first()
    assert (rate.total_devices, rate.converted_devices, round(rate.conversion_rate, 4)) == (3.0, 1, 33.3333)


def test_filter_inventory_none_means_all(spark):
    rows = [(1, 14, "Q1", 195, 99208, "billboards", "posters"), (2, 14, "Q1", 1, 2, "billboards", "bulletins"), (3, 9, "Q2", 195, 99208, "transit", "bus")]
    inv = spark.createDataFrame(rows, "inventory_id int, owner_id int, date_range string, market_id int, postcode int, inventory_type string, inventory_subtype string")
    ids = lambda **k: sorted(r.inventory_id for r in studies.filter_inventory(inv, **k).collect())
    assert ids() == [1, 2, 3] and ids(owner_id=14) == [1, 2] and ids(market_ids=[195], postcodes=[99208]) == [1, 3]
    assert ids(inventory_filters=["billboards.posters", "transit.bus"]) == [1, 3] and ids(inventory_filters=[]) == []


def test_lookup_rows_by_list_and_table(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    assert studies.lookup_rows(df, "id", [1, 3, 9]).count() == 2
    assert studies.lookup_rows(df, "id", spark.createDataFrame([(2,), (2,)], "x int")).count() == 1
    assert studies.formatted_count(spark.range(12345)).first().n == "12,345"


# ---- quality

def test_frame_ratio_pairs_every_day(spark):
    a = spark.createDataFrame([("x", 1, dt.date(2025, 1, d)) for d in (1, 1, 2)] + [("y", 1, dt.date(2025, 1, 1))], "device_hash string, frame_id int, core_date date")
    b = spark.createDataFrame([("x", 1, DAY), ("z", 1, DAY)], "device_hash string, frame_id int, core_date date")
    got = {r.metric: r for r in quality.frame_ratio_percentiles(a, b).collect()}
    assert got["Total Matches"].p50 == 1.0 and got["Unique Devices"].p50 == 0.75 and got["Total Matches"].core_date == DAY


def test_entropy_of_zero_probability_is_zero(spark):
    df = spark.createDataFrame([("d", "c", 0.0, 0.5), ("d", "c", 1.0, 0.5)], "device_hash string, category string, prior_probability double, posterior_probability double")
    row = quality.demographic_summary(df).first()
    assert row.prior_entropy == 0.0 and row.posterior_entropy == 1.0 and row.max_prior_probability == 1.0


def test_enrichment_report_orders_overall_first(spark):
    schema = "device_hash string, category string, max_prior_probability double, max_posterior_probability double, prior_entropy double, posterior_entropy double"
    df = spark.createDataFrame([("a", "x", 0.5, 0.6, 2.0, 1.0), ("b", "y", 0.5, 0.9, 2.0, 1.5)], schema)
    assert [r.category for r in quality.enrichment_report(df).collect()] == ["OVERALL", "y", "x"]
    assert quality.enrichment_report(df, formatted=True).first().probability_change == "25.00%"


def test_histogram_puts_the_top_in_the_last_bucket(spark):
    schema = "device_hash string, category string, max_prior_probability double, max_posterior_probability double, prior_entropy double, posterior_entropy double"
    df = spark.createDataFrame([("a", "x", 1.0, 0.0, 3.0, 9.0)], schema)
    got = {(r.category, r.measure): (r.bucket, r.n) for r in quality.distribution_histogram(df, 50, 3.0).collect()}
    assert got["x", "max_prior_probability"] == (50, 1) and got["OVERALL", "max_posterior_probability"] == (1, 1)
    # Entropies have no largest value: 3 bits are the end of bucket 50, 9 bits lie in bucket 151.
    assert got["x", "prior_entropy"] == (51, 1) and got["x", "posterior_entropy"] == (151, 1)


def test_histogram_of_a_category_with_many_values(spark):
    entropy = math.log2(20)
    summary = spark.createDataFrame(
        [("a", "x", 0.05, 0.05, entropy, entropy), ("b", "x", 0.05, 0.05, 3.2, 3.9)],
        "device_hash string, category string, max_prior_probability double, max_posterior_probability double, prior_entropy double, posterior_entropy double",
    )
    got = {(r.measure, r.bucket): r.n for r in quality.distribution_histogram(summary).where("category = 'x'").collect()}
    assert got["posterior_entropy", 66] == 1 and got["posterior_entropy", int(entropy / 0.06) + 1] == 1


def test_totals_compare_ratio(spark):
    rows = [("d", DAY, 1.0, 1.0), ("d", DAY, 1.0, 1.0), ("e", DAY, 1.0, 1.0), (None, DAY, 1.0, 1.0)]
    a = spark.createDataFrame(rows, "device_hash string, core_date date, lat double, lon double")
    got = {r.source: (r.total_matches, r.distinct_devices) for r in quality.totals_compare(a, a.limit(2)).collect()}
    assert got == {"a": (4.0, 2.0), "b": (2.0, 1.0), "ratio": (2.0, 2.0)}
