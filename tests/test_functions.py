"""Grid cells, sphere and time rules against plain Python arithmetic."""

import math
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sightline.functions import cells, geodesy, timebins
from sightline.functions.scalars import div0, info_field, report_round, uniform
from sightline.operators.spatial import distance_ring, spatial_join, within_radius


def py_distance(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * geodesy.EARTH_RADIUS_M * math.asin(math.sqrt(min(1, a)))


def points(n, seed, lat=(-89.9, 89.9), lon=(-180, 179.999)):
    rng = random.Random(seed)
    return [(i, rng.uniform(*lat), rng.uniform(*lon)) for i in range(n)]


def test_cells_nest_exactly(spark):
    df = spark.createDataFrame(points(500, 1), "id long, lat double, lon double")
    fine = cells.cell(F.col("lat"), F.col("lon"), 25)
    for zoom in (24, 20, 17, 14, 11, 1):
        same = cells.cell_parent(fine, zoom) == cells.cell(F.col("lat"), F.col("lon"), zoom)
        assert df.where(~same).count() == 0


def test_children_are_all_distinct_and_lead_back(spark):
    df = spark.createDataFrame(points(50, 2), "id long, lat double, lon double")
    c = cells.cell(F.col("lat"), F.col("lon"), 12)
    kids = df.select(c.alias("c"), F.explode(cells.cell_children(c, 15)).alias("kid"))
    row = kids.agg(
        F.count("*").alias("n"), F.countDistinct("kid").alias("d"), F.countDistinct("c").alias("c"),
        F.sum((cells.cell_parent(F.col("kid"), 12) == F.col("c")).cast("int")).alias("home"),
    ).first()
    assert row.home == row.n == 50 * 64 and row.d == row.c * 64


def test_centroid_lies_in_its_cell(spark):
    df = spark.createDataFrame(points(300, 3), "id long, lat double, lon double")
    c = cells.cell(F.col("lat"), F.col("lon"), 17)
    back = cells.cell(cells.cell_lat(c), cells.cell_lon(c), 17)
    assert df.where(back != c).count() == 0


def test_grid_disk_size_and_wrap(spark):
    df = spark.createDataFrame([(0.0, 179.9999)], "lat double, lon double")
    c = cells.cell(F.col("lat"), F.col("lon"), 10)
    row = df.select(
        F.array_distinct(cells.grid_disk(c, 2, 10)).alias("d"), cells.grid_disk(c, 2, 10, True).alias("e"), c.alias("c"),
        cells.cell(F.col("lat"), F.lit(-179.9999), 10).alias("across"),
    ).first()
    assert len(row.d) == 25 and len(row.e) == 24 and row.c not in row.e and row.across in row.d


@pytest.mark.parametrize("lat, lon", [(29.95, -90.08), (0.0, 179.9995), (0.0, -180.0), (89.9, 10.0), (-89.95, 0.0), (64.1, -21.9)])
def test_cover_holds_every_cell_of_the_circle(spark, lat, lon):
    radius, zoom = 400.0, 14
    rng, ring = random.Random(7), []
    for _ in range(400):
        bearing, d = rng.uniform(0, 2 * math.pi), rng.uniform(0, radius) / geodesy.EARTH_RADIUS_M
        p = math.radians(lat)
        p2 = math.asin(math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(bearing))
        l2 = math.radians(lon) + math.atan2(math.sin(bearing) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(p2))
        ring.append((math.degrees(p2), (math.degrees(l2) + 540) % 360 - 180))
    inside = spark.createDataFrame(ring, "lat double, lon double").select(cells.cell(F.col("lat"), F.col("lon"), zoom).alias("c"))
    covered = spark.createDataFrame([(lat, lon)], "lat double, lon double").select(
        F.explode(cells.cover(F.col("lat"), F.col("lon"), radius, zoom)).alias("c")
    )
    assert inside.join(covered, "c", "left_anti").count() == 0
    assert covered.count() == covered.distinct().count()


def _within(rng, lat, lon, radius):
    """A point at most ``radius`` from another, often on the rim."""
    bearing, d = rng.uniform(0, 2 * math.pi), radius * rng.choice([1, 1, rng.random() ** 0.5]) / geodesy.EARTH_RADIUS_M
    p = math.radians(lat)
    p2 = math.asin(math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(bearing))
    l2 = math.radians(lon) + math.atan2(math.sin(bearing) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(p2))
    return math.degrees(p2), (math.degrees(l2) + 540) % 360 - 180


def test_mixed_cover_holds_the_circle(spark):
    rng, finest, circles, points = random.Random(5), 17, [], []
    fixed = [(0.0, 179.9995), (0.0, -180.0), (89.9, 10.0), (-89.95, 0.0), (64.1, -21.9)]
    for i in range(120):
        lat, lon = fixed[i] if i < len(fixed) else (rng.uniform(-75, 75), rng.uniform(-180, 180))
        radius = 400.0 if i < len(fixed) else 10 ** rng.uniform(0, 5.5)
        circles.append((i, lat, lon, radius))
        points += [(i, *_within(rng, lat, lon, radius)) for _ in range(60)]
    covered = spark.createDataFrame(circles, "i long, lat double, lon double, radius double").select(
        "i", "lat", "radius", F.explode(cells.mixed_cover(F.col("lat"), F.col("lon"), F.col("radius"), finest)).alias("c")
    ).cache()
    zooms = sorted(r.z for r in covered.select(cells.cell_zoom(F.col("c")).cast("int").alias("z")).distinct().collect())
    assert zooms[-1] == finest and len(zooms) > 4
    at = spark.createDataFrame(points, "i long, p double, l double").withColumn("at", cells.cell(F.col("p"), F.col("l"), finest))
    above = at.select("i", "p", "l", F.explode(cells.cell_ancestors(F.col("at"), zooms)).alias("c"))
    held = above.join(covered.select("i", "c"), ["i", "c"]).groupBy("i", "p", "l").count()
    # Every point lies in one cell, and in one only: none is within another.
    assert held.count() == at.distinct().count() and held.agg(F.max("count")).first()[0] == 1
    sizes = covered.where("abs(lat) < 60").groupBy("i", "radius").count().collect()
    assert max(r["count"] for r in sizes) < 250
    wide = [r["count"] for r in sizes if r.radius > 2600]
    plain = spark.range(1).select(F.size(cells.cover(F.lit(30.0), F.lit(-90.0), 2600.0, finest))).first()[0]
    assert wide and max(wide) < plain


def test_mixed_cover_of_small_circles_is_the_cover_without_its_corners(spark):
    row = spark.range(1).select(
        cells.cover(F.lit(30.0), F.lit(-90.0), 700.0, 17).alias("box"),
        cells.mixed_cover(F.lit(30.0), F.lit(-90.0), 305.0, 17).alias("small"), cells.mixed_cover(F.lit(30.0), F.lit(-90.0), 700.0, 17).alias("wide"),
        cells.mixed_cover(F.lit(None).cast("double"), F.lit(-90.0), 700.0, 17).alias("none"),
    ).first()
    assert all(c >> 52 == 17 for c in row.small) and row.none is None
    assert set(c for c in row.wide if c >> 52 == 17) <= set(row.box)


def test_spatial_join_equals_brute_force(spark):
    left = points(400, 11, (-0.01, 0.01), (179.98, 180)) + [(1000 + i, a, -180 + i * 1e-4) for i, a, _ in points(200, 12, (-0.01, 0.01))]
    right = points(60, 13, (-0.01, 0.01), (179.98, 180)) + [(500 + i, a, -179.999) for i, a, _ in points(20, 14, (-0.01, 0.01))]
    expected = {(a[0], b[0]) for a in left for b in right if py_distance(a[1], a[2], b[1], b[2]) <= 250}
    joined = spatial_join(
        spark.createDataFrame(left, "l long, lat double, lon double"),
        spark.createDataFrame(right, "r long, rlat double, rlon double"), 250, right_at=("rlat", "rlon"),
    )
    got = [(r.l, r.r) for r in joined.collect()]
    assert len(got) == len(set(got)) and set(got) == expected and expected


def test_radius_and_ring(spark):
    rows = points(2000, 15, (29.9, 30.0), (-90.13, -90.03))
    df = spark.createDataFrame(rows, "id long, lat double, lon double")
    d = {i: py_distance(29.95, -90.08, a, o) for i, a, o in rows}
    assert {r.id for r in within_radius(df, "lat", "lon", 29.95, -90.08, 2500).collect()} == {i for i in d if d[i] <= 2500}
    ring = {r.id for r in distance_ring(df, "lat", "lon", 29.95, -90.08, 1609.34, 4828.02).collect()}
    assert ring == {i for i in d if 1609.34 <= d[i] < 4828.02}


def test_azimuth_and_angle(spark):
    row = spark.range(1).select(
        *[geodesy.azimuth(F.lit(0.0), F.lit(0.0), F.lit(a), F.lit(o)).alias(n) for n, a, o in
          (("north", 1.0, 0.0), ("east", 0.0, 1.0), ("south", -1.0, 0.0), ("west", 0.0, -1.0))],
        geodesy.angle_diff(F.lit(350.0), F.lit(10.0)).alias("wrap"), geodesy.angle_diff(F.lit(0.0), F.lit(180.0)).alias("opposite"),
    ).first()
    assert [round(x, 6) for x in row] == [0.0, 90.0, 180.0, 270.0, 20.0, 180.0]


def test_valid_coords(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (91.0, 0.0), (0.0, -181.0), (90.0, 180.0)], "lat double, lon double")
    assert df.where(geodesy.valid_coords(F.col("lat"), F.col("lon"))).count() == 2


@settings(max_examples=25, deadline=None)
@given(st.integers(min_value=1_735_689_600, max_value=1_767_225_600), st.sampled_from([3600, 14400, 86400]))
def test_anchored_bin_holds_its_time(spark, t, width):
    got = spark.range(1).select(timebins.anchored_bin(F.lit(t), 1_735_689_600, width)).first()[0]
    assert got <= t < got + width and (got - 1_735_689_600) % width == 0


def test_dayparts(spark):
    df = spark.createDataFrame([(h,) for h in (0, 5, 6, 10, 11, 12, 17, 18, 23)], "h int")
    got = df.select(timebins.daypart(F.col("h")).alias("local"), timebins.daypart(F.col("h"), 6, 12).alias("utc")).collect()
    assert [r.local for r in got] == ["morning"] * 4 + ["afternoon"] * 3 + ["evening"] * 2
    assert [r.utc for r in got] == [None, None, "morning", "morning", "morning", "afternoon", "afternoon", "evening", "evening"]


def test_div0_rounding_and_draws(spark):
    df = spark.createDataFrame([(6.0, 3.0), (6.0, 0.0), (None, 0.0), (None, 2.0), (1.0, None)], "n double, d double")
    assert [r[0] for r in df.select(div0(F.col("n"), F.col("d"))).collect()] == [2.0, 0.0, None, None, None]
    assert spark.range(1).select(report_round(F.lit(0.1) + F.lit(0.2) + F.lit(4.565), 2)).first()[0] == 4.87
    draws = [r[0] for r in spark.range(2000).select(uniform(F.col("id"), 1, 0)).collect()]
    assert 0 <= min(draws) and max(draws) < 1 and abs(sum(draws) / 2000 - 0.5) < 0.03
    again = spark.range(2000).repartition(7).select("id", uniform(F.col("id"), 1, 0).alias("u")).orderBy("id").collect()
    assert [r.u for r in again] == draws


def test_info_field_reads_json_and_struct(spark):
    text = spark.createDataFrame([('{"A": 1.5}',)], "m string")
    struct = spark.createDataFrame([((1.5,),)], "m struct<A: double>")
    assert text.select(info_field(text, "m", "A")).first()[0] == struct.select(info_field(struct, "m", "A")).first()[0] == 1.5


def test_days_and_hours_ignore_the_session_time_zone(spark):
    times = spark.createDataFrame([(1735689599,), (1735689600,), (1751371199,), (1751371200,)], "t long")
    t = F.col("t")
    wanted = times.select(
        timebins.utc_date(t).cast("string"), timebins.utc_clock(t), timebins.summary_hour(t), timebins.local_hour(t),
        timebins.local_hour(t, "America/Los_Angeles"),
    )
    before = wanted.collect()
    assert tuple(before[0]) == ("2024-12-31", "23:59:59", 1735686000, 23, 15)
    assert tuple(before[3]) == ("2025-07-01", "12:00:00", 1751371200, 12, 5)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        assert times.select(*[c for c in (
            timebins.utc_date(t).cast("string"), timebins.utc_clock(t), timebins.summary_hour(t), timebins.local_hour(t),
            timebins.local_hour(t, "America/Los_Angeles"),
        )]).collect() == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_curve_keys_interleave_and_hold_their_descendants(spark):
    rnd = random.Random(3)
    rows = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(300)] + [(None, 1.0)]
    fine, coarse = cells.cell(F.col("lat"), F.col("lon"), 25), cells.cell(F.col("lat"), F.col("lon"), 14)
    for r in spark.createDataFrame(rows, "lat double, lon double").select(
        cells.cell_x(fine).alias("x"), cells.cell_y(fine).alias("y"), cells.curve_key(fine).alias("key"),
        cells.curve_end(fine).alias("last"), cells.curve_key(coarse).alias("begin"), cells.curve_end(coarse).alias("end"),
    ).collect():
        if r.x is None or r.y is None:
            assert r.key is None and r.begin is None
            continue
        key = sum((r.x >> i & 1) << 2 * i + 1 | (r.y >> i & 1) << 2 * i for i in range(26))
        assert r.key == r.last == key and r.begin <= key <= r.end
        assert r.begin == key >> 22 << 22 and r.end - r.begin == 2**22 - 1
