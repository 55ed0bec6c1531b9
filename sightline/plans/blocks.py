"""Grid, sphere, time, ingest and multiplier queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from sightline.functions import cells, geodesy, timebins
from sightline.functions.scalars import between_dates
from sightline.operators import multiplier as mult, spatial, storage
from sightline.plans.registry import query
from sightline.plans.sqltext import (
    VENUE_LAT, VENUE_LON, angle_between, bearing, cell_at, centre_lat, centre_lon, cover_rows, cx, cy, div0, hav, pack,
)
from sightline.sources import pings as ping_source

P_START, P_END = dt.date(2025, 1, 1), dt.date(2025, 1, 8)
E_START, E_END = dt.date(2025, 1, 1), dt.date(2025, 12, 31)
EVENT_DAY = dt.date(2025, 2, 9)


def here() -> tuple[Column, Column]:
    return F.col("lat"), F.col("lon")


def venue() -> tuple[Column, Column]:
    return F.lit(VENUE_LAT), F.lit(VENUE_LON)


@query("g1_cell_index", f"select ping_id, c11, c14, c17, c20, {cell_at(25)} as c25 from fx_pings")
def _(fx):
    return fx.pings.select("ping_id", *[cells.cell(*here(), z).alias(f"c{z}") for z in (11, 14, 17, 20, 25)])


@query("g2_cell_parents", f"select ping_id, {cell_at(24)} as p24, c20 as p20, c17 as p17, c14 as p14, c11 as p11 from fx_pings")
def _(fx):
    c = fx.pings.select("ping_id", cells.cell(*here(), 25).alias("c"))
    return c.select("ping_id", *[cells.cell_parent(F.col("c"), z).alias(f"p{z}") for z in (24, 20, 17, 14, 11)])


@query("g3_cell_children", f"""
    with c as (select distinct c17 from fx_pings)
    select c17, {pack(18, cx('c17') + '*2+i%2', cy('c17') + '*2+i//2')} as child, i as child_no,
           {pack(20, cx('c17') + '*8', cy('c17') + '*8')} as first_fine, {pack(20, cx('c17') + '*8+3', cy('c17') + '*8+2')} as fine_19
    from c, range(4) as r(i)""")
def _(fx):
    c = F.col("c17")
    return fx.pings.select("c17").distinct().select(
        "c17", F.posexplode(cells.cell_children(c, 18)).alias("child_no", "child"),
        cells.cell_child(c, 20, 0).alias("first_fine"), cells.cell_child(c, 20, 19).alias("fine_19"),
    ).withColumn("child_no", F.col("child_no").cast("bigint"))


@query("g4_cell_centroid", f"select ping_id, round({centre_lat('c17', 17)},8) as clat, round({centre_lon('c17', 17)},8) as clon from fx_pings", digits=8)
def _(fx):
    return fx.pings.select("ping_id", cells.cell_lat(F.col("c17")).alias("clat"), cells.cell_lon(F.col("c17")).alias("clon"))


@query("g5_grid_disk", f"""
    with c as (select distinct c17 from fx_pings)
    select c17, {pack(17, cx('c17') + '+dx', cy('c17') + '+dy')} as nbr from c, range(-2,3) as a(dx), range(-2,3) as b(dy)
    where not (dx=0 and dy=0)""")
def _(fx):
    return fx.pings.select("c17").distinct().select("c17", F.explode(cells.grid_disk(F.col("c17"), 2, 17, True)).alias("nbr"))


@query("g6_cell_cover", f"select site_id, c from ({cover_rows('fx_sites', '180e0', 17, 'site_lat', 'site_lon')}) q")
def _(fx):
    return fx.sites.select("site_id", F.explode(cells.cover(F.col("site_lat"), F.col("site_lon"), 180.0, 17)).alias("c"))


_AREA = f"pow(360e0/131072*pi()*6371008.8/180,2)*cos(radians({centre_lat('c', 17)}))"


@query("g7_cell_proximity_bins", f"""
    select site_id, c, cast(floor(d/10)*10 as bigint) as near_m, cast(ceil((d+sqrt({_AREA}/pi()))/10)*10 as bigint) as far_m
    from (select *, {hav('site_lat', 'site_lon', centre_lat('c', 17), centre_lon('c', 17))} as d
          from ({cover_rows('fx_sites', '180e0', 17, 'site_lat', 'site_lon')}) q) z""")
def _(fx):
    lat, lon = F.col("site_lat"), F.col("site_lon")
    covered = fx.sites.select("site_id", "site_lat", "site_lon", F.explode(cells.cover(lat, lon, 180.0, 17)).alias("c"))
    near, far = cells.proximity_bins(lat, lon, F.col("c"))
    return covered.select("site_id", "c", near.alias("near_m"), far.alias("far_m"))


@query("g8_distance_m", f"select ping_id, round({hav(VENUE_LAT, VENUE_LON, 'lat', 'lon')},4) as d from fx_pings")
def _(fx):
    return fx.pings.select("ping_id", geodesy.distance_m(*venue(), *here()).alias("d"))


@query("g9_within_radius", f"""
    select ping_id, round(d,4) as distance_m from (select ping_id, {hav(VENUE_LAT, VENUE_LON, 'lat', 'lon')} as d from fx_pings) q where d <= 3000""")
def _(fx):
    return spatial.within_radius(fx.pings, "lat", "lon", VENUE_LAT, VENUE_LON, 3000).select("ping_id", "distance_m")


@query("g10_distance_ring", f"""
    select frame_id, round(d,4) as distance_m from (select frame_id, {hav(VENUE_LAT, VENUE_LON, 'site_lat', 'site_lon')} as d from fx_frames) q
    where d >= 1609.34 and d < 4828.02""")
def _(fx):
    return spatial.distance_ring(fx.frames, "site_lat", "site_lon", VENUE_LAT, VENUE_LON, 1609.34, 4828.02).select("frame_id", "distance_m")


@query("g11_spatial_join", f"""
    select ping_id, poi_id, round(d,4) as distance_m
    from (select ping_id, poi_id, {hav('lat', 'lon', 'poi_lat', 'poi_lon')} as d from fx_pings, fx_pois) q where d <= 150""")
def _(fx):
    near = spatial.spatial_join(fx.pings, fx.pois, 150, right_at=("poi_lat", "poi_lon"))
    return near.select("ping_id", "poi_id", "distance_m")


@query("g12_azimuth", f"select ping_id, round({bearing(VENUE_LAT, VENUE_LON, 'lat', 'lon')},4) as azimuth from fx_pings")
def _(fx):
    return fx.pings.select("ping_id", geodesy.azimuth(*venue(), *here()).alias("azimuth"))


@query("g13_angle_diff", f"""
    select frame_id, round({angle_between(bearing(VENUE_LAT, VENUE_LON, 'site_lat', 'site_lon'), 'exposition_angle')},4) as diff from fx_frames""")
def _(fx):
    toward = geodesy.azimuth(*venue(), F.col("site_lat"), F.col("site_lon"))
    return fx.frames.select("frame_id", geodesy.angle_diff(toward, F.col("exposition_angle")).alias("diff"))


_SHIFTED = "lat+(ping_id%3)*31"


@query("g14_valid_coords", f"""
    select ping_id from (select ping_id, case when market_id=4 then null else {_SHIFTED} end as lat, lon from fx_pings) q
    where lat is not null and lon is not null and lat between -90 and 90 and lon between -180 and 180""")
def _(fx):
    moved = fx.pings.withColumn("lat", F.expr(f"case when market_id=4 then null else {_SHIFTED} end"))
    return moved.where(geodesy.valid_coords(*here())).select("ping_id")


@query("t1_hour_bin", "select cast(floor(unix_ts/3600e0) as bigint) as hour_bin, count(*) as n from fx_pings group by 1")
def _(fx):
    return fx.pings.groupBy(timebins.hour_bin(F.col("unix_ts")).alias("hour_bin")).agg(F.count("*").alias("n"))


@query("t2_anchored_bin", """
    select ping_id, 1735689600+3600*((unix_ts-1735689600)//3600) as b1, 1735689600+14400*((unix_ts-1735689600)//14400) as b4,
           1735689600+86400*((unix_ts-1735689600)//86400) as b24 from fx_pings""")
def _(fx):
    bins = [timebins.anchored_bin(F.col("unix_ts"), 1735689600, h * 3600).alias(f"b{h}") for h in (1, 4, 24)]
    return fx.pings.select("ping_id", *bins)


@query("t3_summary_hour", "select ping_id, unix_ts - unix_ts%3600 as summary_hour from fx_pings")
def _(fx):
    return fx.pings.select("ping_id", timebins.summary_hour(F.col("unix_ts")).alias("summary_hour"))


@query("t4_event_window", """
    select core_date, cast(core_date - date '2025-02-09' as bigint) as relative_day, count(*) as n from fx_exposures
    where core_date between date '2025-01-12' and date '2025-02-23' group by 1, 2""")
def _(fx):
    start, end = timebins.event_window(EVENT_DAY)
    day = timebins.relative_day(F.col("core_date"), EVENT_DAY).cast("bigint").alias("relative_day")
    return fx.exposures.where(between_dates("core_date", start, end)).groupBy("core_date", day).agg(F.count("*").alias("n"))


_UTC_HOUR = "((device_time//3600)%24)"
# Los Angeles runs on UTC-7 from 2025-03-09 10:00 to 2025-11-02 09:00 UTC, else on UTC-8.
LA_HOUR = "(((device_time + (case when device_time >= 1741514400 and device_time < 1762074000 then -25200 else -28800 end))//3600)%24)"


@query("t5_local_hour_daypart", f"""
    select case when {_UTC_HOUR}>=18 then 'evening' when {_UTC_HOUR}>=12 then 'afternoon' when {_UTC_HOUR}>=6 then 'morning' end as utc_part,
           cast({LA_HOUR} as bigint) as la_hour,
           case when {LA_HOUR}>=18 then 'evening' when {LA_HOUR}>=11 then 'afternoon' else 'morning' end as la_part, count(*) as n
    from fx_exposures group by 1,2,3""")
def _(fx):
    t = F.col("device_time")
    la = timebins.local_hour(t, "America/Los_Angeles")
    return fx.exposures.groupBy(
        timebins.daypart(timebins.local_hour(t), 6, 12).alias("utc_part"), la.cast("bigint").alias("la_hour"),
        timebins.daypart(la).alias("la_part"),
    ).agg(F.count("*").alias("n"))


@query("i1_ingest_pings", f"""
    select cast(core_date as varchar) as core_date, device_hash as device_id, unix_ts, round(lat,8) as lat, round(lon,8) as lon,
           round(lon,8) as geo_lon, round(lat,8) as geo_lat,
           datasource_id, accuracy, device_ip, user_agent, publisher_id, make, os, os_version, categories, country_code, market_hash,
           {cell_at(25)} as c25, c20, c17, c14, c11, unix_ts as timestamp_s
    from (select p.*, r.datasource_id, r.accuracy, r.user_agent, r.publisher_id, r.make, r.os, r.os_version, r.categories, r.country_code, r.market_hash
          from fx_pings p, (select distinct datasource_id, accuracy, user_agent, publisher_id, make, os, os_version, categories, country_code, market_hash
                            from fx_raw_pings) r where r.publisher_id=p.market_id and r.os=p.device_os) q""", digits=8)
def _(fx):
    raw, out = storage.new_path(fx.spark, "raw-pings"), storage.new_path(fx.spark, "pings")
    fx.raw_pings.write.option("sep", "\t").option("compression", "gzip").csv(raw)
    ping_source.ingest_pings(fx.spark, raw, out)
    table = fx.spark.read.parquet(out)
    return table.select(
        F.col("core_date").cast("string").alias("core_date"), F.col("device_geo.lon").alias("geo_lon"), F.col("device_geo.lat").alias("geo_lat"),
        F.unix_timestamp("timestamp").alias("timestamp_s"),
        *[c for c in ping_source.INGESTED_COLUMNS if c not in ("core_date", "timestamp", "device_geo")],
    )


@query("i2_backfill_paths", """
    select concat('raw/', markethash, '/', strftime(d, '%Y/%m/%d'), '/part-*.gz') as path
    from fx_markets, (select unnest(generate_series(min(core_date), max(core_date), interval 1 day)) as d from fx_pings) q""")
def _(fx):
    return ping_source.backfill_path_rows("raw", fx.markets, fx.pings)


def _located(fx) -> DataFrame:
    return mult.market_lookup(fx.pings, fx.markets, fx.markets)


@query("m0_market_lookup", "select ping_id, cast(dma_code-600 as bigint) as market_id from fx_pings")
def _(fx):
    return _located(fx).select("ping_id", "market_id")


_BASE = f"""
    pins as (select device_hash, c11, c14, m.market_id as mk, m.marketmetrics,
                    1735689600+3600*((unix_ts-1735689600)//3600) as b1, 1735689600+14400*((unix_ts-1735689600)//14400) as b4,
                    1735689600+86400*((unix_ts-1735689600)//86400) as b24
             from fx_pings p left join fx_markets m on m.dma_code=p.dma_code
             where core_date between date '2025-01-01' and date '2025-01-08'),
    base as (select resolution, cell, bin_start, cast(greatest(coalesce({div0('pop', 'n')},1),1) as decimal(20,4)) as multiplier,
                    cast(to_timestamp(bin_start) at time zone 'UTC' as date) as core_date from (
             select 7 as resolution, c14 as cell, b1 as bin_start, pop, count(distinct device_hash) as n from pins left join fx_cell_pop on cell=c14 group by c14, b1, pop
             union all
             select 5, c11, b4, pop, count(distinct device_hash) from pins left join fx_cell_pop on cell=c11 group by c11, b4, pop
             union all
             select 100, mk, b24, cast(json_extract_string(marketmetrics, '$.marketpop') as double) as pop, count(distinct device_hash)
             from pins where mk is not null group by 1, 2, 3, 4) q)"""
_ROLL = f"""
    roll as (select f.core_date, f.cell, f.bin_start, f.bin_start+3599 as bin_end, f.bin_start//3600 as time_bin_1h,
                    cast(least((coalesce(cast(f.multiplier as double),0)+coalesce(cast(c.multiplier as double),0)+coalesce(cast(k.multiplier as double),0))
                         /((f.multiplier is not null)::int+(c.multiplier is not null)::int+(k.multiplier is not null)::int),1000) as decimal(20,4)) as multiplier
             from (select * from base where resolution=7) f
             left join (select * from base where resolution=5) c
               on c.cell={pack(11, cx('f.cell') + ' >> 3', cy('f.cell') + ' >> 3')} and f.bin_start between c.bin_start and c.bin_start+14399
             left join fx_cell_market m on m.cell={pack(17, cx('f.cell') + ' << 3', cy('f.cell') + ' << 3')}
             left join (select * from base where resolution=100) k on k.cell=m.market_id and f.bin_start between k.bin_start and k.bin_start+86399)"""
_OUT_BASE = "cast(core_date as varchar) as core_date, resolution, cell, bin_start, round(cast(multiplier as double),4) as multiplier"
_OUT_ROLL = "cast(core_date as varchar) as core_date, cell, bin_start, bin_end, time_bin_1h, round(cast(multiplier as double),4) as multiplier"


def _base(fx) -> DataFrame:
    return mult.base_multiplier(fx.pings, fx.cell_pop, fx.markets, fx.markets, P_START, P_END)


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("core_date", F.col("core_date").cast("string"))


@query("m1_base_multiplier", f"with {_BASE} select {_OUT_BASE} from base")
def _(fx):
    return _dated(_base(fx))


def _stale(run: DataFrame) -> DataFrame:
    """An older state of the table: the first half of the run's days, with other multipliers."""
    return run.where(between_dates("core_date", P_START, dt.date(2025, 1, 4))).withColumn("multiplier", F.lit(2).cast(mult.STORED))


@query("m2_upsert_base", f"with {_BASE} select {_OUT_BASE} from base")
def _(fx):
    # The written table starts stale and partial; upserting the whole run makes it equal to the run.
    base, path = _base(fx), storage.new_path(fx.spark, "multi-base")
    storage.write_partitions(_stale(base), path)
    storage.upsert_partitions(fx.spark, path, base, mult.BASE_KEYS, sort=["resolution", "cell"])
    return _dated(fx.spark.read.parquet(path).select(*base.columns))


@query("m3_rollup_multiplier", f"with {_BASE}, {_ROLL} select {_OUT_ROLL} from roll")
def _(fx):
    return _dated(mult.rollup_multiplier(_base(fx), fx.cell_market, P_START, P_END))


@query("m4_upsert_multiplier", f"""
    with {_BASE}, {_ROLL}
    select {_OUT_ROLL} from roll
    union all select cast(core_date + 31 as varchar), cell, bin_start, bin_end, time_bin_1h, 2e0 from roll where core_date <= date '2025-01-04'""")
def _(fx):
    new = mult.rollup_multiplier(_base(fx), fx.cell_market, P_START, P_END)
    stale = _stale(new)
    # Rows of the run are replaced or added, the other month's rows stay.
    path = storage.new_path(fx.spark, "multiplier")
    storage.write_partitions(stale.unionByName(stale.withColumn("core_date", F.date_add("core_date", 31))), path)
    storage.upsert_partitions(fx.spark, path, new, mult.MULTIPLIER_KEYS, sort=["cell", "bin_start"])
    return _dated(fx.spark.read.parquet(path).select(*new.columns))


@query("m5_apply_multiplier", """
    select path_id, frame_id, asset_id, e.device_time, viewability, round(m.multiplier,4) as multiplier,
           round(coalesce(m.multiplier,1)*decayed_value,4) as mp_value
    from fx_exposures e left join fx_multiplier m on m.core_date=e.core_date and m.time_bin_1h=e.time_bin_1h and m.c14=e.c14""")
def _(fx):
    weighted = mult.apply_multiplier(fx.exposures, fx.multiplier)
    return weighted.select("path_id", "frame_id", "asset_id", "device_time", "viewability", "multiplier", "mp_value")


@query("m6_backfill_market_id", """
    select ping_id, coalesce(m.market_id, p.market_id) as market_id from fx_pings p left join fx_cell_market m on m.cell=p.c17""")
def _(fx):
    return mult.backfill_market_id(fx.pings, fx.cell_market).select("ping_id", "market_id")
