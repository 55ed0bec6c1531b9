"""Matching and diffusion queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sightline.functions.cells import METERS_PER_DEGREE
from sightline.operators import diffusion as diff, matching as match, multiplier as mult, storage
from sightline.plans.blocks import P_END, P_START
from sightline.plans.registry import query
from sightline.plans.sqltext import (
    angle_between, bearing, cell_at, centre_lat, centre_lon, cx, cy, hav, mixed_cover_rows, pack,
)

# ---- frames, cells and sightings

_PROX = f"""
    prox as (select f.*, greatest(150e0, coalesce(3*greatest(frame_width, frame_height)*(case dimension_unit when 'METER' then 1e0 when 'FOOT' then 0.3048e0 end)
                    /nullif(2*tan(radians(min_noticing_radial)/2), 0), 150e0)) as match_radius, {cell_at(17, 'site_lat', 'site_lon')} as site_cell
             from fx_frames f left join fx_process_meta m on m.process_id=f.process_id)"""
_COVER = f"""
    widest as (select s.site_id, s.site_lat, s.site_lon, max(match_radius) as max_radius from fx_sites s join prox p on p.site_id=s.site_id group by all),
    cells as ({mixed_cover_rows('widest', '1.2e0*max_radius', 17, 'site_lat', 'site_lon')})"""
_MATCH = f"""
    pair as (select p.ping_id, p.core_date, p.device_hash, p.device_ip, p.device_os, p.unix_ts as device_time, p.lat, p.lon, p.c14, p.c17, s.site_id,
                    {hav('site_lat', 'site_lon', 'lat', 'lon')} as d, {bearing('site_lat', 'site_lon', 'lat', 'lon')} as az
             from fx_pings p, fx_sites s where {hav('site_lat', 'site_lon', 'lat', 'lon')} <= 2000),
    matches as (select * from (
             select x.core_date, x.device_hash, x.device_ip, x.device_os, x.device_time, x.lat, x.lon, x.c14, x.c17, x.d, x.az,
                    {angle_between('x.az', 'f.exposition_angle')} as diff, f.owner_id, f.site_id, f.frame_id, f.frame_type, f.market_id,
                    f.match_radius, f.exposition_angle, f.exposition_width
             from pair x join prox f on f.site_id=x.site_id where x.d <= f.match_radius) q
             where diff <= greatest(exposition_width, 180)/2)"""
_STATIC = """
    sighted as (
        select * exclude (before) from (
            select *, lag(device_time) over (partition by device_hash, frame_id order by device_time, d, c17) as before
            from matches where frame_type='STATIC') q where before is null or device_time-before >= 3600
        union all select * from matches where frame_type <> 'STATIC')"""
_SIGHT_OUT = """cast(core_date as varchar) as core_date, owner_id, site_id, frame_id, frame_type, market_id, device_hash, device_time,
    round(d,4) as match_distance_meter, round(diff,4) as match_angle_degree, round(az,4) as absolute_angle_degree,
    round(match_radius,4) as match_radius, c14, c17, device_ip, device_os, round(lat,4) as device_lat, round(lon,4) as device_lon"""


def _proximity(fx) -> DataFrame:
    return match.frame_proximity(fx.frames, fx.process_meta)


def _matches(fx) -> DataFrame:
    prox = _proximity(fx)
    return match.frame_device_match(prox, match.site_cells(fx.sites, prox), fx.pings, P_START, P_END)


def _sight_out(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        F.col("core_date").cast("string").alias("core_date"), "owner_id", "site_id", "frame_id", "frame_type", "market_id",
        "device_hash", "device_time", "match_distance_meter", "match_angle_degree", "absolute_angle_degree",
        F.col("match_info.FRAME_MATCH_RADIUS").alias("match_radius"), "c14", "c17", "device_ip", "device_os",
        F.col("device_geog.lat").alias("device_lat"), F.col("device_geog.lon").alias("device_lon"), *more,
    )


@query("x1_frame_proximity", f"with {_PROX} select frame_id, site_id, frame_elevation, round(match_radius,4) as match_radius, site_cell from prox")
def _(fx):
    return _proximity(fx).select("frame_id", "site_id", "frame_elevation", "match_radius", "site_cell")


_CENTRE_M = hav('c.site_lat', 'c.site_lon', '((yy+0.5e0)*360e0/(1 << z)-90e0)', '((xx+0.5e0)*360e0/(1 << z)-180e0)')
# The radius of a circle of the cell's area.
_REACH_M = f"sqrt(pow(360e0/(1 << z)*{METERS_PER_DEGREE}, 2)*cos(radians((yy+0.5e0)*360e0/(1 << z)-90e0))/pi())"


@query("x2_site_cover", f"""
    with {_PROX}, {_COVER}
    select frame_id, c.site_id, c.c as cell, case when z > 14 then (14::bigint << 52) | ((xx >> (z-14)) << 26) | (yy >> (z-14)) else c.c end as c14,
           cast(floor({_CENTRE_M}/10)*10 as bigint) as proximity_bin_min,
           cast(ceil(({_CENTRE_M}+{_REACH_M})/10)*10 as bigint) as proximity_bin_max
    from cells c join prox p on p.site_id=c.site_id""")
def _(fx):
    return match.site_cover(fx.sites, _proximity(fx)).select(
        "frame_id", "site_id", "cell", "c14", "proximity_bin_min", "proximity_bin_max"
    )


@query("x3_device_prefilter", f"""
    with {_PROX}, {_COVER},
    zooms as (select distinct z from cells),
    above as (select p.*, (cast(z as bigint) << 52) | (({cx('c17')} >> (17-z)) << 26) | ({cy('c17')} >> (17-z)) as c from fx_pings p, zooms)
    select distinct ping_id, time_bin_1h, c17 from above where c in (select c from cells)""")
def _(fx):
    cells = match.site_cells(fx.sites, _proximity(fx))
    return match.device_prefilter(fx.pings, cells, P_START, P_END).select("ping_id", "time_bin_1h", "c17")


@query("x4_frame_device_match", f"with {_PROX}, {_MATCH} select {_SIGHT_OUT} from matches")
def _(fx):
    return _sight_out(_matches(fx))


def _stage1(fx) -> DataFrame:
    return match.stage1(fx.frames, fx.process_meta, fx.sites, fx.pings, P_START, P_END)


@query("x5_dedupe_static", f"with {_PROX}, {_MATCH}, {_STATIC} select {_SIGHT_OUT} from sighted")
def _(fx):
    return _sight_out(_stage1(fx))


@query("x6_write_stage1", f"with {_PROX}, {_MATCH}, {_STATIC} select {_SIGHT_OUT}, cast(0 as bigint) as call_id from sighted")
def _(fx):
    path = storage.new_path(fx.spark, "stage1")
    match.write_stage1(_stage1(fx), path)
    stored = fx.spark.read.parquet(path)
    return _sight_out(stored, "call_id")


_JOINED = """
    joined as (select s.*, a.creative_id, a.start_epoch, a.end_epoch, device_time//3600 as time_bin_1h
               from sighted s left join (select * from fx_adplays where {active}) a
                 on a.site_id=s.site_id and a.frame_id=s.frame_id and device_time between start_epoch-30 and end_epoch+30)"""
_SPANNING = _JOINED.format(active="start_date <= date '2025-01-01' and end_date >= date '2025-01-08'")
_OVERLAPPING = _JOINED.format(active="start_date <= date '2025-01-08' and end_date >= date '2025-01-01'")
_DIGITAL = """
    shown as (
        select * exclude (before) from (
            select *, lag(device_time) over (partition by device_hash, creative_id, frame_id order by device_time, d, c17, start_epoch) as before
            from joined where frame_type <> 'STATIC') q where before is null or device_time-before >= 300
        union all select * from joined where frame_type = 'STATIC')"""
_JOIN_OUT = _SIGHT_OUT + ", creative_id, start_epoch as ad_start_epoch, end_epoch as ad_end_epoch, time_bin_1h"


def _joined(fx, spanning: bool = False, dedupe: bool = False) -> DataFrame:
    return match.adplay_sightings(
        fx.frames, fx.process_meta, fx.sites, fx.pings, fx.adplays, P_START, P_END, spanning=spanning, dedupe=dedupe
    )


def _join_out(df: DataFrame) -> DataFrame:
    return _sight_out(df, "creative_id", "ad_start_epoch", "ad_end_epoch", "time_bin_1h")


@query("x7_adplay_interval_join", f"with {_PROX}, {_MATCH}, {_STATIC}, {_SPANNING} select {_JOIN_OUT} from joined")
def _(fx):
    return _join_out(_joined(fx, spanning=True))


@query("x7_adplay_interval_join_overlapping", f"with {_PROX}, {_MATCH}, {_STATIC}, {_OVERLAPPING} select {_JOIN_OUT} from joined")
def _(fx):
    return _join_out(_joined(fx))


@query("x8_dedupe_digital", f"with {_PROX}, {_MATCH}, {_STATIC}, {_OVERLAPPING}, {_DIGITAL} select {_JOIN_OUT} from shown")
def _(fx):
    return _join_out(_joined(fx, dedupe=True))


_BANDS = f"""{_JOIN_OUT},
    case when d < 0.2e0*match_radius then 'LIKELY_TO_SEE' when d < 0.375e0*match_radius then 'OPPORTUNITY_TO_SEE'
         when d < 0.5e0*match_radius then 'CHANCE_TO_SEE' else 'DECAYED' end as viewability,
    round(least(1e0, (match_radius-d)/(match_radius/2))
          * case when exposition_width >= 180 then 1e0 else least(1e0, (90-diff)/(90-exposition_width/2)) end, 4) as decayed_value"""


def _stage2(fx) -> DataFrame:
    return match.viewability_decay(_joined(fx, dedupe=True))


def _band_out(df: DataFrame) -> DataFrame:
    return _sight_out(df, "creative_id", "ad_start_epoch", "ad_end_epoch", "time_bin_1h", "viewability", "decayed_value")


@query("x9_viewability_decay", f"with {_PROX}, {_MATCH}, {_STATIC}, {_OVERLAPPING}, {_DIGITAL} select {_BANDS} from shown")
def _(fx):
    return _band_out(_stage2(fx))


@query("x10_write_stage2", f"with {_PROX}, {_MATCH}, {_STATIC}, {_OVERLAPPING}, {_DIGITAL} select {_BANDS} from shown")
def _(fx):
    path = storage.new_path(fx.spark, "stage2")
    match.write_stage2(_stage2(fx), path)
    return _band_out(fx.spark.read.parquet(path))


@query("x11_counts_by_date", f"with {_PROX}, {_MATCH}, {_STATIC} select cast(core_date as varchar) as core_date, count(*) as n from sighted group by 1")
def _(fx):
    return match.sightings_by_date(fx.frames, fx.process_meta, fx.sites, fx.pings, P_START, P_END).withColumn("core_date", F.col("core_date").cast("string"))


# ---- diffusion

_W = "w as (select market_id, c14, c20, count(*) as w from fx_pings group by all)"
_P = "p as (select *, w/sum(w) over (partition by market_id, c14) as p from w)"
_NBR = f"""
    nbr as (select market_id, c14, c20 as src, {pack(20, cx('c20') + '+dx', cy('c20') + '+dy')} as nbr
            from w, range(-2,3) as a(dx), range(-2,3) as b(dy) where not (dx=0 and dy=0))"""
_CDF = """
    share as (select n.*, pow(greatest(coalesce(p.p,0)+1e-6,1e-6),0.2e0) as wt
              from nbr n left join p on p.market_id=n.market_id and p.c14=n.c14 and p.c20=n.nbr),
    cdf as (select market_id, c14, src, nbr,
                   sum(wt/tot) over (partition by market_id, c14, src order by nbr rows between unbounded preceding and current row) as cdf
            from (select *, sum(wt) over (partition by market_id, c14, src) as tot from share) q)"""


def _draw(step: str, seed: int = 0) -> str:
    return f"(cast(concat('0x', substr(md5(concat_ws(':', row_id, '{step}', '{seed}')),1,8)) as bigint)/4294967296e0)"


def _hops(n: int) -> str:
    steps = ["h0 as (select ping_id as row_id, market_id, c14, c20 as src, c20 as cur from fx_pings)"]
    for i in range(1, n + 1):
        steps.append(f"""
            h{i} as materialized (
                select h.row_id, h.market_id, h.c14, h.src,
                       coalesce(arg_min(c.nbr, (c.cdf, c.nbr)) filter (c.cdf >= h.r), arg_max(c.nbr, (c.cdf, c.nbr)), h.cur) as cur
                from (select *, {_draw(str(i))} as r from h{i - 1}) h
                left join cdf c on c.market_id=h.market_id and c.c14=h.c14 and c.src=h.cur
                group by h.row_id, h.market_id, h.c14, h.src, h.cur)""")
    return ", ".join(steps)


_MODEL = ", ".join([_W, _P, _NBR, _CDF])
N_HOPS = 10


def _staged(fx) -> DataFrame:
    return diff.stage_region(mult.market_lookup(fx.pings, fx.markets, fx.markets), id_column="ping_id")


def _weights(fx) -> DataFrame:
    return diff.baseline_weights(fx.pings, P_START, P_END)


def _cdf(fx) -> DataFrame:
    w = _weights(fx)
    return diff.neighbour_cdf(diff.neighbour_pairs(w), diff.cell_probability(w))


@query("d1_stage_region", """
    select ping_id, ping_id as row_id, market_id, c14, c20 as src from fx_pings
    where dma_code=602 and provider='a' and c14 in (select c14 from fx_pings where ping_id%3=0)""")
def _(fx):
    located = mult.market_lookup(fx.pings, fx.markets, fx.markets)
    cells = fx.pings.where("ping_id % 3 = 0").select("c14")
    return diff.stage_region(located, cells=cells, dma_code=602, provider="a", id_column="ping_id").select(
        "ping_id", "row_id", "market_id", "c14", "src"
    )


@query("d2_baseline_weights", f"with {_W} select * from w")
def _(fx):
    return _weights(fx)


@query("d3_cell_probability", f"with {_W}, {_P} select market_id, c14, c20, w, round(p,6) as p from p", digits=6)
def _(fx):
    return diff.cell_probability(_weights(fx))


@query("d4_neighbour_pairs", f"with {_W}, {_NBR} select * from nbr")
def _(fx):
    return diff.neighbour_pairs(_weights(fx))


@query("d5_neighbour_cdf", f"with {_MODEL} select market_id, c14, src, nbr, round(cdf,6) as cdf from cdf", digits=6)
def _(fx):
    return _cdf(fx)


@query("d6_cdf_max", f"with {_MODEL} select market_id, c14, src, round(max(cdf),6) as max_cdf from cdf group by all", digits=6)
def _(fx):
    return diff.cdf_max(_cdf(fx))


@query("d7_diffuse_hop", f"with {_MODEL}, {_hops(1)} select row_id, market_id, c14, src, cur from h1")
def _(fx):
    positions = _staged(fx).select("row_id", *diff.SOURCE, F.col("src").alias("cur"))
    return diff.diffuse_hop(positions, diff.hop_table(_cdf(fx)), 1)


@query("d8_diffuse", f"with {_MODEL}, {_hops(N_HOPS)} select row_id, cur, cast(1 as bigint) as copies from h{N_HOPS}")
def _(fx):
    return diff.diffuse(_staged(fx), _cdf(fx), N_HOPS).select("row_id", "cur", "copies")


_SNAPS = " union all ".join(f"select {i} as iter, cur as c20, count(*) as ping_count from h{i} group by cur" for i in range(1, N_HOPS + 1))


@query("d9_density_snapshot", f"with {_MODEL}, {_hops(N_HOPS)} {_SNAPS}")
def _(fx):
    path, snapshots = storage.new_path(fx.spark, "snapshots"), diff.density_snapshots(diff.diffuse_steps(_staged(fx), _cdf(fx), N_HOPS))
    diff.append_snapshots(snapshots, path)
    return fx.spark.read.parquet(path).select(*snapshots.columns)


@query("d10_spread_metric", f"with {_MODEL}, {_hops(N_HOPS)} select iter, count(*) as cells_n from ({_SNAPS}) q group by iter")
def _(fx):
    return diff.spread_metric(diff.density_snapshots(diff.diffuse_steps(_staged(fx), _cdf(fx), N_HOPS)))


_KIDS = f"""
    kid as (select row_id, cur, {pack(24, cx('cur') + '*16+i%16', cy('cur') + '*16+i//16')} as dest_child
            from (select *, cast(floor({_draw('child')}*256) as bigint) as i from h{N_HOPS}) q)"""


@query("d11_jitter_to_child", f"""
    with {_MODEL}, {_hops(N_HOPS)}, {_KIDS}
    select row_id, dest_child, round({centre_lat('dest_child', 24)},8) as new_lat, round({centre_lon('dest_child', 24)},8) as new_lon from kid""", digits=8)
def _(fx):
    moved = diff.jitter_to_child(diff.diffuse(_staged(fx), _cdf(fx), N_HOPS))
    return moved.select("row_id", "dest_child", "new_lat", "new_lon")


@query("d12_parity_writeback", f"""
    with {_MODEL}, {_hops(N_HOPS)}, {_KIDS},
    moved as (select p.ping_id, p.device_hash, p.unix_ts, {centre_lat('dest_child', 24)} as lat, {centre_lon('dest_child', 24)} as lon
              from fx_pings p join kid on row_id=ping_id)
    select ping_id, device_hash, unix_ts, round(lat,8) as lat, round(lon,8) as lon, {cell_at(17)} as c17, {cell_at(14)} as c14, {cell_at(11)} as c11 from moved""", digits=8)
def _(fx):
    staged = _staged(fx)
    smooth = diff.parity_writeback(staged, diff.jitter_to_child(diff.diffuse(staged, _cdf(fx), N_HOPS)))
    path = storage.new_path(fx.spark, "smoothed")
    diff.write_smoothed(smooth, path)
    return fx.spark.read.parquet(path).select("ping_id", "device_hash", "unix_ts", "lat", "lon", "c17", "c14", "c11")


def _argument(key: str) -> str:
    return f"json_extract_string(call_info, '$.CALL_ARGUMENTS.{key}') as {key.lower()}"


@query("d13_run_log_summary", f"""
    select w.call_id, format('{{:,}}', w.n) as counts, {', '.join(_argument(k) for k in ('BASE_START', 'BASE_END', 'TEMP', 'K', 'DMA_LIST'))},
           cast(cast(log_time as date) as varchar) as run_date
    from (select call_id, count(*) as n from fx_weights group by call_id) w left join fx_run_log l on l.call_id=w.call_id where call_state='EXIT'""")
def _(fx):
    return diff.run_log_summary(fx.weights, fx.run_log).withColumn("run_date", F.col("run_date").cast("string"))
