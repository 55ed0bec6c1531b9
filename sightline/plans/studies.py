"""Proximity, conversion and control-study queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sightline.operators import studies
from sightline.operators.storage import new_path, save_table
from sightline.plans.blocks import E_END, E_START, P_END, P_START
from sightline.plans.registry import query
from sightline.plans.reports import _MULT
from sightline.plans.sqltext import VENUE_LAT, VENUE_LON, hav

CONVERSION_M = 1500


def _number(key: str) -> str:
    return f"cast(json_extract_string(match_info, '$.{key}') as double)"


@query("p1_exposures_for_frames", f"""
    with {_MULT}
    select path_id, frame_id, device_hash, device_time, round(m,4) as multiplier, round(mp_value,4) as mp_value
    from me where frame_id in (select inventory_id from fx_inventory where inventory_type='billboards')""")
def _(fx):
    billboards = fx.inventory.where("inventory_type = 'billboards'").select(F.col("inventory_id").alias("frame_id"))
    rows = studies.exposures_for_frames(fx.exposures, fx.multiplier, billboards, E_START, E_END)
    return rows.select("path_id", "frame_id", "device_hash", "device_time", "multiplier", "mp_value")


_FACING = f"viewability <> 'DECAYED' and {_number('MATCH_ANGLE_DEGREE')} < 65 and {_number('MATCH_ANGLE_DEGREE')} > -65"


@query("p2_exposure_affinity_points", f"""
    select frame_id, round(lon,4) as lon, round(lat,4) as lat, viewability, audience_attribute as affinity_attribute
    from fx_exposures e join fx_affinities a on a.device_hash=e.device_hash where {_FACING}""")
def _(fx):
    return studies.exposure_affinity_points(fx.exposures, fx.affinities)


@query("p3_exposure_home_locations", f"""
    select frame_id, round(lon,4) as lon, round(lat,4) as lat, viewability, cdl_city, cel_city, cel_zip, cdl_zip
    from fx_exposures e join fx_common_locations c on c.device_hash=e.device_hash where {_FACING}""")
def _(fx):
    return studies.exposure_home_locations(fx.exposures, fx.common_locations)


_ACTIVE = """
    active as (select device_hash, avg(n) as a from (select device_hash, core_date, count(*) as n from fx_pings
               where device_hash in (select device_hash from fx_exposures) group by all) q group by 1 having avg(n) > 8)"""


def _active(fx) -> DataFrame:
    return studies.high_activity_devices(fx.pings, fx.exposures, start=P_START, end=P_END, min_avg=8)


@query("p4_high_activity_devices", f"with {_ACTIVE} select device_hash, round(a,4) as avg_daily_pings from active")
def _(fx):
    return _active(fx)


@query("p5_sample_devices", """
    select device_hash from (select distinct device_hash from fx_exposures) q order by md5(concat_ws(':', device_hash, '0')), device_hash limit 50""")
def _(fx):
    return studies.sample_devices(fx.exposures, 50)


@query("p6_poi_dwell", f"""
    select device_hash, poi_id, poi_name, round(avg(cast(round(d) as int)),4) as avg_distance_m, count(*) as nearby_pings
    from (select device_hash, poi_id, poi_name, {hav('lat', 'lon', 'poi_lat', 'poi_lon')} as d from fx_pings, fx_pois
          where device_hash in (select device_hash from fx_exposures)) q
    where d <= 15 group by all having count(*) >= 5""")
def _(fx):
    return studies.poi_dwell(fx.pings, fx.exposures, fx.pois, start=P_START, end=P_END)


@query("p7_poi_visitor_trails", f"""
    with {_ACTIVE},
    near as (select distinct device_hash, poi_name from fx_pings, fx_pois
             where {hav('lat', 'lon', 'poi_lat', 'poi_lon')} <= 15 and device_hash in (select device_hash from active)
               and device_hash in (select device_hash from fx_exposures))
    select p.device_hash, round(lat,4) as lat, round(lon,4) as lon, unix_ts, poi_name from fx_pings p join near n on n.device_hash=p.device_hash""")
def _(fx):
    return studies.poi_visitor_trails(fx.pings, fx.exposures, _active(fx), fx.pois, start=P_START, end=P_END)


_CONV = f"""
    conv as (select device_hash, lat as device_lat, lon as device_lon, unix_ts as device_ts, d from
             (select *, {hav('lat', 'lon', VENUE_LAT, VENUE_LON)} as d from fx_pings) q where d <= {CONVERSION_M})"""
_RING = f"""
    ring as (select min(inventory_id) as frame_id, arg_min(geopath_id, inventory_id) as geopath_id, lat, lon from
             (select *, {hav('lat', 'lon', VENUE_LAT, VENUE_LON)} as d from fx_inventory where inventory_type='billboards' and geopath_id is not null) q
             where d >= 1609.34 and d < 4828.02 group by lat, lon)"""
_TOP = """
    top as (select e.frame_id, geopath_id, r.lat, r.lon, count(distinct e.device_hash) as n from fx_exposures e join ring r on r.frame_id=e.frame_id
            where e.device_hash in (select device_hash from conv) group by all order by n desc, e.frame_id limit 10)"""
_EXPOSED = """
    exposed as (select e.frame_id, geopath_id, t.lat as frame_lat, t.lon as frame_lon, device_hash, device_time as exposed_ts, viewability, match_info, c14, c17
                from fx_exposures e join top t on t.frame_id=e.frame_id)"""
_CONTROL = """
    cand as (select distinct device_hash from fx_pings where c17 in (select c17 from exposed) and device_hash not in (select device_hash from exposed)),
    chosen as (select device_hash from (select device_hash, row_number() over (order by device_hash) as rn from cand) q
               where rn <= (select count(distinct device_hash) from exposed)),
    control as (select p.device_hash, lat, lon, unix_ts, c14 from fx_pings p join chosen c on c.device_hash=p.device_hash)"""


def _conversions(fx) -> DataFrame:
    return studies.poi_conversions(fx.pings, VENUE_LAT, VENUE_LON, CONVERSION_M, start=P_START, end=P_END)


def _ring(fx) -> DataFrame:
    return studies.ring_inventory(fx.inventory, VENUE_LAT, VENUE_LON)


def _top(fx) -> DataFrame:
    return studies.top_converting_frames(fx.exposures, _ring(fx), _conversions(fx), start=E_START, end=E_END)


def _exposed(fx) -> DataFrame:
    return studies.exposed_devices(fx.exposures, _top(fx), start=E_START, end=E_END)


def _stored(fx, df: DataFrame, name: str) -> DataFrame:
    """A stage result as a table, for the later stages that read it several times."""
    return save_table(df, new_path(fx.spark, name))


def _control(fx) -> DataFrame:
    return studies.control_group(fx.pings, _stored(fx, _exposed(fx), "exposed"), start=P_START, end=P_END)


@query("p8_poi_conversions", f"""
    with {_CONV} select device_hash, round(device_lat,4) as device_lat, round(device_lon,4) as device_lon, device_ts, round(d,4) as distance_meters from conv""")
def _(fx):
    return _conversions(fx)


@query("p9_ring_inventory", f"with {_RING} select frame_id, geopath_id, round(lat,4) as lat, round(lon,4) as lon from ring")
def _(fx):
    return _ring(fx)


@query("p10_top_converting_frames", f"with {_CONV}, {_RING}, {_TOP} select frame_id, geopath_id, round(lat,4) as lat, round(lon,4) as lon, n as converted_devices from top")
def _(fx):
    return _top(fx)


@query("p11_exposed_devices", f"""
    with {_CONV}, {_RING}, {_TOP}, {_EXPOSED}
    select frame_id, geopath_id, round(frame_lat,4) as frame_lat, round(frame_lon,4) as frame_lon, device_hash, exposed_ts, viewability, match_info, c14, c17 from exposed""")
def _(fx):
    return _exposed(fx)


@query("p12_control_group", f"""
    with {_CONV}, {_RING}, {_TOP}, {_EXPOSED}, {_CONTROL}
    select device_hash, round(lat,4) as lat, round(lon,4) as lon, unix_ts, strftime(to_timestamp(unix_ts) at time zone 'UTC', '%H:%M:%S') as time_only,
           strftime(to_timestamp(unix_ts) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as full_timestamp, c14 from control""")
def _(fx):
    return _control(fx).withColumn("full_timestamp", F.col("full_timestamp").cast("string"))


def _rate(group: str) -> str:
    return f"""
    g as (select count(distinct device_hash)/10e0 as total, (select count(distinct device_hash) from conv where device_hash in (select device_hash from {group})) as n from {group})
    select round(total,4) as total_devices, n as converted_devices, round(n/total*100,4) as conversion_rate from g"""


@query("p13_conversion_rate_control", f"with {_CONV}, {_RING}, {_TOP}, {_EXPOSED}, {_CONTROL}, {_rate('control')}")
def _(fx):
    return studies.conversion_rate_control(_control(fx), _conversions(fx))


@query("p13_conversion_rate_exposed", f"with {_CONV}, {_RING}, {_TOP}, {_EXPOSED}, {_rate('exposed')}")
def _(fx):
    return studies.conversion_rate_exposed(_exposed(fx), _conversions(fx))


@query("p14_exposed_vs_converted", f"""
    with {_CONV}, {_RING}, {_TOP}, {_EXPOSED},
    f as (select *, row_number() over (partition by device_hash order by exposed_ts, frame_id, {_number('MATCH_ANGLE_DEGREE')}, {_number('MATCH_DISTANCE_METER')}, viewability) as rn from exposed)
    select f.device_hash, {_number('MATCH_ANGLE_DEGREE')} as match_angle_degree, {_number('MATCH_DISTANCE_METER')} as match_distance_meter, viewability, exposed_ts, max(device_ts) as converted_ts
    from f join conv on conv.device_hash=f.device_hash where rn=1 group by all""")
def _(fx):
    return studies.exposed_vs_converted(_exposed(fx), _conversions(fx))


@query("p15_filter_inventory", """
    select inventory_id, inventory_ref, owner_id, market_id, postcode from fx_inventory
    where date_range='Q1_25' and inventory_type||'.'||inventory_subtype in ('billboards.bulletins','billboards.posters','street.posters') and postcode in (70102,70104,70106,70108)""")
def _(fx):
    kinds = ["billboards.bulletins", "billboards.posters", "street.posters"]
    rows = studies.filter_inventory(
        fx.inventory, date_range="Q1_25", postcodes=[70102, 70104, 70106, 70108], inventory_filters=kinds
    )
    return rows.select("inventory_id", "inventory_ref", "owner_id", "market_id", "postcode")


@query("p16_inventory_json_fields", """
    select inventory_id, json_extract_string(ufi_data, '$."4"') as ufi_4, json_extract_string(affinity_data, '$.MARKET.index') as market_index from fx_inventory""")
def _(fx):
    return studies.inventory_json_fields(fx.inventory, {"ufi_4": ("ufi_data", "4"), "market_index": ("affinity_data", "MARKET.index")})


@query("p17_lookup_rows", "select inventory_id, inventory_ref from fx_inventory where inventory_id in (select frame_id from fx_frames where frame_type='STATIC')")
def _(fx):
    wanted = fx.frames.where("frame_type = 'STATIC'").select("frame_id")
    return studies.lookup_rows(fx.inventory, "inventory_id", wanted).select("inventory_id", "inventory_ref")


@query("p18_formatted_count", "select format('{:,}', count(*)) as n from fx_exposures where viewability <> 'DECAYED'")
def _(fx):
    return studies.formatted_count(fx.exposures, F.col("viewability") != "DECAYED")
