"""Views that give the test tables the shapes the operators read.

Each view is one SQL text that Spark and DuckDB both run; ``@name`` stands for a test
table or another view. Two spellings differ by engine: ``EPOCH(ts)`` and ``@D0(n)``, the
n-th day after 2025-01-01.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = {"region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"}


def _cell(zoom: int, lat: str = "lat", lon: str = "lon") -> str:
    side = 2**zoom
    return (
        f"((cast({zoom} as bigint) << 52) | (cast(floor(({lon}+180)/360*{side}) as bigint) << 26)"
        f" | cast(floor(({lat}+90)/360*{side}) as bigint))"
    )


def _lat(seed: str) -> str:
    return f"29.95e0+(((({seed})*7919) % 10007)/10007e0-0.5e0)*0.1e0"


def _lon(seed: str) -> str:
    return f"-90.08e0+(((({seed})*6101) % 10007)/10007e0-0.5e0)*0.1e0"


VIEWS = {
    "fx_pings": f"""
        select q.*, cast(floor(unix_ts/3600) as bigint) as time_bin_1h, {_cell(11)} as c11, {_cell(14)} as c14,
               {_cell(17)} as c17, {_cell(20)} as c20
        from (select event_id as ping_id, cast(user_id as string) as device_hash,
                     cast(1735689600 + cast(floor((EPOCH(ts)-1704067200)/4e0) as bigint) as bigint) as unix_ts,
                     cast(@D0(cast(floor((EPOCH(ts)-1704067200)/4e0/86400) as int)) as date) as core_date,
                     {_lat('user_id*2+event_id%2')} as lat, {_lon('user_id*2+event_id%2')} as lon,
                     cast(600+user_id%5 as bigint) as dma_code, cast(user_id%5 as bigint) as market_id,
                     case when event_id%2=0 then 'a' else 'b' end as provider,
                     concat('10.0.0.', cast(user_id%200 as string)) as device_ip, event_type as device_os
              from @events) q""",
    "fx_frames": """
        select cast(p_partkey as bigint) as frame_id, cast(p_partkey%500 as bigint) as site_id,
               cast(p_partkey%3 as bigint) as owner_id, cast(p_partkey%5 as bigint) as market_id,
               cast(p_partkey%6 as bigint) as process_id,
               case when p_size%2=0 then 'STATIC' else 'DIGITAL' end as frame_type,
               cast((p_partkey*37)%360 as double) as exposition_angle, cast(60+p_size as double) as exposition_width,
               cast(case when p_partkey%97=0 then 45 else 3+p_size%10 end as double) as frame_width, cast(2+p_size%5 as double) as frame_height, cast(4+p_size%7 as double) as frame_elevation,
               29.95e0+((((p_partkey%500)*3571) % 10007)/10007e0-0.5e0)*0.1e0 as site_lat,
               -90.08e0+((((p_partkey%500)*4177) % 10007)/10007e0-0.5e0)*0.1e0 as site_lon,
               case p_type when 'LARGE' then 'billboards' when 'SMALL' then 'street' when 'ECONOMY' then 'place' else 'other' end as inventory_type,
               concat('{"frameMedia": "', p_brand, '"}') as metadata
        from @part""",
    "fx_sites": "select distinct site_id, site_lat, site_lon from @fx_frames",
    "fx_process_meta": """
        select cast(r_regionkey as bigint) as process_id, case when r_regionkey=3 then 'YARD' when r_regionkey%2=0 then 'METER' else 'FOOT' end as dimension_unit,
               cast(case when r_regionkey=4 then 0 else 6+r_regionkey end as double) as min_noticing_radial from @region""",
    "fx_adplays": """
        select q.*, cast(@D0(cast(floor((start_epoch-1735689600)/86400e0) as int)) as date) as start_date,
               cast(@D0(cast(floor((end_epoch-1735689600)/86400e0) as int)) as date) as end_date
        from (select o_orderkey as adplay_id, f.site_id, f.frame_id, cast(o_orderkey%20 as bigint) as creative_id,
                     case when o_orderpriority='1-URGENT' then cast(1735689600 as bigint)
                          when o_orderpriority='2-HIGH' and o_orderkey%4=1 then cast(1735689600-200*86400 as bigint)
                          else cast(1735689600+(o_orderkey*977)%648000 as bigint) end as start_epoch,
                     case when o_orderpriority='1-URGENT' then cast(1735689600+8*86400 as bigint)
                          when o_orderpriority='2-HIGH' and o_orderkey%4=1 then cast(1735689600+165*86400 as bigint)
                          when o_orderpriority='3-MEDIUM' then cast(1735689600+(o_orderkey*977)%648000+1 as bigint)
                          else cast(1735689600+(o_orderkey*977)%648000+7200 as bigint) end as end_epoch
              from @orders o join @fx_frames f on f.frame_id = 1 + o.o_orderkey % (select max(p_partkey) from @part)
              where f.frame_type='DIGITAL') q""",
    "fx_exposures": f"""
        select q.*, cast(floor(device_time/3600) as bigint) as time_bin_1h, {_cell(14)} as c14, {_cell(17)} as c17
        from (select cast(o.o_custkey as string) as device_hash, l.l_partkey as frame_id, l.l_suppkey as asset_id,
                     l.l_orderkey as path_id, l.l_linestatus as provider,
                     cast(l.l_suppkey%5 as bigint) as market_id, cast(l.l_partkey%3 as bigint) as owner_id,
                     case when l.l_returnflag='R' then cast(null as bigint) else cast(l.l_suppkey%20 as bigint) end as creative_id,
                     cast(1735689600 + (l.l_orderkey*86413 + l.l_linenumber*3571) % 31536000 as bigint) as device_time,
                     cast(@D0(cast(floor((l.l_orderkey*86413 + l.l_linenumber*3571) % 31536000/86400) as int)) as date) as core_date,
                     case l.l_linenumber%4 when 0 then 'LIKELY_TO_SEE' when 1 then 'OPPORTUNITY_TO_SEE' when 2 then 'CHANCE_TO_SEE' else 'DECAYED' end as viewability,
                     1e0-l.l_discount as decayed_value, l.l_quantity*3e0 as match_distance_meter,
                     concat('{{"MATCH_DISTANCE_METER": ', cast(cast(l.l_quantity*3 as int) as string),
                            ', "MATCH_ANGLE_DEGREE": ', cast((l.l_partkey*37+l.l_linenumber*29)%181 as string),
                            ', "PATH_LENGTH_METER": ', cast(1000+l.l_orderkey%500 as string),
                            ', "SITE_LAT": 29.9', cast(100+l.l_partkey%500 as string),
                            ', "SITE_LON": -90.0', cast(100+l.l_partkey%500 as string), '}}') as match_info,
                     {_lat('l.l_suppkey*7+l.l_linenumber')} as lat, {_lon('l.l_suppkey*7+l.l_linenumber')} as lon
              from @lineitem l join @orders o on o.o_orderkey=l.l_orderkey) q""",
    "fx_multiplier": """
        select core_date, time_bin_1h, c14, c14 as cell, 1e0+(count(*)*7)%13 as multiplier
        from @fx_exposures where viewability <> 'DECAYED' group by core_date, time_bin_1h, c14""",
    "fx_multiplier_b": """
        select core_date, time_bin_1h, c14, c14 as cell, 1e0+(count(*)*11)%17 as multiplier
        from @fx_exposures where viewability <> 'CHANCE_TO_SEE' group by core_date, time_bin_1h, c14""",
    "fx_affinities": """
        select distinct cast(o_custkey as string) as device_hash, lower(substring(o_orderpriority,3)) as audience_attribute from @orders""",
    "fx_paths": """
        select o_orderkey as path_id, cast(1+o_orderkey%50 as bigint) as asset_id, cast((1+o_orderkey%50)%5 as bigint) as market_id,
               cast(o_custkey%3 as bigint) as owner_id, cast(@D0(cast(o_orderkey%365 as int)) as date) as core_date,
               o_totalprice/10e0 as path_length, o_orderkey*1000 as start_time, o_orderkey*1000+600+o_custkey%3000 as end_time
        from @orders""",
    "fx_demographics": """
        select device_hash, category, bucket, pr/sum(pr) over (partition by device_hash,category) as prior_probability,
               po/sum(po) over (partition by device_hash,category) as posterior_probability
        from (select cast(o.o_custkey as string) as device_hash, l.l_returnflag as category, l.l_linenumber as bucket,
                     sum(l.l_quantity) as pr, sum(l.l_extendedprice*(l.l_discount+0.01e0)) as po
              from @lineitem l join @orders o on o.o_orderkey=l.l_orderkey group by o.o_custkey, l.l_returnflag, l.l_linenumber) q""",
    "fx_markets": """
        select cast(r_regionkey as bigint) as market_id, cast(r_regionkey as bigint) as marketid, concat('m-', r_name) as markethash,
               cast(600+r_regionkey as bigint) as dma_code, r_name as marketname,
               concat('{"marketpop": ',cast(5000+1000*r_regionkey as string),'}') as marketmetrics from @region""",
    "fx_pois": f"""
        select s_suppkey as poi_id, s_name as poi_name, {_lat('s_suppkey*2')}+0.0001e0 as poi_lat, {_lon('s_suppkey*2')} as poi_lon from @supplier""",
    "fx_cell_pop": """
        select cell, cast(5 + cell%50 as bigint) as pop from
        (select distinct c14 as cell from @fx_pings union select distinct c11 as cell from @fx_pings) q""",
    "fx_cell_market": """
        select cell, cast(cell%5 as bigint) as market_id from
        (select c17 as cell from @fx_pings union
         select ((cast(17 as bigint) << 52) | ((((c14 >> 26) & 67108863) << 3) << 26) | ((c14 & 67108863) << 3)) as cell from @fx_pings) q""",
    "fx_common_locations": """
        select cast(c_custkey as string) as device_hash, n_name as cdl_city, concat('East ', n_name) as cel_city,
               cast(70000+c_custkey%1000 as string) as cel_zip, cast(71000+c_custkey%1000 as string) as cdl_zip
        from @customer join @nation on n_nationkey=c_nationkey""",
    "fx_inventory": """
        select frame_id as inventory_id, concat('ref-', cast(frame_id as string)) as inventory_ref,
               case when p_brand='Brand#7' then cast(null as bigint) else frame_id+100000 end as geopath_id,
               owner_id, market_id, cast(70100+p_size%10 as bigint) as postcode, inventory_type,
               case when p_size<25 then 'posters' else 'bulletins' end as inventory_subtype, site_lat as lat, site_lon as lon,
               case when p_size%2=0 then 'Q1_25' else 'Q2_25' end as date_range,
               concat('{"1": ', cast(frame_id*3 as string), ', "4": ', cast(frame_id*10 as string), '}') as ufi_data,
               concat('{"MARKET": {"index": ', cast(p_size as string), '}}') as affinity_data
        from @fx_frames join @part on p_partkey=frame_id""",
    "fx_customers": "select cast(r_regionkey as bigint) as customer_id, concat('Owner ', r_name) as customername from @region",
    "fx_hourly": """
        select cast(l_suppkey%25 as bigint) as campaign_id, cast(l_partkey%3 as bigint) as owner_id, l_partkey as matchable_id, l_linestatus as provider,
               cast(@D0(cast(floor((l_orderkey*86413 + l_linenumber*3571) % 31536000/86400) as int)) as date) as core_date,
               l_quantity*2e0 as impressions_ots, l_quantity*5e0+0.25e0 as impressions_gross, l_extendedprice as coverage_distance_meter,
               cast(case when l_returnflag='N' then 0 else l_linenumber end as bigint) as likely_to_see_matches,
               cast(l_quantity as bigint) as opportunity_to_see_matches, cast(l_linenumber*2 as bigint) as chance_to_see_matches
        from @lineitem""",
    "fx_campaigns": "select cast(n_nationkey as bigint) as campaign_id, concat('ref ', n_name) as campaignref from @nation",
    "fx_ufi": """
        select cast(c_nationkey as bigint) as campaign_id,
               cast(c_nationkey*10 + case c_mktsegment when 'BUILDING' then 1 when 'FURNITURE' then 2 when 'MACHINERY' then 3 else 4 end as bigint) as adgroup_id,
               cast(c_nationkey%3 as bigint) as owner_id, count(*) as uniques_ots, count(*)*3 as uniques_gross,
               count(*)*1700 as impressions_ots, count(*)*4100 as impressions_gross, count(*)%7 as frequency_ots, count(*)%11 as frequency_gross
        from @customer group by c_nationkey, c_mktsegment""",
    "fx_flights": "select adgroup_id as flightid, concat('flight ', cast(min(adgroup_id) as string)) as flightref from @fx_ufi where uniques_ots >= 10 group by adgroup_id",
    "fx_weights": "select l_suppkey as call_id, l_partkey as cell from @lineitem",
    "fx_run_log": """
        select s_suppkey as call_id, case when s_nationkey%4=0 then 'START' else 'EXIT' end as call_state,
               concat('{"CALL_ARGUMENTS": {"BASE_START": "2024-07-0', cast(1+s_suppkey%9 as string), '", "BASE_END": "2024-07-30", "TEMP": 0.4, "K": ',
                      cast(1+s_suppkey%3 as string), ', "DMA_LIST": [803]}}') as call_info,
               cast(@D0(cast(s_suppkey%30 as int)) as timestamp) as log_time from @supplier""",
    "fx_raw_pings": """
        select device_hash as device_id, unix_ts, lat, lon, cast(1 as int) as datasource_id, cast(10+market_id as int) as accuracy,
               device_ip, 'agent' as user_agent, cast(market_id as int) as publisher_id, 'make' as make, device_os as os, '17' as os_version,
               'IAB1' as categories, 'USA' as country_code, concat('m-', cast(market_id as string)) as market_hash from @fx_pings""",
}

_NAME = re.compile(r"@(\w+)\b(?!\()")


def _engine_text(sql: str, engine: str) -> str:
    if engine == "spark":
        return sql.replace("EPOCH(ts)", "unix_timestamp(ts)").replace("@D0(", "date_add(date'2025-01-01', ")
    return sql.replace("EPOCH(ts)", "cast(floor(epoch(ts)) as bigint)").replace("@D0(", "(date '2025-01-01' + ")


class Fixtures:
    """The test tables and views of one folder, as attributes: ``fx.pings`` is view fx_pings."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def _inline(self, sql: str) -> str:
        def source(match: re.Match) -> str:
            name = match.group(1)
            if name in TABLES:
                return f"parquet.`{self.sf_dir}/{name}.parquet`"
            return f"({self._inline(VIEWS[name])})"

        return _NAME.sub(source, _engine_text(sql, "spark"))

    def sql(self, sql: str) -> DataFrame:
        return self.spark.sql(self._inline(sql))

    def __getattr__(self, name: str) -> DataFrame:
        if f"fx_{name}" in VIEWS:
            return self.sql(VIEWS[f"fx_{name}"])
        raise AttributeError(name)


def oracle(body: str) -> str:
    """A query over view names as one DuckDB statement, its views as common table expressions."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name not in ordered:
                need(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    need(body)
    views = [f"{name} as materialized ({_NAME.sub(lambda m: m.group(1), _engine_text(VIEWS[name], 'duckdb'))})" for name in ordered]
    text = body.strip()
    if text.lower().startswith("with recursive "):
        return f"with recursive {', '.join(views)}{',' if views else ''} {text[15:]}"
    if text.lower().startswith("with "):
        return f"with {', '.join(views)}{',' if views else ''} {text[5:]}"
    return f"with {', '.join(views)} {text}" if views else text
