"""Reach, affinity and event queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from sightline.operators import affinity, events, layout, reach, storage
from sightline.operators.ordering import beside
from sightline.plans.blocks import E_END, E_START, EVENT_DAY, LA_HOUR, _UTC_HOUR
from sightline.plans.registry import query
from sightline.plans.sqltext import VENUE_LAT, VENUE_LON, div0, hav, two

MILES = "0.000621371e0"
ATTRS = [("urgent", "Urgent"), ("high", "High"), ("low", "Low")]

_MULT = """
    me as (select e.*, coalesce(m.multiplier,1) as m0, m.multiplier as m, coalesce(m.multiplier,1)*decayed_value as mp_value
           from fx_exposures e left join fx_multiplier m on m.core_date=e.core_date and m.time_bin_1h=e.time_bin_1h and m.c14=e.c14)"""


def _rates(days: str, assets: str, miles: str) -> str:
    out = []
    for name, column in (("ots", "ots"), ("gross", "gross"), ("ots_gross", "both_")):
        out.append(f"round({column}/{days}/{assets},4) as {name}_per_day_per_asset")
        out.append(f"round({column}/{miles},4) as {name}_per_mile")
        if name != "ots_gross":
            out.append(f"round({column}/{miles}/{assets},4) as {name}_per_mile_per_asset")
    return ", ".join(out)


_SUMS = """sum(case when viewability='OPPORTUNITY_TO_SEE' then mp_value else 0 end) as ots, sum(mp_value) as gross,
    (sum(case when viewability='OPPORTUNITY_TO_SEE' then mp_value else 0 end)+sum(mp_value))/2 as both_,
    count(*) as matched, count(distinct asset_id) as assets"""


@query("r1_impressions_total", f"""
    with {_MULT},
    own as (select * from me where owner_id=1 and market_id<>4),
    f as (select {_SUMS}, count(distinct market_id) as markets from own),
    d as (select avg(n) as days from (select asset_id, count(distinct core_date) as n from own group by asset_id) q),
    p as (select sum(path_length)*{MILES} as miles from fx_paths where owner_id=1 and market_id<>4)
    select round(ots,4) as impressions_ots, round(gross,4) as impressions_gross, round(both_,4) as avg_ots_gross, matched as matched_exposures,
           assets as unique_assets, markets, round(days,4) as avg_days_active, round(miles,4) as total_miles, {_rates('days', 'assets', 'miles')},
           round(miles/614,4) as miles_per_asset from f, d, p""")
def _(fx):
    return reach.impressions_total(fx.exposures, fx.multiplier, fx.paths, 1, E_START, E_END, exclude_markets=[4])


@query("r2_impressions_by_market", f"""
    with {_MULT},
    own as (select * from me where owner_id=2 and market_id<>3),
    f as (select market_id, {_SUMS}, count(distinct device_hash) as devices from own group by market_id),
    d as (select market_id, avg(n) as days from (select market_id, asset_id, count(distinct core_date) as n from own group by all) q group by 1),
    p as (select market_id, sum(miles) as miles, avg(miles) as per_asset, count(*) as with_paths, sum(secs)/3600 as hours, avg(secs)/3600 as asset_hours
          from (select market_id, asset_id, sum(path_length)*{MILES} as miles, sum(end_time-start_time) as secs from fx_paths
                where owner_id=2 and market_id<>3 group by all) q group by 1)
    select f.market_id, round(ots,4) as impressions_ots, round(gross,4) as impressions_gross, round(both_,4) as avg_ots_gross, matched as matched_exposures,
           assets as unique_assets, devices as unique_devices, round(days,4) as avg_days_active, round(miles,4) as total_miles,
           round(per_asset,4) as miles_per_asset, with_paths as assets_with_paths, round(hours,4) as total_hours, round(asset_hours,4) as hours_per_asset,
           {_rates('days', 'assets', 'miles')}
    from f left join d on d.market_id=f.market_id left join p on p.market_id=f.market_id""")
def _(fx):
    return reach.impressions_by_market(fx.exposures, fx.multiplier, fx.paths, 2, E_START, E_END, exclude_markets=[3])


def _campaign_rates() -> str:
    names = ("impressions_ots", "impressions_gross", "avg_ots_gross")
    return ", ".join(
        f"{n}, round({n}/miles,4) as {n}_per_mile, round({n}/cast(unique_assets as double)/days,4) as {n}_per_asset_per_day" for n in names
    )


@query("r3_campaign_metrics", f"""
    with s as (select campaign_id, count(distinct core_date) as days, count(distinct matchable_id) as unique_assets,
                      cast(round(sum(impressions_ots)) as bigint) as impressions_ots, cast(round(sum(impressions_gross)) as bigint) as impressions_gross,
                      cast(round((sum(impressions_ots)+sum(impressions_gross))/2) as bigint) as avg_ots_gross from fx_hourly group by 1),
    p as (select campaign_id, sum(coverage_distance_meter)*{MILES} as miles from fx_hourly group by 1)
    select s.campaign_id, campaignref, days, unique_assets, round(miles,4) as total_miles, {_campaign_rates()}
    from s join p on p.campaign_id=s.campaign_id left join fx_campaigns c on c.campaign_id=s.campaign_id""")
def _(fx):
    return reach.campaign_metrics(fx.hourly, fx.hourly, fx.campaigns, start=E_START, end=E_END)


_UFI = ", ".join(f"format('{{:,}}', cast({m} as bigint)) as {m}" for m in reach.UFI_MEASURES)


@query("r4_ufi_campaign", f"select campaign_id, {_UFI} from fx_ufi")
def _(fx):
    return reach.ufi_campaign(fx.ufi)


@query("r5_ufi_adgroup", f"select adgroup_id, flightref, {_UFI} from fx_ufi left join fx_flights on flightid=adgroup_id")
def _(fx):
    return reach.ufi_adgroup(fx.ufi, fx.flights)


@query("r6_market_population", "select marketid, cast(json_extract_string(marketmetrics, '$.marketpop') as double) as marketpop from fx_markets")
def _(fx):
    return reach.market_population(fx.markets)


@query("r7_monthly_reach", f"""
    with {_MULT},
    x as (select date_trunc('month', core_date) as month, device_hash, avg(coalesce(m*decayed_value,1)) as w from me where owner_id=1 and market_id<>2 group by all),
    p as (select date_trunc('month', core_date) as month, sum(path_length)*{MILES} as miles from fx_paths where owner_id=1 and market_id<>2 group by 1),
    s as (select month, sum(w) as r, count(distinct device_hash) as n from x group by month)
    select cast(cast(s.month as date) as varchar) as month, round(r,4) as monthly_reach, n as unique_devices, round(miles,4) as total_miles from s left join p on p.month=s.month""")
def _(fx):
    report = reach.monthly_reach(fx.exposures, fx.multiplier, fx.paths, 1, E_START, E_END, exclude_markets=[2])
    return report.withColumn("month", F.col("month").cast("string"))


@query("r8_marginal_reach", f"""
    with {_MULT},
    b as (select count(distinct device_hash) as bd, sum(mp_value) as bw from me where provider='F'),
    a as (select count(distinct device_hash) as ad, coalesce(sum(mp_value),0) as aw from me
          where provider='O' and device_hash not in (select device_hash from me where provider='F'))
    select bd as base_devices, round(bw,4) as base_weighted_reach, ad as marginal_devices, round(aw,4) as marginal_weighted_reach,
           bd+ad as combined_devices, round(bw+aw,4) as combined_weighted_reach,
           {two('cast(ad as double)/bd*100')} as device_lift_pct, {two('aw/bw*100')} as weighted_lift_pct,
           {two('cast(ad as double)/(bd+ad)*100')} as marginal_device_share_pct, {two('aw/(bw+aw)*100')} as marginal_weighted_share_pct from a, b""")
def _(fx):
    first, second = fx.exposures.where("provider = 'F'"), fx.exposures.where("provider = 'O'")
    return reach.marginal_reach(first, second, fx.multiplier, start=E_START, end=E_END)


def _sketches(fx, provider: str) -> DataFrame:
    """Daily sketches of a provider's devices per market, stored by day and read back."""
    path = storage.new_path(fx.spark, "reach-sketches")
    reach.write_reach_sketches(reach.daily_reach_sketches(fx.exposures.where(F.col("provider") == provider)), path)
    return fx.spark.read.parquet(path)


def _close(estimate, exact):
    """Within five standard errors of the sketches."""
    return F.abs(estimate - exact) <= F.ceil(exact * (5 * 1.04 / 2 ** (reach.SKETCH_LG_K / 2)))


@query("r7_reach_from_sketches", """
    select cast(cast(date_trunc('month', core_date) as date) as varchar) as month, count(distinct device_hash) as unique_devices,
           count(*) as exposures, true as estimate_is_close from fx_exposures where provider='F' group by 1""")
def _(fx):
    month = F.trunc("core_date", "month").cast("string").alias("month")
    estimated = reach.reach_from_sketches(_sketches(fx, "F"), [month])
    exact = fx.exposures.where("provider = 'F'").groupBy(month).agg(F.countDistinct("device_hash").alias("unique_devices"))
    return estimated.join(exact, "month").select(
        "month", "unique_devices", "exposures", _close(F.col("devices"), F.col("unique_devices")).alias("estimate_is_close")
    )


@query("r8_marginal_reach_from_sketches", """
    select count(distinct case when provider='F' then device_hash end) as base_devices, count(distinct device_hash) as combined_devices,
           true as estimates_are_close from fx_exposures where provider in ('F', 'O')""")
def _(fx):
    estimated = reach.marginal_reach_from_sketches(_sketches(fx, "F"), _sketches(fx, "O"))
    exact = fx.exposures.where("provider in ('F', 'O')").agg(
        F.countDistinct(F.when(F.col("provider") == "F", F.col("device_hash"))).alias("base"), F.countDistinct("device_hash").alias("both")
    )
    close = _close(F.col("base_devices"), F.col("base")) & _close(F.col("combined_devices"), F.col("both"))
    return beside(estimated, exact).select(
        F.col("base").alias("base_devices"), F.col("both").alias("combined_devices"), close.alias("estimates_are_close")
    )


def _number(key: str) -> str:
    return f"cast(json_extract_string(match_info, '$.{key}') as double)"


def _table(where: str = "true") -> str:
    return f"""{_MULT},
    et as (select core_date, path_id, market_id, asset_id, device_hash, device_time, time_bin_1h, {_number('MATCH_DISTANCE_METER')} as match_distance_meter,
                  {_number('PATH_LENGTH_METER')} as path_length_meter, c14, c17, mp_value, lat, lon from me where {where})"""


_SEEN = "viewability in ('LIKELY_TO_SEE','OPPORTUNITY_TO_SEE')"
_ET = _table()


def _seen(fx) -> DataFrame:
    return reach.exposure_table(fx.exposures, fx.multiplier, start=E_START, end=E_END)


def _all(fx) -> DataFrame:
    return reach.exposure_table(fx.exposures, fx.multiplier, start=E_START, end=E_END, viewability=None)


@query("r9_exposure_table", f"""
    with {_table(_SEEN)}
    select cast(core_date as varchar) as core_date, path_id, market_id, asset_id, device_hash, device_time, time_bin_1h, match_distance_meter,
           path_length_meter, c14, c17, round(mp_value,4) as mp_value, round(lat,4) as lat, round(lon,4) as lon from et""")
def _(fx):
    # Stored by day, as the later reports read it.
    path, seen = storage.new_path(fx.spark, "exposure-table"), _seen(fx)
    reach.write_exposure_table(seen, path)
    return fx.spark.read.parquet(path).select(*seen.columns).withColumn("core_date", F.col("core_date").cast("string"))


def _assets_sql(period: str, least: int) -> str:
    return f"""
    with {_ET}, s as (select device_hash, {period} as period, count(distinct asset_id) as assets from et group by all having count(*) >= {least})
    select round(avg(assets),4) as avg_assets, min(assets) as min_assets, max(assets) as max_assets, count(*) as device_periods,
           round(quantile_cont(assets,0.5),4) as median_assets from s"""


@query("r10_assets_per_device_day", _assets_sql("core_date", 2))
def _(fx):
    return reach.assets_per_device_day(_all(fx), 2)


@query("r11_assets_per_device_week", _assets_sql("date_trunc('week', core_date)", 3))
def _(fx):
    return reach.assets_per_device_week(_all(fx), 3)


@query("r12_assets_per_device_month", _assets_sql("date_trunc('month', core_date)", 4))
def _(fx):
    return reach.assets_per_device_month(_all(fx), 4)


@query("r13_transition_gaps", f"""
    with {_ET},
    s as (select *, lag(asset_id) over w as pa, lag(device_time) over w as pt from et window w as (partition by device_hash order by device_time, asset_id)),
    g as (select device_hash, device_time-pt as gap from s where pa is not null and pa<>asset_id
          and device_hash in (select device_hash from et group by 1 having count(distinct asset_id) >= 5))
    select count(*) as transitions, count(distinct device_hash) as devices, round(avg(gap),4) as avg_seconds, round(avg(gap)/60,4) as avg_minutes,
           round(avg(gap)/3600,4) as avg_hours, round(min(gap)/60e0,4) as min_minutes, round(max(gap)/3600e0,4) as max_hours,
           round(median(gap),4) as median_seconds, round(median(gap)/60,4) as median_minutes, round(median(gap)/3600,4) as median_hours,
           round(quantile_cont(gap,0.25)/3600,4) as p25_hours, round(quantile_cont(gap,0.75)/3600,4) as p75_hours from g""")
def _(fx):
    return reach.transition_gaps(_all(fx), 5)


def _daypart_devices(name: str, first: int, last: int) -> str:
    return f"count(distinct case when {_UTC_HOUR} between {first} and {last} then device_hash end) as {name}_devices"


@query("r14_cell_density", f"""
    with {_ET}
    select c17, count(*) as exposure_count, count(distinct device_hash) as unique_devices, count(distinct asset_id) as unique_assets,
           round(sum(mp_value),4) as total_impressions, count(distinct core_date) as days_active, round(min(lat),4) as lat, round(arg_min(lon,lat),4) as lon,
           {_daypart_devices('morning', 6, 11)}, {_daypart_devices('afternoon', 12, 17)}, {_daypart_devices('evening', 18, 23)},
           round(avg(match_distance_meter),4) as avg_distance_m, cast(min(core_date) as varchar) as first_date, cast(max(core_date) as varchar) as last_date
    from et where c17 is not null group by c17 having count(*) >= 10""")
def _(fx):
    text = {c: F.col(c).cast("string") for c in ("first_date", "last_date")}
    return reach.cell_density(_all(fx)).withColumns(text)


def _part_share(test: str) -> str:
    return two(f"sum(case when {test} then mp_value else 0 end)/sum(mp_value)*100")


@query("r15_daypart_share", f"""
    with {_ET}
    select {_part_share(f'{LA_HOUR} < 11')} as morning_pct, {_part_share(f'{LA_HOUR} between 11 and 17')} as afternoon_pct,
           {_part_share(f'{LA_HOUR} between 18 and 24')} as evening_pct from et where c17 is not null""")
def _(fx):
    return reach.daypart_share(_all(fx))


_PENETRATION = f"""
    with {_ET},
    x as (select distinct et.device_hash, et.market_id, c17, lon, lat, mp_value, marketname from et join fx_markets m on m.market_id=et.market_id),
    a as (select marketname, audience_attribute as affinity, count(distinct x.device_hash) as d, sum(mp_value) as i
          from x join fx_affinities f on f.device_hash=x.device_hash group by all),
    t as (select marketname, count(distinct device_hash) as td, sum(mp_value) as ti from x group by 1)
    select a.marketname, affinity, d as affinity_devices, round(i,4) as affinity_impressions, td as total_devices,
           {two('cast(d as double)/td*100')} as penetration_pct, {two('i/d')} as impressions_per_device, {two('i/ti*100')} as impression_share_pct
    from a join t on t.marketname=a.marketname"""


@query("r16_affinity_penetration", _PENETRATION)
def _(fx):
    return affinity.affinity_penetration(_all(fx), fx.affinities, fx.markets, start=E_START, end=E_END)


_HEATMAP = f"""
    with {_ET}
    select audience_attribute as affinity, c17, round(arg_min(lon,lat),4) as lon, round(min(lat),4) as lat, count(distinct et.device_hash) as unique_devices,
           round(sum(mp_value),4) as total_impressions, {two('avg(mp_value)')} as avg_per_exposure
    from et join fx_affinities f on f.device_hash=et.device_hash where c17 is not null group by all having count(distinct et.device_hash) >= 5"""


@query("r17_affinity_heatmap", _HEATMAP)
def _(fx):
    return affinity.affinity_heatmap(_all(fx), fx.affinities, start=E_START, end=E_END)


_OVERLAP = f"""
    with {_ET},
    x as (select distinct device_hash, mp_value from et),
    g as (select x.device_hash, max((audience_attribute='urgent')::int) as a, max((audience_attribute='high')::int) as b,
                 max((audience_attribute='low')::int) as c, sum(mp_value) as v
          from x join fx_affinities f on f.device_hash=x.device_hash where audience_attribute in ('urgent','high','low') group by 1),
    n as (select case when a+b+c=3 then 'All 3 Affinities' when a+b=2 then 'Urgent + High' when a+c=2 then 'Urgent + Low' when b+c=2 then 'High + Low'
                      when a=1 then 'Urgent Only' when b=1 then 'High Only' else 'Low Only' end as combination, v from g)
    select combination, count(*) as unique_devices, round(sum(v),4) as total_impressions, {two('avg(v)')} as impressions_per_device,
           {two('count(*)*100e0/(select count(*) from n)')} as audience_pct from n group by 1"""


@query("r18_affinity_overlap", _OVERLAP)
def _(fx):
    return affinity.affinity_overlap(_all(fx), fx.affinities, ATTRS, start=E_START, end=E_END)


_HOURLY = f"""
    with {_ET},
    h as (select audience_attribute as affinity, cast({LA_HOUR} as int) as hour_of_day, sum(mp_value) as i
          from et join fx_affinities f on f.device_hash=et.device_hash group by all)
    select affinity, hour_of_day, round(i,4) as impressions, {two('i/sum(i) over (partition by affinity)*100')} as affinity_pct,
           case when round(i,6)=round(max(i) over (partition by affinity),6) then '{affinity.PEAK}' else '' end as peak_flag from h"""


@query("r19_affinity_hourly", _HOURLY)
def _(fx):
    return affinity.affinity_hourly(_all(fx), fx.affinities)


_INDEX = f"""
    with {_ET},
    r as (select audience_attribute as affinity, count(distinct et.device_hash) as n,
                 count(distinct et.device_hash)*100e0/(select count(distinct device_hash) from et) as rate
          from et join fx_affinities f on f.device_hash=et.device_hash group by 1)
    select affinity, n as devices_reached, {two('rate')} as penetration_pct, {two('rate/55*100', 0)} as affinity_index,
           case when rate/55*100 > 120 then '{affinity.STRONG_OVER}' when rate/55*100 > 100 then '{affinity.OVER}'
                when rate/55*100 < 80 then '{affinity.UNDER}' else '{affinity.PARITY}' end as interpretation from r"""


@query("r20_affinity_index", _INDEX)
def _(fx):
    return affinity.affinity_index(_all(fx), fx.affinities, baseline_rate=55.0)


def _by_device(fx) -> tuple[layout.Bucketed, layout.Bucketed]:
    """The weighted exposures and the affinities, stored by device as a study would store them once."""
    run = uuid.uuid4().hex
    weighted = storage.save_table(_all(fx), storage.new_path(fx.spark, "exposure-table"))
    tables = {f"exposures_{run}": weighted, f"affinities_{run}": fx.affinities}
    stored = layout.store_bucketed(fx.spark, "device_hash", tables)
    return stored[f"exposures_{run}"], stored[f"affinities_{run}"]


@query("r16_affinity_penetration_bucketed", _PENETRATION)
def _(fx):
    return affinity.affinity_penetration(*_by_device(fx), fx.markets, start=E_START, end=E_END)


@query("r17_affinity_heatmap_bucketed", _HEATMAP)
def _(fx):
    return affinity.affinity_heatmap(*_by_device(fx), start=E_START, end=E_END)


@query("r18_affinity_overlap_bucketed", _OVERLAP)
def _(fx):
    return affinity.affinity_overlap(*_by_device(fx), ATTRS, start=E_START, end=E_END)


@query("r19_affinity_hourly_bucketed", _HOURLY)
def _(fx):
    return affinity.affinity_hourly(*_by_device(fx))


@query("r20_affinity_index_bucketed", _INDEX)
def _(fx):
    return affinity.affinity_index(*_by_device(fx), baseline_rate=55.0)


@query("r21_inventory_affinity_index", f"""
    with x as (select device_hash, 'frame' as kind, frame_id as item, market_id from fx_exposures
               union all select device_hash, 'asset', asset_id, market_id from fx_exposures),
    hit as (select device_hash from fx_affinities where audience_attribute='urgent'),
    i as (select market_id, kind, item, {div0('count(hit.device_hash)', 'count(*)')} as share from x left join hit on hit.device_hash=x.device_hash group by all),
    t as (select i.*, case when kind='frame' then f.inventory_type else 'Transit' end as inventory_type from i left join fx_frames f on f.frame_id=item and kind='frame'),
    mk as (select market_id, {div0('count(hit.device_hash)', 'count(distinct p.device_hash)')} as r from fx_pings p left join hit on hit.device_hash=p.device_hash group by 1),
    nat as (select {div0('count(hit.device_hash)', 'count(distinct p.device_hash)')} as r from fx_pings p left join hit on hit.device_hash=p.device_hash),
    g as (select marketname, inventory_type, mk.r as mr, nat.r as nr, {two('avg(share)*100')} as a, count(distinct item) as n
          from t left join fx_markets m on m.market_id=t.market_id left join mk on mk.market_id=t.market_id, nat group by all)
    select marketname, inventory_type, a as avg_affinity_pct, round({div0('a', 'mr')},4) as market_index, round({div0('a', 'nr')},4) as national_index, n as inventory_items from g""")
def _(fx):
    return affinity.inventory_affinity_index(
        fx.exposures, fx.exposures, fx.affinities, fx.pings, fx.frames, fx.markets, "urgent", start=E_START, end=E_END
    )


_NEAR = f"near as (select frame_id from fx_frames where {hav('site_lat', 'site_lon', VENUE_LAT, VENUE_LON)} <= {{r}})"


@query("r22_event_frame_count", f"with {_NEAR.format(r=3000)} select count(*) as exposures from fx_exposures where frame_id in (select frame_id from near)")
def _(fx):
    return events.event_frame_count(fx.exposures, fx.frames, VENUE_LAT, VENUE_LON, 3000, E_START, E_END)


@query("r23_event_weighted_hourly", f"""
    with {_MULT}, {_NEAR.format(r=8000)}
    select cast(core_date as varchar) as core_date, cast(core_date - date '2025-02-09' as int) as relative_day, frame_id, market_id, owner_id,
           device_time - device_time%3600 as summary_hour,
           cast(count(*) filter (viewability='LIKELY_TO_SEE') as double) as freq_lts,
           cast(count(*) filter (viewability in ('LIKELY_TO_SEE','OPPORTUNITY_TO_SEE')) as double) as freq_ots, cast(count(*) as double) as freq_gross,
           round(sum(case when viewability='LIKELY_TO_SEE' then mp_value else 0 end),4) as weight_lts,
           round(sum(case when viewability in ('LIKELY_TO_SEE','OPPORTUNITY_TO_SEE') then mp_value else 0 end),4) as weight_ots, round(sum(mp_value),4) as weight_gross
    from me where frame_id in (select frame_id from near) and core_date between date '2025-01-12' and date '2025-02-23' group by all""")
def _(fx):
    report = events.event_weighted_hourly(fx.exposures, fx.frames, fx.multiplier, EVENT_DAY, VENUE_LAT, VENUE_LON)
    return report.withColumn("core_date", F.col("core_date").cast("string"))
