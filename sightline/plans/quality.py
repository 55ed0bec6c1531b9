"""Source comparison and data-quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sightline.operators import quality
from sightline.plans.blocks import E_END, E_START
from sightline.plans.registry import query
from sightline.plans.sqltext import div0, two

# The two sources compared are the two providers of the exposures.
_A, _B = "provider='F'", "provider='O'"


def _sources(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(_A), df.where(_B)


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("core_date", F.col("core_date").cast("string"))


@query("q1_table_extent", "select cast(min(core_date) as varchar) as first_date, cast(max(core_date) as varchar) as last_date, count(*) as n from fx_exposures")
def _(fx):
    extent = quality.table_extent(fx.exposures, E_START, E_END)
    return extent.withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


def _daily(name: str, table: str) -> str:
    return f"""select '{name}' as source, cast(core_date as varchar) as core_date, count(distinct cell) as unique_cells, round(avg(multiplier),4) as avg_multiplier,
        round(median(multiplier),4) as median_multiplier, round(stddev(multiplier),4) as std_multiplier, count(*) as total_multipliers from {table} group by core_date"""


@query("q2_multiplier_daily_compare", f"{_daily('a', 'fx_multiplier')} union all {_daily('b', 'fx_multiplier_b')}")
def _(fx):
    return _dated(quality.multiplier_daily_compare(fx.multiplier, fx.multiplier_b, E_START, E_END))


@query("q3_random_frames", """
    select * from (select distinct frame_id, cast(json_extract_string(match_info, '$.SITE_LAT') as double) as frame_lat,
           cast(json_extract_string(match_info, '$.SITE_LON') as double) as frame_lon from fx_exposures where owner_id <> 2) q
    order by md5(concat_ws(':', frame_id, '0')), frame_id limit 10""")
def _(fx):
    return quality.sampled_frames(fx.exposures, 10, exclude_owner=2)


def _totals(where: str) -> str:
    return f"""(select core_date, count(*) as t, count(distinct concat_ws(',', device_hash, lat, lon)) as d from fx_exposures where {where} group by 1)"""


@query("q4_totals_compare", f"""
    with a as {_totals(_A)}, b as {_totals(_B)}
    select 'a' as source, cast(core_date as varchar) as core_date, cast(t as double) as total_matches, cast(d as double) as distinct_devices from a
    union all select 'b', cast(core_date as varchar), t, d from b
    union all select 'ratio', cast(a.core_date as varchar), round(a.t/cast(b.t as double),4), round(a.d/cast(b.d as double),4) from a join b on b.core_date=a.core_date""")
def _(fx):
    a, b = _sources(fx.exposures)
    return _dated(quality.totals_compare(a, b, E_START, E_END))


def _points(column: str, points: dict[str, float]) -> str:
    return ", ".join(f"{two(f'quantile_cont({column},{p})', 4)} as {name}" for name, p in points.items())


def _frames(where: str, keys: str) -> str:
    return f"(select {keys}, count(distinct device_hash) as u, count(*) as t from fx_exposures where {where} group by all)"


@query("q5_frame_ratio_percentiles", f"""
    with a as {_frames(_A, 'frame_id, core_date')}, b as {_frames(_B, 'frame_id, core_date')},
    j as (select b.core_date, a.u/cast(b.u as double) as ru, a.t/cast(b.t as double) as rt from b join a on a.frame_id=b.frame_id)
    select 'Unique Devices' as metric, cast(core_date as varchar) as core_date, {_points('ru', quality.SEVEN_POINTS)} from j group by core_date
    union all select 'Total Matches', cast(core_date as varchar), {_points('rt', quality.SEVEN_POINTS)} from j group by core_date""")
def _(fx):
    a, b = _sources(fx.exposures)
    return _dated(quality.frame_ratio_percentiles(a, b, E_START, E_END))


@query("q6_null_creative_groups", "select cast(core_date as varchar) as core_date, count(*) as n from fx_exposures where creative_id is null group by 1")
def _(fx):
    return _dated(quality.null_creative_groups(fx.exposures, E_START, E_END))


@query("q7_market_ratio_summary", f"""
    with a as {_frames(_A, 'frame_id, core_date, market_id')}, b as {_frames(_B, 'frame_id, core_date, market_id')},
    j as (select a.market_id, a.frame_id, a.u/cast(b.u as double) as ru, a.t/cast(b.t as double) as rt
          from b join a on a.frame_id=b.frame_id and a.core_date=b.core_date and a.market_id=b.market_id)
    select marketname, count(distinct frame_id) as total_frames, round(median(ru),4) as median_ratio_unique_devices, round(avg(ru),4) as avg_ratio_unique_devices,
           round(median(rt),4) as median_ratio_total_matches, round(avg(rt),4) as avg_ratio_total_matches
    from j left join fx_markets m on m.market_id=j.market_id group by marketname""")
def _(fx):
    a, b = _sources(fx.exposures)
    return quality.market_ratio_summary(a, b, fx.markets, E_START, E_END)


def _cumulative(where: str) -> str:
    lts, ots, cts = (f"{x}_to_see_matches" for x in ("likely", "opportunity", "chance"))
    return f"""(select matchable_id, core_date, sum({lts}) as l, sum({lts}+{ots}) as o, sum({lts}+{ots}+{cts}) as c from fx_hourly where {where} group by all)"""


def _banded(label: str, column: str) -> str:
    return f"select '{label}' as metric, cast(core_date as varchar) as core_date, {_points(column, quality.FIVE_POINTS)} from j group by core_date"


@query("q8_viewability_ratio_percentiles", f"""
    with a as {_cumulative(_A)}, b as {_cumulative(_B)},
    j as (select a.core_date, {div0('a.l', 'b.l')} as rl, {div0('a.o', 'b.o')} as ro, {div0('a.c', 'b.c')} as rc
          from a join b on b.matchable_id=a.matchable_id and b.core_date=a.core_date)
    {_banded('Gross', 'rc')} union all {_banded('OTS', 'ro')} union all {_banded('LTS', 'rl')}""")
def _(fx):
    a, b = _sources(fx.hourly)
    return _dated(quality.viewability_ratio_percentiles(a, b))


@query("q9_frame_metadata", """
    select frame_id, customername, json_extract_string(metadata, '$.frameMedia') as venue_media_type, round(s.site_lat,4) as site_lat, round(s.site_lon,4) as site_lon,
           frame_type, exposition_angle, exposition_width, frame_height, frame_width, frame_elevation
    from fx_frames f left join fx_customers c on c.customer_id=f.owner_id left join fx_sites s on s.site_id=f.site_id""")
def _(fx):
    return quality.frame_metadata(fx.frames, fx.customers, fx.sites)


@query("q10_preview", "select frame_id, site_id, frame_type from fx_frames order by frame_id limit 10")
def _(fx):
    return quality.preview(fx.frames.select("frame_id", "site_id", "frame_type"), 10, ["frame_id"])


def _entropy(p: str) -> str:
    return f"coalesce(sum(-{p}*log2(greatest(nullif({p},0),1e-10))),0)"


_SUMMARY = f"""
    s as (select device_hash, category, max(prior_probability) as max_prior_probability, min(prior_probability) as min_prior_probability,
                 max(posterior_probability) as max_posterior_probability, min(posterior_probability) as min_posterior_probability,
                 {_entropy('prior_probability')} as prior_entropy, {_entropy('posterior_probability')} as posterior_entropy
          from fx_demographics group by all)"""
_MEASURES = ["max_prior_probability", "min_prior_probability", "max_posterior_probability", "min_posterior_probability", "prior_entropy", "posterior_entropy"]
_ROUNDED = ", ".join(f"round({m},4)+0e0 as {m}" for m in _MEASURES)


def _summary(fx) -> DataFrame:
    return quality.demographic_summary(fx.demographics)


@query("q11_demographic_summary", f"with {_SUMMARY} select device_hash, category, {_ROUNDED} from s")
def _(fx):
    return _summary(fx)


_REPORT = f"""
    {_SUMMARY},
    r as (select category, avg(max_posterior_probability) as po, avg(max_prior_probability) as pr, avg(prior_entropy) as e0, avg(posterior_entropy) as e1,
                 avg(max_posterior_probability-max_prior_probability) as dp, avg(prior_entropy-posterior_entropy) as de
          from (select * from s union all select * replace ('OVERALL' as category) from s) q group by category)"""


@query("q12_enrichment_report", f"""
    with {_REPORT}
    select category, round(po,4) as max_posterior_probability, round(pr,4) as max_prior_probability, round(e0,4) as prior_entropy, round(e1,4) as posterior_entropy,
           round(dp,4)+0e0 as probability_change, round(de,4)+0e0 as entropy_reduction from r""")
def _(fx):
    return quality.enrichment_report(_summary(fx))


@query("q12_enrichment_report_formatted", f"""
    with {_REPORT}
    select category, printf('%.2f%%', po*100) as max_posterior_probability, printf('%.2f%%', pr*100) as max_prior_probability, printf('%.3f', e0) as prior_entropy,
           printf('%.3f', e1) as posterior_entropy, printf('%.2f%%', dp*100) as probability_change, printf('%.3f', de) as entropy_reduction from r""")
def _(fx):
    return quality.enrichment_report(_summary(fx), formatted=True)


@query("q13_affinity_count_distribution", f"""
    with b as (select device_hash, count(audience_attribute) as n from fx_affinities where audience_attribute is not null group by 1)
    select max(n) as max_attributes, min(n) as min_attributes, round(avg(n),4) as avg_attributes, round(stddev(n),4) as std_attributes, {_points('n', quality.FIVE_POINTS)} from b""")
def _(fx):
    return quality.affinity_count_distribution(fx.affinities)


@query("q14_row_sample", f"""
    with {_SUMMARY} select device_hash, category, {_ROUNDED} from s order by md5(concat_ws(':', device_hash, category, '0')), device_hash, category limit 1000""")
def _(fx):
    return quality.row_sample(_summary(fx), 1000)


_TOPS = {"max_prior_probability": "1e0", "max_posterior_probability": "1e0", "prior_entropy": "3e0", "posterior_entropy": "3e0"}
_LONG = " union all ".join(f"select category, '{m}' as measure, {m} as v, {top}/50 as width from s" for m, top in _TOPS.items())


@query("q15_distribution_histogram", f"""
    with {_SUMMARY},
    l as (select category, measure, width, case when measure like '%entropy' then cast(floor(v/width) as bigint)+1
                 else least(cast(floor(v/width) as bigint)+1, 50) end as bucket from ({_LONG}) q),
    c as (select category, measure, width, bucket, count(*) as n from (select * from l union all select * replace ('OVERALL' as category) from l) q group by all)
    select category, measure, bucket, n, round(n/cast(sum(n) over (partition by category, measure) as double)/width,4) as density from c""")
def _(fx):
    return quality.distribution_histogram(_summary(fx))
