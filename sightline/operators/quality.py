"""Comparison of two sources and data-quality statistics."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sightline.functions.scalars import between_dates, div0, in_list, info_field, with_point
from sightline.operators.ordering import beside, exact_percentiles, hash_sample, join_null_safe
from sightline.operators.storage import kept, sized

SEVEN_POINTS = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
FIVE_POINTS = {name: SEVEN_POINTS[name] for name in ("p5", "p25", "p50", "p75", "p95")}


def table_extent(table: DataFrame, start: dt.date | None = None, end: dt.date | None = None, day: str = "core_date") -> DataFrame:
    """First and last day and the number of rows."""
    return table.where(between_dates(day, start, end)).agg(
        F.min(day).alias("first_date"), F.max(day).alias("last_date"), F.count(F.lit(1)).alias("n")
    )


def multiplier_daily_compare(
    mult_a: DataFrame, mult_b: DataFrame, start: dt.date | None = None, end: dt.date | None = None,
    names: tuple[str, str] = ("a", "b"),
) -> DataFrame:
    """Per source and day: cells, mean, median, spread and number of multipliers."""
    def tagged(df: DataFrame, name: str) -> DataFrame:
        return df.where(between_dates("core_date", start, end)).select(
            F.lit(name).alias("source"), "core_date", "cell", F.col("multiplier").cast("double").alias("multiplier")
        )

    rows = kept(tagged(mult_a, names[0]).unionByName(tagged(mult_b, names[1])))
    keys = ["source", "core_date"]
    stats = rows.groupBy(*keys).agg(
        F.countDistinct("cell").alias("unique_cells"), F.avg("multiplier").alias("avg_multiplier"),
        F.stddev("multiplier").alias("std_multiplier"), F.count(F.lit(1)).alias("total_multipliers"),
    )
    return join_null_safe(stats, exact_percentiles(rows, keys, "multiplier", {"median_multiplier": 0.5}), keys)


def sampled_frames(exposures: DataFrame, k: int = 10, exclude_owner=None, seed: int = 0) -> DataFrame:
    """``k`` distinct frames with their coordinates, picked by a seeded hash."""
    rows = exposures if exclude_owner is None else exposures.where(F.col("owner_id") != F.lit(exclude_owner))
    places = rows.select(
        "frame_id",
        info_field(exposures, "match_info", "SITE_LAT").alias("frame_lat"),
        info_field(exposures, "match_info", "SITE_LON").alias("frame_lon"),
    ).distinct()
    return hash_sample(places, k, ["frame_id"], seed)


def totals_compare(
    exp_a: DataFrame, exp_b: DataFrame, start: dt.date | None = None, end: dt.date | None = None,
    names: tuple[str, str] = ("a", "b"),
) -> DataFrame:
    """Rows and distinct (device, point) per day of both sources, and their ratio a / b."""
    def totals(df: DataFrame) -> DataFrame:
        return with_point(df).where(between_dates("core_date", start, end)).groupBy("core_date").agg(
            F.count(F.lit(1)).cast("double").alias("total_matches"),
            F.countDistinct("device_hash", "lat", "lon").cast("double").alias("distinct_devices"),
        )

    def labelled(df: DataFrame, label: str) -> DataFrame:
        return df.select(F.lit(label).alias("source"), "core_date", "total_matches", "distinct_devices")

    a, b = totals(exp_a), totals(exp_b)
    both = a.join(b.withColumnsRenamed({"total_matches": "_t", "distinct_devices": "_d"}), "core_date")
    ratios = both.select(
        "core_date", (F.col("total_matches") / F.col("_t")).alias("total_matches"),
        F.try_divide("distinct_devices", "_d").alias("distinct_devices"),
    )
    return labelled(a, names[0]).unionByName(labelled(b, names[1])).unionByName(labelled(ratios, "ratio"))


def _frame_metrics(df: DataFrame, keys: Sequence[str], start: dt.date | None, end: dt.date | None) -> DataFrame:
    return df.where(between_dates("core_date", start, end)).groupBy(*keys).agg(
        F.countDistinct("device_hash").alias("unique_devices"), F.count(F.lit(1)).alias("total_matches")
    )


def _long(metrics: dict[str, Column]) -> Column:
    """One (metric, ratio) entry per metric, to explode: all metrics then share one pass."""
    return F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("ratio")) for m, v in metrics.items()]))


def frame_ratio_percentiles(
    exp_a: DataFrame, exp_b: DataFrame, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """Percentiles per day of source b of the ratio a / b per frame, for devices and for matches.

    A frame's day in b meets each of the frame's days in a, by the definition of the report.
    Equal values of a frame are counted first, so a pair is (day of b, distinct value of a)
    with a weight, not a pair of days.
    """
    keys = ["frame_id", "core_date"]
    a, b = _frame_metrics(exp_a, keys, start, end), _frame_metrics(exp_b, keys, start, end)

    def ratios(metric: str, column: str) -> DataFrame:
        values = a.groupBy("frame_id", F.col(column).alias("_a")).agg(F.count(F.lit(1)).alias("_n"))
        return (
            b.select("frame_id", "core_date", F.col(column).alias("_b")).join(values, "frame_id")
            .groupBy(F.lit(metric).alias("metric"), "core_date", F.try_divide("_a", "_b").alias("ratio"))
            .agg(F.sum("_n").alias("_n"))
        )

    both = ratios("Unique Devices", "unique_devices").unionByName(ratios("Total Matches", "total_matches"))
    return exact_percentiles(both, ["metric", "core_date"], "ratio", SEVEN_POINTS, "_n")


def null_creative_groups(exposures: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Rows per day that met no creative."""
    return (
        exposures.where(between_dates("core_date", start, end) & F.col("creative_id").isNull())
        .groupBy("core_date").agg(F.count(F.lit(1)).alias("n"))
    )


def market_ratio_summary(
    exp_a: DataFrame, exp_b: DataFrame, markets: DataFrame, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """Median and mean of the daily frame ratios a / b per market name."""
    keys = ["core_date", "market_id", "frame_id"]
    a, b = _frame_metrics(exp_a, keys, start, end), _frame_metrics(exp_b, keys, start, end)
    names = markets.select("market_id", "marketname")
    both = kept(
        a.join(b.withColumnsRenamed({"unique_devices": "_u", "total_matches": "_t"}), keys)
        .withColumn("ratio_unique_devices", F.try_divide("unique_devices", "_u"))
        .withColumn("ratio_total_matches", F.try_divide("total_matches", "_t"))
        .join(sized(names), "market_id", "left")
        .select("marketname", "frame_id", "ratio_unique_devices", "ratio_total_matches")
    )
    report = both.groupBy("marketname").agg(
        F.countDistinct("frame_id").alias("total_frames"),
        F.avg("ratio_unique_devices").alias("avg_ratio_unique_devices"),
        F.avg("ratio_total_matches").alias("avg_ratio_total_matches"),
    )
    columns = ["ratio_unique_devices", "ratio_total_matches"]
    ratios = both.select("marketname", _long({c: F.col(c) for c in columns}).alias("_r")).select("marketname", "_r.*")
    medians = (
        exact_percentiles(ratios, ["marketname", "metric"], "ratio", {"p50": 0.5})
        .groupBy("marketname")
        .agg(*[F.max(F.when(F.col("metric") == c, F.col("p50"))).alias(f"median_{c}") for c in columns])
    )
    return join_null_safe(report, medians, ["marketname"], "left")


def viewability_ratio_percentiles(rollup_a: DataFrame, rollup_b: DataFrame) -> DataFrame:
    """Percentiles per day of the cumulative viewability ratios a / b per frame."""
    lts, ots, cts = (F.col(f"{band}_to_see_matches") for band in ("likely", "opportunity", "chance"))

    def cumulative(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(F.col("matchable_id").alias("frame_id"), "core_date").agg(
            F.sum(lts).alias(f"{tag}_LTS"), F.sum(lts + ots).alias(f"{tag}_OTS"), F.sum(lts + ots + cts).alias(f"{tag}_Gross")
        )

    both = cumulative(rollup_a, "a").join(cumulative(rollup_b, "b"), ["frame_id", "core_date"])
    ratios = {m: div0(F.col(f"a_{m}"), F.col(f"b_{m}")) for m in ("Gross", "OTS", "LTS")}
    rows = both.select("core_date", _long(ratios).alias("_r")).select("core_date", "_r.*")
    return exact_percentiles(rows, ["metric", "core_date"], "ratio", FIVE_POINTS)


def frame_metadata(frames: DataFrame, customers: DataFrame, sites: DataFrame, frame_ids: Sequence | None = None) -> DataFrame:
    """Frames with owner name, site position and the media type of their JSON metadata."""
    owners = customers.select(F.col("customer_id").alias("owner_id"), "customername")
    return (
        frames.where(in_list("frame_id", frame_ids)).drop("site_lat", "site_lon")
        .join(owners, "owner_id", "left").join(sites.select("site_id", "site_lat", "site_lon"), "site_id", "left")
        .select(
            "frame_id", "customername", F.get_json_object("metadata", "$.frameMedia").alias("venue_media_type"),
            "site_lat", "site_lon", "frame_type", "exposition_angle", "exposition_width", "frame_height", "frame_width", "frame_elevation",
        )
    )


def preview(table: DataFrame, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows, in the order of ``by`` when given."""
    return (table.orderBy(*by) if by else table).limit(n)


def demographic_summary(demographics: DataFrame) -> DataFrame:
    """Per device and category: extremes and entropy (bits) of prior and posterior; p = 0 adds nothing."""
    def entropy(column: str) -> Column:
        p = F.col(column)
        return F.sum(F.when(p == 0, 0.0).otherwise(-p * F.log2(F.greatest(p, F.lit(1e-10)))))

    return demographics.groupBy("device_hash", "category").agg(
        *[
            measure(f"{kind}_probability").alias(f"{name}_{kind}_probability")
            for kind in ("prior", "posterior") for name, measure in (("max", F.max), ("min", F.min))
        ],
        entropy("prior_probability").alias("prior_entropy"), entropy("posterior_probability").alias("posterior_entropy"),
    )


def enrichment_report(summary: DataFrame, formatted: bool = False) -> DataFrame:
    """Mean probabilities, entropies and their change, overall first, then by category."""
    means = {
        "max_posterior_probability": F.col("max_posterior_probability"),
        "max_prior_probability": F.col("max_prior_probability"),
        "prior_entropy": F.col("prior_entropy"),
        "posterior_entropy": F.col("posterior_entropy"),
        "probability_change": F.col("max_posterior_probability") - F.col("max_prior_probability"),
        "entropy_reduction": F.col("prior_entropy") - F.col("posterior_entropy"),
    }
    sums = summary.groupBy("category").agg(
        *[F.sum(m).alias(f"s_{name}") for name, m in means.items()],
        *[F.count(m).alias(f"n_{name}") for name, m in means.items()],
    )
    report = sums.rollup("category").agg(
        F.grouping("category").alias("_overall"),
        *[(F.sum(f"s_{name}") / F.sum(f"n_{name}")).alias(name) for name in means],
    )
    report = report.withColumn("category", F.when(F.col("_overall") == 1, "OVERALL").otherwise(F.col("category")))
    report = report.orderBy(F.desc("_overall"), F.desc("probability_change"), "category")

    def text(name: str) -> Column:
        if "entropy" in name:
            return F.format_string("%.3f", F.col(name))
        return F.concat(F.format_string("%.2f", F.col(name) * 100), F.lit("%"))

    return report.select("category", *[text(n).alias(n) if formatted else F.col(n) for n in means])


def affinity_count_distribution(affinities: DataFrame) -> DataFrame:
    """Attributes per device: extremes, mean, spread and percentiles."""
    counts = kept(
        affinities.where(F.col("audience_attribute").isNotNull())
        .groupBy("device_hash").agg(F.count("audience_attribute").alias("n"))
    )
    totals = counts.agg(
        F.max("n").alias("max_attributes"), F.min("n").alias("min_attributes"), F.avg("n").alias("avg_attributes"),
        F.stddev("n").alias("std_attributes"),
    )
    return beside(totals, exact_percentiles(counts, [], "n", FIVE_POINTS))


def row_sample(summary: DataFrame, n: int = 100000, by: Sequence[str] = ("device_hash", "category"), seed: int = 0) -> DataFrame:
    """``n`` rows picked by a seeded hash of the key columns."""
    return hash_sample(summary, n, by, seed)


def distribution_histogram(summary: DataFrame, n_buckets: int = 50, entropy_span: float = 3.0) -> DataFrame:
    """Counts and densities of prior and posterior probability and entropy, overall and by category.

    ``n_buckets`` buckets span the probabilities, whose largest value, 1, belongs to the last. As many
    span ``entropy_span`` bits; entropies have no largest value, and buckets of that width go on as far as they do.
    """
    measures = {
        "max_prior_probability": 1.0, "max_posterior_probability": 1.0,
        "prior_entropy": entropy_span, "posterior_entropy": entropy_span,
    }

    def bucket(name: str, top: float):
        at = F.floor(F.col(name) / (top / n_buckets)) + 1
        return at if name.endswith("entropy") else F.least(at, F.lit(n_buckets))

    bins = [
        F.struct(
            F.lit(name).alias("measure"),
            F.lit(top / n_buckets).alias("width"),
            bucket(name, top).cast("bigint").alias("bucket"),
        )
        for name, top in measures.items()
    ]
    keys = ["measure", "width", "bucket"]
    by_category = (
        summary.select("category", F.explode(F.array(*bins)).alias("at")).select("category", "at.*")
        .groupBy("category", *keys).agg(F.count(F.lit(1)).alias("n"))
    )
    overall = by_category.groupBy(*keys).agg(F.sum("n").alias("n")).select(F.lit("OVERALL").alias("category"), *keys, "n")
    counts = by_category.unionByName(overall)
    totals = counts.groupBy("category", "measure").agg(F.sum("n").alias("_total"))
    return join_null_safe(counts, totals, ["category", "measure"]).select(
        "category", "measure", "bucket", "n", (F.col("n") / F.col("_total") / F.col("width")).alias("density")
    )
