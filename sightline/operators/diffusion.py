"""Stochastic smoothing of ping density: hops to neighbouring cells drawn from a clean baseline."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline.functions.cells import cell, cell_child, cell_lat, cell_lon, child_count, grid_disk
from sightline.functions.scalars import between_dates, equals, in_list, ratio, uniform
from sightline.operators.ordering import join_null_safe
from sightline.operators.storage import kept, sized, write_partitions

REGION = ["market_id", "c14"]
SOURCE = [*REGION, "src"]
FINE_ZOOM, CHILD_ZOOM = 20, 24
# Parts of a guide table: a power of two, so that where a part begins is an exact number.
GUIDE = 32


def stage_region(
    pings: DataFrame, day: dt.date | None = None, cells: Sequence[int] | DataFrame | None = None,
    dma_code: int | None = None, provider: str | None = None, ingest_date: dt.date | None = None,
    id_columns: Sequence[str] = ("device_hash", "unix_ts", "lat", "lon", "c14"), id_column: str | None = None,
) -> DataFrame:
    """The pings to smooth, with their fine cell ``src`` and a row id: ``id_column`` if the
    table has one, else a hash of ``id_columns``.

    Copies share an id, hence every draw, and so move together; they are told from a hash
    collision by their source cell, which is part of the key from here on.
    """
    rows = pings.where(equals("dma_code", dma_code) & equals("provider", provider))
    if day is not None:
        rows = rows.where(F.col("core_date") == F.lit(day))
    if ingest_date is not None:
        rows = rows.where(F.to_date("ingestion_time") == F.lit(ingest_date))
    if isinstance(cells, DataFrame):
        rows = rows.join(sized(cells.select("c14").distinct()), "c14", "left_semi")
    else:
        rows = rows.where(in_list("c14", cells))
    return rows.withColumn("src", cell(F.col("lat"), F.col("lon"), FINE_ZOOM)).withColumn(
        "row_id", F.col(id_column) if id_column else F.xxhash64(*id_columns)
    )


def baseline_weights(
    pings: DataFrame, start: dt.date, end: dt.date, dma_code: int | None = None, cells: Sequence[int] | None = None
) -> DataFrame:
    """Pings per (market, region cell, fine cell) over the clean period."""
    wanted = between_dates("core_date", start, end) & equals("dma_code", dma_code) & in_list("c14", cells)
    return (
        pings.where(wanted)
        .withColumn("c20", cell(F.col("lat"), F.col("lon"), FINE_ZOOM))
        .groupBy(*REGION, "c20")
        .agg(F.count(F.lit(1)).alias("w"))
    )


def cell_probability(weights: DataFrame) -> DataFrame:
    """Share of each fine cell inside its (market, region cell)."""
    totals = weights.groupBy(*REGION).agg(F.sum("w").alias("_total"))
    return weights.join(totals, REGION).withColumn("p", ratio(F.col("w"), F.col("_total"))).drop("_total")


def neighbour_pairs(weights: DataFrame, k: int = 2, exclude_center: bool = True) -> DataFrame:
    """Every baseline cell with each cell of its disk: (2k+1)^2 rows per source, less the centre."""
    sources = weights.select(*REGION, F.col("c20").alias("src")).distinct()
    return sources.withColumn("nbr", F.explode(grid_disk(F.col("src"), k, FINE_ZOOM, exclude_center)))


def neighbour_cdf(pairs: DataFrame, probability: DataFrame, eps: float = 1e-6, temp: float = 0.2) -> DataFrame:
    """Cumulative hop probability per source in the order of the neighbour id.

    Each window holds one source's disk, a fixed number of rows.
    """
    p = probability.select(*REGION, F.col("c20").alias("nbr"), "p")
    disk = Window.partitionBy(*SOURCE)
    upto = disk.orderBy("nbr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    floored = F.greatest(F.coalesce("p", F.lit(0.0)) + eps, F.lit(eps))
    return (
        pairs.join(p, [*REGION, "nbr"], "left")
        .withColumn("_w", F.pow(floored, F.lit(temp)))
        .withColumn("_share", F.col("_w") / F.sum("_w").over(disk))
        .select(*SOURCE, "nbr", F.sum("_share").over(upto).alias("cdf"))
    )


def cdf_max(cdf: DataFrame) -> DataFrame:
    return cdf.groupBy(*SOURCE).agg(F.max("cdf").alias("max_cdf"))


def hop_table(cdf: DataFrame) -> DataFrame:
    """One row per source with its sorted (cdf, neighbour) list ``hops`` and its guide; the disk bounds the list.

    ``guide`` tells, for each of GUIDE equal parts of [0, 1) and for 1, the place of the first neighbour whose cdf
    reaches where the part begins, one past the list if none does. A draw looks only from its part's place to the next part's.
    """
    begins = F.sequence(F.lit(0), F.lit(GUIDE))
    before = lambda g: F.size(F.filter("hops", lambda h: h["cdf"] < g / F.lit(float(GUIDE))))
    return (
        cdf.groupBy(*SOURCE).agg(F.array_sort(F.collect_list(F.struct("cdf", "nbr"))).alias("hops"))
        .withColumn("guide", F.transform(begins, lambda g: before(g) + 1))
    )


def diffuse_hop(positions: DataFrame, hops: DataFrame, hop: int, seed: int = 0) -> DataFrame:
    """Move every row once: the first neighbour whose cdf reaches the row's draw, else the last.

    The guide leads to it, so a draw looks at one or two neighbours on average, whatever the size of the disk. A row whose cell has no baseline neighbours stays. ``positions`` carries ``cur``.
    """
    drawn = positions.withColumn("_r", uniform(F.col("row_id"), hop, seed))
    at = hops.withColumnRenamed("src", "cur")
    part = F.floor(F.col("_r") * GUIDE).cast("int") + 1
    begin, end = F.try_element_at("guide", part), F.try_element_at("guide", part + 1)
    near = F.slice("hops", begin, end - begin + 1)
    reached = F.try_element_at(F.filter(near, lambda h: h["cdf"] >= F.col("_r")), F.lit(1))["nbr"]
    last = F.try_element_at(F.col("hops"), F.lit(-1))["nbr"]
    return (
        drawn.join(at, [*REGION, "cur"], "left")
        .withColumn("cur", F.coalesce(reached, last, F.col("cur")))
        .select(*positions.columns)
    )


def diffuse_steps(staged: DataFrame, cdf: DataFrame, n_iters: int = 10, seed: int = 0, cut_every: int = 5) -> list[DataFrame]:
    """Positions after each hop. Lineage is cut by a reliable checkpoint every few hops.

    Copies of one row id are carried once, with their number, as they share every draw.
    """
    hops = hop_table(cdf)
    if n_iters > 1:
        hops = kept(hops)
    positions = (
        staged.groupBy("row_id", *SOURCE).agg(F.count(F.lit(1)).alias("copies")).withColumn("cur", F.col("src"))
    )
    steps = []
    for hop in range(1, n_iters + 1):
        positions = diffuse_hop(positions, hops, hop, seed)
        if hop % cut_every == 0 and hop < n_iters:
            positions = kept(positions)
        steps.append(positions)
    return steps


def diffuse(staged: DataFrame, cdf: DataFrame, n_iters: int = 10, seed: int = 0, cut_every: int = 5) -> DataFrame:
    """Positions after ``n_iters`` hops."""
    return diffuse_steps(staged, cdf, n_iters, seed, cut_every)[-1]


def density_snapshot(positions: DataFrame, iteration: int) -> DataFrame:
    """Pings per fine cell after one hop."""
    return positions.groupBy(F.col("cur").alias("c20")).agg(F.sum("copies").alias("ping_count")).select(
        F.lit(iteration).alias("iter"), "c20", "ping_count"
    )


def density_snapshots(steps: Sequence[DataFrame]) -> DataFrame:
    """All hops' densities; ``append_snapshots`` stores them."""
    frames = [density_snapshot(p, i) for i, p in enumerate(steps, start=1)]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def spread_metric(snapshots: DataFrame) -> DataFrame:
    """Occupied cells per hop."""
    return snapshots.groupBy("iter").agg(F.countDistinct("c20").alias("cells_n"))


def jitter_to_child(positions: DataFrame, child_zoom: int = CHILD_ZOOM, seed: int = 0) -> DataFrame:
    """Centre of a fine child, drawn by a seeded hash, of each final cell."""
    kids = child_count(F.col("cur"), child_zoom)
    index = F.floor(uniform(F.col("row_id"), "child", seed) * kids)
    return (
        positions.withColumn("dest_child", cell_child(F.col("cur"), child_zoom, index))
        .withColumn("new_lat", cell_lat(F.col("dest_child")))
        .withColumn("new_lon", cell_lon(F.col("dest_child")))
    )


def append_snapshots(snapshots: DataFrame, path: str) -> None:
    """Append densities to a table laid out by ``iter``, one folder a hop."""
    snapshots.repartitionByRange("iter", "c20").write.mode("append").partitionBy("iter").parquet(path)


def write_smoothed(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store smoothed pings by day, ordered by market and cell."""
    write_partitions(rows, path, sort=["market_id", "c14"], mode=mode)


def parity_writeback(staged: DataFrame, moves: DataFrame) -> DataFrame:
    """The staged rows with moved coordinates and recomputed cells: same rows, same column order.

    ``moves`` has one row per id, region and source cell, so the left join cannot add or lose rows.
    """
    keys = ["row_id", *SOURCE]
    lat, lon = F.coalesce("new_lat", F.col("lat")), F.coalesce("new_lon", F.col("lon"))
    moved = join_null_safe(staged, moves.select(*keys, "new_lat", "new_lon"), keys, "left")
    joined = moved.withColumns({"lat": lat, "lon": lon})
    cells = {f"c{z}": cell(F.col("lat"), F.col("lon"), z) for z in (11, 14, 17, 20) if f"c{z}" in staged.columns}
    joined = joined.withColumns(cells)
    if "device_geo" in staged.columns:
        joined = joined.withColumn("device_geo", F.struct("lon", "lat"))
    return joined.select(*[c for c in staged.columns if c not in ("src", "row_id")])


def run_log_summary(weights: DataFrame, log: DataFrame, state: str = "EXIT") -> DataFrame:
    """Weights per run beside the arguments its log entry recorded, for runs in ``state``."""
    counts = weights.groupBy("call_id").agg(F.count(F.lit(1)).alias("counts"))

    def argument(key: str) -> Column:
        return F.get_json_object("call_info", f"$.CALL_ARGUMENTS.{key}").alias(key.lower())

    return counts.join(log.where(F.col("call_state") == state), "call_id").select(
        "call_id", F.format_number("counts", 0).alias("counts"),
        *[argument(k) for k in ("BASE_START", "BASE_END", "TEMP", "K", "DMA_LIST")],
        F.to_date("log_time").alias("run_date"),
    )
