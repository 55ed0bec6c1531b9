"""A square quadtree grid over longitude and latitude, written as Column arithmetic.

A cell id packs ``(zoom << 52) | (x << 26) | y`` into a BIGINT, so nesting is a
shift, equality is an integer compare and nothing leaves whole-stage codegen.
Cells are squares in degrees: a disk of radius k has (2k+1)^2 cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from sightline.functions.geodesy import EARTH_RADIUS_M, distance_m

MAX_ZOOM = 25
METERS_PER_DEGREE = math.pi * EARTH_RADIUS_M / 180
_BITS = 26
_MASK = (1 << _BITS) - 1


def _pack(zoom: int | Column, x: Column, y: Column) -> Column:
    z = F.lit(zoom).cast("bigint") if isinstance(zoom, int) else zoom.cast("bigint")
    return F.shiftleft(z, 2 * _BITS).bitwiseOR(F.shiftleft(x.cast("bigint"), _BITS)).bitwiseOR(y.cast("bigint"))


def cell_zoom(cell: Column) -> Column:
    return F.shiftright(cell, 2 * _BITS)


def cell_x(cell: Column) -> Column:
    return F.shiftright(cell, _BITS).bitwiseAND(F.lit(_MASK).cast("bigint"))


def cell_y(cell: Column) -> Column:
    return cell.bitwiseAND(F.lit(_MASK).cast("bigint"))


def _spread(v: Column) -> Column:
    """The bits of a number under 2**32 with a gap before each."""
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555),
    ):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def curve_key(c: Column) -> Column:
    """Place of a cell on the Z-order curve of the finest zoom: the bits of its column and row in turn.

    Cells near each other have near keys, and all cells within one have the keys from its own up to ``curve_end``. Rows sorted
    by it lie in files with a narrow range of both longitude and latitude. Null for a null cell.
    """
    place = F.shiftleft(_spread(cell_x(c)), 1).bitwiseOR(_spread(cell_y(c)))
    return F.call_function("shiftleft", place, (2 * (MAX_ZOOM - cell_zoom(c))).cast("int"))


def curve_end(c: Column) -> Column:
    """The last key of the cells within a cell."""
    return curve_key(c) + F.call_function("shiftleft", F.lit(1).cast("bigint"), (2 * (MAX_ZOOM - cell_zoom(c))).cast("int")) - 1


def _column_at(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180.0) / 360.0 * float(2**zoom))


def _row_at(lat: Column, zoom: int) -> Column:
    return F.floor((lat + 90.0) / 360.0 * float(2**zoom))


def _wrap(x: Column, zoom: int) -> Column:
    return F.pmod(x, F.lit(2**zoom).cast("bigint"))


def cell(lat: Column, lon: Column, zoom: int) -> Column:
    """Cell of a point at ``zoom``; the antimeridian wraps to column 0."""
    return _pack(zoom, _wrap(_column_at(lon, zoom), zoom), _row_at(lat, zoom))


def cell_parent(c: Column, zoom: int) -> Column:
    """Ancestor of a cell at a coarser (or equal) ``zoom``."""
    shift = (cell_zoom(c) - zoom).cast("int")
    return _pack(
        zoom,
        F.call_function("shiftright", cell_x(c), shift),
        F.call_function("shiftright", cell_y(c), shift),
    )


def child_count(c: Column, zoom: int | Column) -> Column:
    """How many descendants a cell has at ``zoom`` (4 per level)."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (2 * (zoom - cell_zoom(c))).cast("int"))


def cell_child(c: Column, zoom: int | Column, index: Column | int) -> Column:
    """The ``index``-th descendant at ``zoom``, row by row, without listing the others."""
    i = F.lit(index).cast("bigint") if isinstance(index, int) else index.cast("bigint")
    shift = (zoom - cell_zoom(c)).cast("int")
    side_mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), shift) - 1
    return _pack(
        zoom,
        F.call_function("shiftleft", cell_x(c), shift) + i.bitwiseAND(side_mask),
        F.call_function("shiftleft", cell_y(c), shift) + F.call_function("shiftright", i, shift),
    )


def cell_children(c: Column, zoom: int | Column) -> Column:
    """All descendants as an array; meant for a few levels, 4^levels entries each."""
    return F.transform(F.sequence(F.lit(0).cast("bigint"), child_count(c, zoom) - 1), lambda i: cell_child(c, zoom, i))


def _side_degrees(c: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), cell_zoom(c).cast("double"))


def cell_lat(c: Column) -> Column:
    return (cell_y(c).cast("double") + 0.5) * _side_degrees(c) - 90.0


def cell_lon(c: Column) -> Column:
    return (cell_x(c).cast("double") + 0.5) * _side_degrees(c) - 180.0


def cell_area_m2(c: Column) -> Column:
    side = _side_degrees(c) * METERS_PER_DEGREE
    return side * side * F.cos(F.radians(cell_lat(c)))


def grid_disk(c: Column, k: int, zoom: int, exclude_center: bool = False) -> Column:
    """Cells at most ``k`` columns and rows away, as an array; ``c`` is at ``zoom``."""
    steps = [(dx, dy) for dx in range(-k, k + 1) for dy in range(-k, k + 1) if dx or dy or not exclude_center]
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps])
    return F.transform(
        offsets, lambda o: _pack(zoom, _wrap(cell_x(c) + o["dx"], zoom), cell_y(c) + o["dy"])
    )


def cover(lat: Column, lon: Column, radius_m: Column | float, zoom: int) -> Column:
    """Cells that a circle round the point may touch (a superset, 1 % margin), as an array.

    The longitude span is widened by the cosine of the latitude nearest the pole,
    so an equi join on the cell followed by an exact distance test loses no pair.
    """
    radius = F.lit(float(radius_m)) if isinstance(radius_m, (int, float)) else radius_m
    span_lat = radius * 1.01 / METERS_PER_DEGREE
    polar = F.least(F.abs(lat) + span_lat, F.lit(89.999))
    span_lon = F.least(span_lat / F.cos(F.radians(polar)), F.lit(180.0))
    x0 = _column_at(lon - span_lon, zoom)
    x1 = F.least(_column_at(lon + span_lon, zoom), x0 + (2**zoom - 1))
    y0 = _row_at(F.greatest(lat - span_lat, F.lit(-90.0)), zoom)
    y1 = _row_at(F.least(lat + span_lat, F.lit(90.0)), zoom)
    # A missing latitude would be bounded to a whole column of cells.
    return F.when(lat.isNotNull() & radius.isNotNull(), F.flatten(
        F.transform(
            F.sequence(x0, x1),
            lambda x: F.transform(F.sequence(y0, y1), lambda y: _pack(zoom, _wrap(x, zoom), y)),
        )
    ))


def _distance_bounds(lat: Column, lon: Column, c: Column) -> tuple[Column, Column]:
    """No point of a cell is nearer than the first, none farther than the second; both as the haversine of the angle.

    The haversine is that of the difference in latitude, plus that of the difference in longitude times both cosines: each
    part is taken at its least, or most, within the cell.
    """
    def hav(degrees: Column) -> Column:
        return F.pow(F.sin(F.radians(degrees) / 2), 2)

    half = _side_degrees(c) / 2
    up, along = F.abs(lat - cell_lat(c)), F.abs(lon - cell_lon(c))
    along = F.least(along, 360.0 - along)
    south, north = cell_lat(c) - half, cell_lat(c) + half
    cosines = F.cos(F.radians(south)), F.cos(F.radians(north))
    widest = F.when((south <= 0) & (north >= 0), F.lit(1.0)).otherwise(F.greatest(*cosines))
    here = F.cos(F.radians(lat))
    least = hav(F.greatest(up - half, F.lit(0.0))) + here * F.greatest(F.least(*cosines), F.lit(0.0)) * hav(
        F.greatest(along - half, F.lit(0.0))
    )
    most = hav(F.least(up + half, F.lit(180.0))) + here * widest * hav(F.least(along + half, F.lit(180.0)))
    return least, most


def mixed_cover(lat: Column, lon: Column, radius_m: Column | float, finest: int) -> Column:
    """Cells of several zooms that hold a circle round the point (1 % margin), none within another, as an array.

    A box of cells about as wide as half the radius is laid over the circle. Those that lie inside stay whole, those
    that it may cut are split two levels finer, as far as ``finest``, and what lies outside is left out. So the number of cells
    does not grow with the radius, save for the stretched columns near the poles. Null where the point or radius is.
    """
    radius = (F.lit(float(radius_m)) if isinstance(radius_m, (int, float)) else radius_m) * 1.01
    fitting = F.floor(F.log2(F.lit(360 * METERS_PER_DEGREE) / radius)).cast("int") + 1
    base = F.least(F.greatest(fitting, F.lit(1)), F.lit(finest))
    fine = F.least(base + 2, F.lit(finest))
    wanted = F.pow(F.sin(radius / (2 * EARTH_RADIUS_M)), 2)
    n = F.call_function("shiftleft", F.lit(1).cast("bigint"), base)
    side = F.lit(360.0) / n
    span_lat = radius / METERS_PER_DEGREE
    polar = F.least(F.abs(lat) + span_lat, F.lit(89.999))
    span_lon = F.least(span_lat / F.cos(F.radians(polar)), F.lit(180.0))
    x0 = F.floor((lon - span_lon + 180.0) / side)
    x1 = F.least(F.floor((lon + span_lon + 180.0) / side), x0 + n - 1)
    y0 = F.floor((F.greatest(lat - span_lat, F.lit(-90.0)) + 90.0) / side)
    y1 = F.floor((F.least(lat + span_lat, F.lit(90.0)) + 90.0) / side)
    box = F.flatten(F.transform(
        F.sequence(x0, x1), lambda x: F.transform(F.sequence(y0, y1), lambda y: _pack(base, F.pmod(x, n), y))
    ))

    def touched(c: Column) -> Column:
        return _distance_bounds(lat, lon, c)[0] <= wanted

    def split(c: Column) -> Column:
        whole = (base >= F.lit(finest)) | (_distance_bounds(lat, lon, c)[1] <= wanted)
        return F.when(whole, F.array(c)).otherwise(F.filter(cell_children(c, fine), touched))

    return F.when(lat.isNotNull() & radius.isNotNull(), F.flatten(F.transform(F.filter(box, touched), split)))


def cell_ancestors(c: Column, zooms: Sequence[int]) -> Column:
    """The cell's ancestors at the given zooms, none finer than its own, as an array."""
    return F.array(*[cell_parent(c, zoom) for zoom in zooms])


def zoom_for_radius(radius_m: float) -> int:
    """Finest zoom whose cells are still at least as tall as the radius (3x3 cells cover it)."""
    return max(1, min(MAX_ZOOM, int(math.floor(math.log2(360 * METERS_PER_DEGREE / radius_m)))))


def proximity_bins(lat: Column, lon: Column, c: Column) -> tuple[Column, Column]:
    """Nearest and farthest distance of a cell from a point, rounded out to 10 m."""
    centre = distance_m(lat, lon, cell_lat(c), cell_lon(c))
    reach = F.sqrt(cell_area_m2(c) / math.pi)
    near = (F.floor(centre / 10.0) * 10).cast("bigint")
    far = (F.ceil((centre + reach) / 10.0) * 10).cast("bigint")
    return near, far
