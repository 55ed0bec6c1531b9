"""SQL spellings of the grid and sphere formulas, for the checking statements."""

RADIUS = "6371008.8"
VENUE_LAT, VENUE_LON = 29.95, -90.08


def hav(lat1, lon1, lat2, lon2) -> str:
    return (
        f"(2*{RADIUS}*asin(sqrt(least(1e0, pow(sin(radians(({lat2})-({lat1}))/2),2)"
        f"+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians(({lon2})-({lon1}))/2),2)))))"
    )


def wrap360(angle: str) -> str:
    return f"(({angle})-360e0*floor(({angle})/360e0))"


def bearing(lat1, lon1, lat2, lon2) -> str:
    east = f"sin(radians(({lon2})-({lon1})))*cos(radians({lat2}))"
    north = (
        f"cos(radians({lat1}))*sin(radians({lat2}))"
        f"-sin(radians({lat1}))*cos(radians({lat2}))*cos(radians(({lon2})-({lon1})))"
    )
    return wrap360(f"degrees(atan2({east},{north}))")


def angle_between(a: str, b: str) -> str:
    return f"least({wrap360(f'({a})-({b})')},{wrap360(f'({b})-({a})')})"


def cell_at(zoom: int, lat: str = "lat", lon: str = "lon") -> str:
    side = 2**zoom
    return (
        f"((cast({zoom} as bigint) << 52) | (cast(floor(({lon}+180e0)/360*{side}) as bigint) << 26)"
        f" | cast(floor(({lat}+90e0)/360*{side}) as bigint))"
    )


def pack(zoom: int, x: str, y: str) -> str:
    return f"((cast({zoom} as bigint) << 52) | (cast({x} as bigint) << 26) | cast({y} as bigint))"


def cx(c: str) -> str:
    return f"(({c} >> 26) & 67108863)"


def cy(c: str) -> str:
    return f"({c} & 67108863)"


def centre_lat(c: str, zoom: int) -> str:
    return f"(({cy(c)}+0.5e0)/{2**zoom}*360e0-90e0)"


def centre_lon(c: str, zoom: int) -> str:
    return f"(({cx(c)}+0.5e0)/{2**zoom}*360e0-180e0)"


def cover_rows(table: str, radius: str, zoom: int, lat: str, lon: str) -> str:
    """Rows of ``table`` with each cell of the bounding box of a circle, as column ``c``."""
    dlat = f"(({radius})*1.01e0/(pi()*{RADIUS}/180e0))"
    dlon = f"({dlat}/cos(radians(abs({lat})+{dlat})))"
    n = 2**zoom
    return f"""
        select t.*, {pack(zoom, 'xx', 'yy')} as c from (
            select *, unnest(range(cast(floor(({lon}-{dlon}+180)/360*{n}) as bigint), cast(floor(({lon}+{dlon}+180)/360*{n}) as bigint)+1)) as xx
            from {table}) t,
            lateral unnest(range(cast(floor(({lat}-{dlat}+90)/360*{n}) as bigint), cast(floor(({lat}+{dlat}+90)/360*{n}) as bigint)+1)) as u(yy)"""


def mixed_cover_rows(table: str, radius: str, finest: int, lat: str, lon: str) -> str:
    """Rows of ``table`` with each cell of a mixed cover of a circle, as column ``c``, its zoom as ``z``."""
    meters = f"(pi()*{RADIUS}/180e0)"
    side = "(360e0/(1 << z))"
    south, west = f"(yy*{side}-90e0)", f"(xx*{side}-180e0)"
    up, along = f"abs({lat}-{south}-{side}/2)", f"abs({lon}-{west}-{side}/2)"
    along = f"least({along}, 360e0-{along})"
    cos_s, cos_n = f"cos(radians({south}))", f"cos(radians({south}+{side}))"
    hav_of = "pow(sin(radians({})/2), 2)".format
    near = (f"{hav_of(f'greatest({up}-{side}/2, 0e0)')} + cos(radians({lat}))*greatest(least({cos_s}, {cos_n}), 0e0)"
            f"*{hav_of(f'greatest({along}-{side}/2, 0e0)')}")
    widest = f"(case when {south} <= 0 and {south}+{side} >= 0 then 1e0 else greatest({cos_s}, {cos_n}) end)"
    far = (f"{hav_of(f'least({up}+{side}/2, 180e0)')} + cos(radians({lat}))*{widest}*{hav_of(f'least({along}+{side}/2, 180e0)')}")
    return f"""
        with sized as (select *, ({radius})*1.01e0 as r1, pow(sin(({radius})*1.01e0/(2*{RADIUS})), 2) as wanted from {table}),
        based as (select *, least(greatest(cast(floor(log2(360e0*{meters}/r1)) as int)+1, 1), {finest}) as base, r1/{meters} as dlat from sized),
        spanned as (select *, dlat/cos(radians(abs({lat})+dlat)) as dlon, 360e0/(1 << base) as bside from based),
        box as (select t.*, base as z, yy from (
                    select *, unnest(range(cast(floor(({lon}-dlon+180)/bside) as bigint), cast(floor(({lon}+dlon+180)/bside) as bigint)+1)) as xx
                    from spanned) t,
                    lateral unnest(range(cast(floor(({lat}-dlat+90)/bside) as bigint), cast(floor(({lat}+dlat+90)/bside) as bigint)+1)) as u(yy)),
        near as (select *, base >= {finest} or {far} <= wanted as whole from box where {near} <= wanted),
        split as (select * exclude (z, xx, yy), least(base+2, {finest}) as z,
                         (xx << (least(base+2, {finest})-base)) + dx as xx, (yy << (least(base+2, {finest})-base)) + dy as yy
                  from near, range(0, 4) as a(dx), range(0, 4) as b(dy)
                  where not whole and dx < (1 << (least(base+2, {finest})-base)) and dy < (1 << (least(base+2, {finest})-base))),
        chosen as (select * exclude (whole) from near where whole union all by name select * exclude (whole) from split where {near} <= wanted)
        select *, (cast(z as bigint) << 52) | (xx << 26) | yy as c from chosen"""


def two(x: str, digits: int = 2) -> str:
    """Half-up rounding of a double through a decimal, as a report prints it."""
    return f"cast(round(cast({x} as decimal(38,{digits + 7})),{digits}) as double)"


def div0(n: str, d: str) -> str:
    return f"(case when ({d})=0 then 0e0 else ({n})/cast({d} as double) end)"
