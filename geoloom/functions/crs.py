"""Coordinate systems as column expressions: local and UTM transverse Mercator, Web Mercator,
distances and bounds.  Transverse Mercator is Krueger's series to the sixth order of the third
flattening.  Expressions are SQL text so that the same formula can be run elsewhere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: WGS84, mean earth radius, metres of a degree, Web Mercator limit
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
EARTH_R, DEGREE_M, MERCATOR_LAT = 6371000.0, 111320.0, 85.05112878

_N = WGS84_F / (2 - WGS84_F)
_E = math.sqrt(WGS84_F * (2 - WGS84_F))
_RECT = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
# fixed values: Krueger's forward and inverse series, by powers of n from the first
_ALPHA = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600),
    (0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840),
    (0, 0, 0, 0, 0, 212378941 / 319334400),
)
_BETA = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600),
    (0, 0, 0, 0, 4583 / 161280, -108847 / 3991680),
    (0, 0, 0, 0, 0, 20648693 / 638668800),
)
_DELTA = (
    (2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675),
    (0, 7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945),
    (0, 0, 56 / 15, -136 / 35, -1262 / 105, 73814 / 2835),
    (0, 0, 0, 4279 / 630, -332 / 35, -399572 / 14175),
    (0, 0, 0, 0, 4174 / 315, -144838 / 6237),
    (0, 0, 0, 0, 0, 601676 / 22275),
)


def _terms(rows) -> list[float]:
    return [sum(c * _N ** (i + 1) for i, c in enumerate(row)) for row in rows]


def _northing(lat_deg: float) -> float:
    """Distance of a parallel from the equator along the central meridian."""
    s = math.sin(math.radians(lat_deg))
    xi = math.atan(math.sinh(math.atanh(s) - _E * math.atanh(_E * s)))
    return _RECT * (xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(_terms(_ALPHA), 1)))


def tmerc_sql(lat: str, lng: str, lat0: float, lng0: str | float, k: float = 1.0) -> tuple[str, str]:
    """SQL of easting and northing from (lat0, lng0)."""
    s, dl = f"sin(radians({lat}))", f"radians({lng} - ({lng0}))"
    t = f"sinh(atanh({s}) - {_E!r} * atanh({_E!r} * {s}))"
    xi, eta = f"atan2({t}, cos({dl}))", f"atanh(sin({dl}) / sqrt(1 + ({t}) * ({t})))"
    north = " + ".join([xi] + [f"{a!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(_terms(_ALPHA), 1)])
    east = " + ".join([eta] + [f"{a!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(_terms(_ALPHA), 1)])
    return f"({k * _RECT!r} * ({east}))", f"({k * _RECT!r} * ({north}) - {k * _northing(lat0)!r})"


def tmerc_inverse_sql(x: str, y: str, lat0: float, lng0: float, k: float = 1.0) -> tuple[str, str]:
    """SQL of latitude and longitude."""
    xi, eta = f"(({y} + {k * _northing(lat0)!r}) / {k * _RECT!r})", f"({x} / {k * _RECT!r})"
    xi1 = "(" + " - ".join([xi] + [f"{b!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, b in enumerate(_terms(_BETA), 1)]) + ")"
    eta1 = "(" + " - ".join([eta] + [f"{b!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, b in enumerate(_terms(_BETA), 1)]) + ")"
    chi = f"asin(sin({xi1}) / cosh({eta1}))"
    lat = " + ".join([chi] + [f"{d!r} * sin({2 * j} * {chi})" for j, d in enumerate(_terms(_DELTA), 1)])
    return f"degrees({lat})", f"({lng0} + degrees(atan2(sinh({eta1}), cos({xi1}))))"


def local_xy(lat: str, lng: str, lat0: float, lng0: str | float) -> tuple[Column, Column]:
    """Metres east and north of a centre."""
    x, y = tmerc_sql(lat, lng, lat0, lng0)
    return F.expr(x), F.expr(y)


def utm_sql(lat: str, lng: str) -> dict[str, str]:
    zone = f"CAST(floor(({lng} + 180) / 6) + 1 AS INT)"
    x, y = tmerc_sql(lat, lng, 0.0, f"({zone} * 6 - 183)", 0.9996)
    return {
        "zone": zone,
        "epsg": f"CASE WHEN {lat} >= 0 THEN 32600 ELSE 32700 END + {zone}",
        "easting": f"{x} + 500000.0",
        "northing": f"{y} + CASE WHEN {lat} >= 0 THEN 0.0 ELSE 10000000.0 END",
    }


def mercator_sql(lat: str, lng: str, zoom: int) -> tuple[str, str]:
    """World pixel of a Web Mercator map at a zoom; latitudes are clamped."""
    size = 256 * 2**zoom
    s = f"sin(radians(greatest(-{MERCATOR_LAT}, least({MERCATOR_LAT}, {lat}))))"
    return f"(({lng} + 180) / 360 * {size}.0)", f"((0.5 - ln((1 + {s}) / (1 - {s})) / {4 * math.pi!r}) * {size}.0)"


def haversine_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    h = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2))"
    return f"({2 * EARTH_R} * asin(least(1.0, sqrt({h}))))"


def normalize_lng(lng: Column) -> Column:
    return F.pmod(lng + 180, F.lit(360.0)) - 180


def unwrap_lng(lng: Column, near: Column) -> Column:
    """A longitude shifted by whole turns to within half a turn of another."""
    return lng - 360 * F.ceil((lng - near - 180) / 360)


def square_bounds(lat: Column, lng: Column, size_m) -> Column:
    half, wide = F.lit(size_m) / 2 / DEGREE_M, F.lit(size_m) / 2 / (DEGREE_M * F.cos(F.radians(lat)))
    return F.struct((lat + half).alias("north"), (lat - half).alias("south"), (lng + wide).alias("east"), (lng - wide).alias("west"))


def in_bounds(lat: Column, lng: Column, b: Column) -> Column:
    return lat.between(b["south"], b["north"]) & lng.between(b["west"], b["east"])


def bounds_overlap(a: Column, b: Column) -> Column:
    return (a["south"] <= b["north"]) & (b["south"] <= a["north"]) & (a["west"] <= b["east"]) & (b["west"] <= a["east"])


def built_in_crs(epsg: Column) -> Column:
    """The name of a coordinate system that needs no lookup, else null."""
    zone = (epsg % 100).cast("string")
    return F.when(epsg == 3857, "web_mercator").when(epsg == 2180, "poland_1992").when(epsg.between(32601, 32660), F.concat(F.lit("utm_north_"), zone)).when(epsg.between(32701, 32760), F.concat(F.lit("utm_south_"), zone))


def valid_crs(code: Column) -> Column:
    return (code > 0) & (code != 32767) & ~code.between(7000, 7999)


def suggested_resolution(width_m: Column, height_m: Column, presets=(512, 1024, 2048, 4096, 8192)) -> Column:
    """The largest preset within the largest power of two within the shorter side (metres)."""
    raw = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.lit(1.0), F.least(width_m, height_m)))))
    return F.coalesce(F.array_max(F.filter(F.array(*map(F.lit, presets)), lambda p: p <= raw)), F.lit(presets[0]))
