"""UTM zones and the transverse Mercator series, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.config import DEFAULT_EPSG

_N = (1 / 298.257223563) / (2 - 1 / 298.257223563)
ECCENTRICITY = math.sqrt(4 * _N) / (1 + _N)
RADIUS = 0.9996 * 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
# Coefficients of the forward series in powers 1..6 of the third flattening.
_ALPHA = [
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600),
    (0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840),
    (0, 0, 0, 0, 0, 212378941 / 319334400),
]
ALPHA = [sum(c * _N ** (i + 1) for i, c in enumerate(row)) for row in _ALPHA]


def zone(lon: Column, clamp: bool = False) -> Column:
    z = (F.floor((lon + 180) / 6) + 1).cast("int") if clamp else ((lon + 180) / 6).cast("int") + 1
    return F.least(F.greatest(z, F.lit(1)), F.lit(60)) if clamp else z


def utm_epsg(lon: Column, lat: Column, clamp: bool = False) -> Column:
    """EPSG code of the UTM zone; without clamp, positions off the globe (or null) get the default code."""
    code = F.when(lat >= 0, 32600).otherwise(32700) + zone(lon, clamp)
    ok = lon.between(-180, 180) & lat.between(-90, 90)
    return code if clamp else F.when(ok, code).otherwise(DEFAULT_EPSG)


# Codes of geographic systems whose degrees are taken as WGS84's, and of spherical Mercator.
GEOGRAPHIC, MERCATOR = (4326, 4674, 4258, 4979), 3857


def parse_epsg(crs: str | int) -> tuple[int, bool]:
    """(zone, south) of UTM on WGS84 (EPSG:326zz, 327zz) or SIRGAS 2000 (31965 to 31985); zone 0 is EPSG:3857.  Others are refused."""
    code = int(str(crs).upper().removeprefix("EPSG:"))
    if code // 100 in (326, 327) and 1 <= code % 100 <= 61:
        return code % 100, code // 100 == 327
    if 31965 <= code <= 31976:
        return code - 31954, False
    if 31977 <= code <= 31985:
        return code - 31960, True
    if code == MERCATOR:
        return 0, False
    raise ValueError(f"working CRS {crs!r}: UTM on WGS84 or SIRGAS 2000 and EPSG:3857 are supported")


def source(name: Column) -> tuple[Column, Column, Column]:
    """(geographic, zone, south) of the name of a `crs` member; null names mean WGS84, unknown ones fail."""
    code = F.regexp_extract(name, r"(\d+)\s*$", 1).try_cast("int")
    lonlat = name.isNull() | F.upper(name).endswith("CRS84") | code.isin(*GEOGRAPHIC)
    zone_ = F.when(lonlat, F.lit(None).cast("int")).when(F.floor(code / 100).isin(326, 327), code % 100)
    zone_ = zone_.when(code.between(31965, 31976), code - 31954).when(code.between(31977, 31985), code - 31960).when(code == MERCATOR, 0)
    south = (F.floor(code / 100) == 327) | code.between(31977, 31985)
    unknown = F.raise_error(F.concat(F.lit("unknown coordinate system: "), name)).cast("int")
    return lonlat, zone_.otherwise(unknown), F.coalesce(south, F.lit(False))


def forward(lon: Column, lat: Column, zone_: Column, south: Column) -> tuple[Column, Column]:
    """(easting, northing)."""
    lam = F.radians(lon - (zone_ * 6 - 183))
    t = F.tan(F.radians(lat))
    s = F.sinh(ECCENTRICITY * F.atanh(ECCENTRICITY * t / F.sqrt(1 + t * t)))
    tc = t * F.sqrt(1 + s * s) - s * F.sqrt(1 + t * t)
    xi = F.atan2(tc, F.cos(lam))
    eta = F.asinh(F.sin(lam) / F.sqrt(tc * tc + F.cos(lam) * F.cos(lam)))
    x, y = xi, eta
    for j, a in enumerate(ALPHA, 1):
        x = x + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return 500000 + RADIUS * y, RADIUS * x + F.when(south, 1e7).otherwise(0.0)
