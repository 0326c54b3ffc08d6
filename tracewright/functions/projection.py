"""Geographic coordinates to British National Grid, as expressions.

A seven-parameter shift takes WGS84 to the Airy ellipsoid (good to about 5 m; the national correction grid is not applied), and the
transverse Mercator series takes it to the grid (good to millimetres).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ellipsoids (semi-axes in metres), the grid's origin and scale, and the shift from WGS84.
WGS84, AIRY = (6378137.0, 6356752.314245), (6377563.396, 6356256.909)
ORIGIN_LAT, ORIGIN_LON, FALSE_EAST, FALSE_NORTH, SCALE = 49.0, -2.0, 400000.0, -100000.0, 0.9996012717
SHIFT_M, TURN_SECONDS, PARTS_PER_MILLION = (-446.448, 125.157, -542.060), (-0.1502, -0.2470, -0.8421), 20.4894


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def project(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing of coordinates that are on the Airy ellipsoid already."""
    point = _let(F.struct(F.radians(lat).alias("phi"), F.radians(lon - ORIGIN_LON).alias("lam")), _series)
    return point["east"], point["north"]


def _series(point: Column) -> Column:
    a, b = AIRY
    e2, n = 1 - (b / a) ** 2, (a - b) / (a + b)
    phi, lam = point["phi"], point["lam"]
    phi0 = math.radians(ORIGIN_LAT)
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi)
    nu = a * SCALE / F.sqrt(1 - e2 * s * s)
    eta = (1 - e2 * s * s) / (1 - e2) - 1
    d, u = phi - phi0, phi + phi0
    arc = b * SCALE * (
        (1 + n + 5 / 4 * n**2 + 5 / 4 * n**3) * d
        - (3 * n + 3 * n**2 + 21 / 8 * n**3) * F.sin(d) * F.cos(u)
        + (15 / 8 * n**2 + 15 / 8 * n**3) * F.sin(2 * d) * F.cos(2 * u)
        - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * u)
    )
    north = arc + FALSE_NORTH + nu / 2 * s * c * lam**2 + nu / 24 * s * c**3 * (5 - t**2 + 9 * eta) * lam**4 + nu / 720 * s * c**5 * (61 - 58 * t**2 + t**4) * lam**6
    east = FALSE_EAST + nu * c * lam + nu / 6 * c**3 * (1 + eta - t**2) * lam**3 + nu / 120 * c**5 * (5 - 18 * t**2 + t**4 + 14 * eta - 58 * t**2 * eta) * lam**5
    return F.struct(east.alias("east"), north.alias("north"))


def to_airy(lat: Column, lon: Column) -> tuple[Column, Column]:
    """WGS84 latitude and longitude on the Airy ellipsoid, through Cartesian coordinates."""
    a, b = WGS84
    e2 = 1 - (b / a) ** 2
    rx, ry, rz = (math.radians(s / 3600) for s in TURN_SECONDS)
    k = 1 + PARTS_PER_MILLION * 1e-6
    tx, ty, tz = SHIFT_M
    a2, b2 = AIRY
    f2 = 1 - (b2 / a2) ** 2

    def cartesian(p: Column) -> Column:
        nu = a / F.sqrt(1 - e2 * F.sin(p["phi"]) ** 2)
        return F.struct((nu * F.cos(p["phi"]) * F.cos(p["lam"])).alias("x"), (nu * F.cos(p["phi"]) * F.sin(p["lam"])).alias("y"), (nu * (1 - e2) * F.sin(p["phi"])).alias("z"))

    def shift(p: Column) -> Column:
        x, y, z = p["x"], p["y"], p["z"]
        return F.struct((tx + k * x - rz * y + ry * z).alias("x"), (ty + rz * x + k * y - rx * z).alias("y"), (tz - ry * x + rx * y + k * z).alias("z"))

    def geographic(p: Column) -> Column:
        flat = F.sqrt(p["x"] ** 2 + p["y"] ** 2)
        theta = F.atan2(p["z"] * a2, flat * b2)
        lat2 = F.atan2(p["z"] + f2 / (1 - f2) * b2 * F.sin(theta) ** 3, flat - f2 * a2 * F.cos(theta) ** 3)
        return F.struct(F.degrees(lat2).alias("lat"), F.degrees(F.atan2(p["y"], p["x"])).alias("lon"))

    out = _let(_let(_let(F.struct(F.radians(lat).alias("phi"), F.radians(lon).alias("lam")), cartesian), shift), geographic)
    return out["lat"], out["lon"]


def wgs84_to_grid(lat: Column, lon: Column) -> tuple[Column, Column]:
    return project(*to_airy(lat, lon))
