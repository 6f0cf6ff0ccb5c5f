"""Map projections, their inverses and datum shifts, as Columns in degrees and metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-major axis and flattening of GRS 80 and of Clarke 1866.
GRS80 = (6378137.0, 1 / 298.257222101)
CLARKE66 = (6378206.4, 1 / 294.978698214)
#: The parameters of EPSG:3347 and EPSG:32188.
STATCAN_LAMBERT = {"lat1": 49.0, "lat2": 77.0, "lat0": 63.390675, "lon0": -91.866666666666667, "x0": 6200000.0, "y0": 3000000.0}
MTM8 = {"lon0": -73.5, "k0": 0.9999, "x0": 304800.0, "y0": 0.0}
#: Steps of the fixed points below; each gains two digits at least.
STEPS = 8


def _e(f: float) -> float:
    return math.sqrt(f * (2 - f))


def _isometric(lat: Column, e: float) -> Column:
    """The isometric latitude of a latitude in degrees."""
    s = F.sin(F.radians(lat))
    return F.atanh(s) - F.atanh(s * e) * e


def _latitude(psi: Column, e: float) -> Column:
    """The latitude in degrees of an isometric latitude, by a fixed point."""
    s = F.tanh(psi)
    for _ in range(STEPS):
        s = F.tanh(psi + F.atanh(s * e) * e)
    return F.degrees(F.atan(F.sinh(psi + F.atanh(s * e) * e)))


def _conic(p: dict, ellipsoid: tuple[float, float]) -> tuple[float, float, float, float]:
    """e, the cone's constant, the scale of radii and the radius of the origin."""
    a, f = ellipsoid
    e = _e(f)
    m = lambda d: math.cos(math.radians(d)) / math.sqrt(1 - (e * math.sin(math.radians(d))) ** 2)
    t = lambda d: math.exp(-(math.atanh(math.sin(math.radians(d))) - e * math.atanh(e * math.sin(math.radians(d)))))
    n = math.log(m(p["lat1"]) / m(p["lat2"])) / math.log(t(p["lat1"]) / t(p["lat2"]))
    scale = a * m(p["lat1"]) / (n * t(p["lat1"]) ** n)
    return e, n, scale, scale * t(p["lat0"]) ** n


def lambert_conic(lon: Column, lat: Column, p: dict = STATCAN_LAMBERT, ellipsoid: tuple[float, float] = GRS80) -> tuple[Column, Column]:
    """Degrees to metres of a Lambert conformal conic with two standard parallels."""
    e, n, scale, rho0 = _conic(p, ellipsoid)
    rho, turn = F.exp(_isometric(lat, e) * -n) * scale, F.radians(lon - p["lon0"]) * n
    return rho * F.sin(turn) + p["x0"], F.lit(rho0) - rho * F.cos(turn) + p["y0"]


def lambert_inverse(x: Column, y: Column, p: dict = STATCAN_LAMBERT, ellipsoid: tuple[float, float] = GRS80) -> tuple[Column, Column]:
    """Metres of the conic (north of the equator) to longitude and latitude."""
    e, n, scale, rho0 = _conic(p, ellipsoid)
    dx, dy = x - p["x0"], F.lit(rho0) - (y - p["y0"])
    lon = F.degrees(F.atan2(dx, dy) / n) + p["lon0"]
    return lon, _latitude(F.ln(F.hypot(dx, dy) / scale) / -n, e)


def _series(n: float) -> tuple[list[float], list[float], float]:
    """Coefficients there and back up to the fourth power of the third flattening, and the rectifying radius over the axis."""
    there = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    back = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    return there, back, (1 + n**2 / 4 + n**4 / 64) / (1 + n)


def transverse_mercator(lon: Column, lat: Column, p: dict = MTM8, ellipsoid: tuple[float, float] = GRS80) -> tuple[Column, Column]:
    """Degrees to metres of a transverse Mercator projection, by its series."""
    a, f = ellipsoid
    there, _, radius = _series(f / (2 - f))
    t = F.sinh(_isometric(lat, _e(f)))
    turn = F.radians(lon - p["lon0"])
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for k, c in enumerate(there, 1):
        east = east + F.cos(xi * 2 * k) * F.sinh(eta * 2 * k) * c
        north = north + F.sin(xi * 2 * k) * F.cosh(eta * 2 * k) * c
    k0 = p["k0"] * radius * a
    return east * k0 + p["x0"], north * k0 + p["y0"]


def transverse_inverse(x: Column, y: Column, p: dict = MTM8, ellipsoid: tuple[float, float] = GRS80) -> tuple[Column, Column]:
    """Metres of a transverse Mercator projection to longitude and latitude, by the series back."""
    a, f = ellipsoid
    _, back, radius = _series(f / (2 - f))
    k0 = p["k0"] * radius * a
    eta, xi = (x - p["x0"]) / k0, (y - p["y0"]) / k0
    east, north = eta, xi
    for k, c in enumerate(back, 1):
        east = east - F.cos(xi * 2 * k) * F.sinh(eta * 2 * k) * c
        north = north - F.sin(xi * 2 * k) * F.cosh(eta * 2 * k) * c
    lon = F.degrees(F.atan2(F.sinh(east), F.cos(north))) + p["lon0"]
    return lon, _latitude(F.atanh(F.sin(north) / F.cosh(east)), _e(f))


def web_mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3857 metres to degrees."""
    return F.degrees(x / GRS80[0]), F.degrees(F.atan(F.sinh(y / GRS80[0])))


def geocentric(lon: Column, lat: Column, height: Column, ellipsoid: tuple[float, float]) -> tuple[Column, Column, Column]:
    """Degrees and metres above an ellipsoid to metres from the earth's centre."""
    a, f = ellipsoid
    s, c = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    n = F.lit(a) / F.sqrt(1 - s * s * (f * (2 - f)))
    return (n + height) * c * F.cos(F.radians(lon)), (n + height) * c * F.sin(F.radians(lon)), (n * (1 - f) ** 2 + height) * s


def geodetic(x: Column, y: Column, z: Column, ellipsoid: tuple[float, float]) -> tuple[Column, Column, Column]:
    """Metres from the earth's centre to longitude, latitude and height, by a fixed point; not for the axis itself."""
    a, f = ellipsoid
    e2, q = f * (2 - f), 1 - f
    p = F.hypot(x, y)
    t = z / (p * (q * q))
    for _ in range(STEPS):
        t = (z + F.sin(F.atan(t * q)) * (e2 * a / q)) / p
    lat = F.atan(t)
    height = p * F.cos(lat) + z * F.sin(lat) - F.sqrt(1 - F.sin(lat) * F.sin(lat) * e2) * a
    return F.degrees(F.atan2(y, x)), F.degrees(lat), height


def datum_shift(
    lon: Column,
    lat: Column,
    shift: tuple[float, float, float, float, float, float, float],
    source: tuple[float, float] = CLARKE66,
    target: tuple[float, float] = GRS80,
    height: Column | None = None,
) -> tuple[Column, Column, Column]:
    """Longitude, latitude and height on another datum.

    shift: three metres, three rotations in arc seconds (of the position vector) and a
    scale in parts per million, from the source's axes to the target's.
    """
    dx, dy, dz, *turns, ppm = shift
    rx, ry, rz = (math.radians(r / 3600) for r in turns)
    m = 1 + ppm * 1e-6
    x, y, z = geocentric(lon, lat, F.lit(0.0) if height is None else height, source)
    return geodetic((x - y * rz + z * ry) * m + dx, (x * rz + y - z * rx) * m + dy, (y * rx - x * ry + z) * m + dz, target)
