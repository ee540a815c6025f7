"""Closed-form map projections as column expressions (metres and degrees, GRS80/WGS84 ellipsoid)."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the ellipsoid's equatorial radius and flattening
A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)


def web_mercator(lon: Column, lat: Column) -> list[Column]:
    return [F.radians(lon) * A, F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * A]


def transverse_mercator(lon: Column, lat: Column, zone: int) -> list[Column]:
    """Easting and northing in a northern UTM zone, by the third-flattening series to sixth order."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    # fixed values: coefficients of the series
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    phi, lam = F.radians(lat), F.radians(lon - F.lit(6.0 * zone - 183))
    e = math.sqrt(E2)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return [500_000 + 0.9996 * radius * x, 0.9996 * radius * y]


def albers(lon: Column, lat: Column, lon0: float = -120.0, lat0: float = 0.0, lat1: float = 34.0, lat2: float = 40.5, north: float = -4_000_000.0) -> list[Column]:
    """Equal-area conic; the defaults are those of the Californian state grid."""
    e = math.sqrt(E2)

    def q_of(s, ln):
        return (1 - E2) * (s / (1 - E2 * s * s) - ln((1 - e * s) / (1 + e * s)) / (2 * e))

    q0, q1, q2 = (q_of(math.sin(math.radians(v)), math.log) for v in (lat0, lat1, lat2))
    m1, m2 = (math.cos(math.radians(v)) / math.sqrt(1 - E2 * math.sin(math.radians(v)) ** 2) for v in (lat1, lat2))
    n = (m1 * m1 - m2 * m2) / (q2 - q1)
    c = m1 * m1 + n * q1
    rho0 = A * math.sqrt(c - n * q0) / n
    rho = A * F.sqrt(c - n * q_of(F.sin(F.radians(lat)), F.ln)) / n
    theta = n * F.radians(lon - lon0)
    return [rho * F.sin(theta), north + rho0 - rho * F.cos(theta)]


def geodetic(x: Column, y: Column, z: Column) -> list[Column]:
    """Longitude, latitude and height of earth-centred coordinates (one-step closed form)."""
    b = A * (1 - FLATTENING)
    second = (A * A - b * b) / (b * b)
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * A, p * b)
    lat = F.atan2(z + second * b * F.pow(F.sin(theta), 3), p - E2 * A * F.pow(F.cos(theta), 3))
    radius = A / F.sqrt(1 - E2 * F.pow(F.sin(lat), 2))
    return [F.degrees(F.atan2(y, x)), F.degrees(lat), p / F.cos(lat) - radius]
