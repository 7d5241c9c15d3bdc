"""Transverse Mercator on the WGS84 ellipsoid by Krüger's series to the fourth order, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import num

A, FLATTENING, K0, FALSE_EAST = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0
N = FLATTENING / (2 - FLATTENING)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
#: Coefficients of the published series.
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
E = (FLATTENING * (2 - FLATTENING)) ** 0.5


def _atanh(x: Column) -> Column:
    return num(0.5) * F.log((num(1) + x) / (num(1) - x))


def forward(lon: Column, lat: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """Easting and northing in a UTM zone from degrees."""
    phi, lam = F.radians(lat), F.radians(lon - num(zone * 6 - 183))
    t = F.sinh(_atanh(F.sin(phi)) - num(E) * _atanh(num(E) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), _atanh(F.sin(lam) / F.sqrt(num(1) + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + num(a) * F.cos(num(2 * j) * xi) * F.sinh(num(2 * j) * eta)
        y = y + num(a) * F.sin(num(2 * j) * xi) * F.cosh(num(2 * j) * eta)
    return num(FALSE_EAST) + num(K0 * RADIUS) * x, num(0 if north else 1e7) + num(K0 * RADIUS) * y


def inverse(east: Column, north_m: Column, zone: int, north: bool = True, rounds: int = 5) -> tuple[Column, Column]:
    """Degrees from easting and northing; latitude by fixed-point rounds on the conformal latitude."""
    xi, eta = (north_m - num(0 if north else 1e7)) / num(K0 * RADIUS), (east - num(FALSE_EAST)) / num(K0 * RADIUS)
    x, y = eta, xi
    for j, b in enumerate(BETA, 1):
        x = x - num(b) * F.cos(num(2 * j) * xi) * F.sinh(num(2 * j) * eta)
        y = y - num(b) * F.sin(num(2 * j) * xi) * F.cosh(num(2 * j) * eta)
    chi = F.asin(F.sin(y) / F.cosh(x))
    lam = F.atan2(F.sinh(x), F.cos(y))
    sine = F.sin(chi)
    for _ in range(rounds):
        sine = F.tanh(_atanh(F.sin(chi)) + num(E) * _atanh(num(E) * sine))
    return F.degrees(lam) + num(zone * 6 - 183), F.degrees(F.asin(sine))
