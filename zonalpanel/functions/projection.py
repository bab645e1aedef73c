"""Map projections as Column arithmetic (no Python on the row path)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 ellipsoid and the TM2 zone of EPSG:3826.
GRS80_A = 6378137.0
GRS80_F = 1 / 298.257222101
TM2_LON0 = 121.0
TM2_K0 = 0.9999
TM2_FALSE_EASTING = 250000.0

# Fixed value: sphere radius of EPSG:3857.
MERCATOR_R = 6378137.0

# Third flattening and the rectifying radius (Kruger series in n, order 3).
_N = GRS80_F / (2 - GRS80_F)
_A = GRS80_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96,
    _N**2 / 48 + _N**3 / 15,
    17 * _N**3 / 480,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3,
    7 * _N**2 / 3 - 8 * _N**3 / 5,
    56 * _N**3 / 15,
)


def tm2_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3826 easting / northing in metres to longitude / latitude in degrees."""
    xi = y / F.lit(TM2_K0 * _A)
    eta = (x - F.lit(TM2_FALSE_EASTING)) / F.lit(TM2_K0 * _A)
    xi_p, eta_p = xi, eta
    for j, beta in enumerate(_BETA, start=1):
        k = F.lit(2.0 * j)
        xi_p = xi_p - F.lit(beta) * F.sin(k * xi) * F.cosh(k * eta)
        eta_p = eta_p - F.lit(beta) * F.cos(k * xi) * F.sinh(k * eta)
    chi = F.asin(F.sin(xi_p) / F.cosh(eta_p))
    lat = chi
    for j, delta in enumerate(_DELTA, start=1):
        lat = lat + F.lit(delta) * F.sin(F.lit(2.0 * j) * chi)
    lon = F.lit(TM2_LON0) + F.degrees(F.atan2(F.sinh(eta_p), F.cos(xi_p)))
    return lon, F.degrees(lat)


def lonlat_to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 degrees to EPSG:3857 metres."""
    x = F.lit(MERCATOR_R) * F.radians(lon)
    y = F.lit(MERCATOR_R) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))
    return x, y


def reproject_xy(x: Column, y: Column, src: int, dst: int) -> tuple[Column, Column]:
    """Coordinates from one EPSG code to another, for the codes in use here."""
    if src == dst:
        return x, y
    if (src, dst) == (3826, 4326):
        return tm2_to_lonlat(x, y)
    if (src, dst) == (4326, 3857):
        return lonlat_to_mercator(x, y)
    if (src, dst) == (3826, 3857):
        return lonlat_to_mercator(*tm2_to_lonlat(x, y))
    raise ValueError(f"no projection from EPSG:{src} to EPSG:{dst}")
