"""Transverse Mercator on WGS 84 as column expressions, and reprojection of geographic grids to UTM."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from talusgrid.grid import Georef, Grid

# The ellipsoid and the scale and false origin of UTM.
A, FLATTENING, K0, EAST0, NORTH0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Series in the third flattening (Krueger): to the plane, and back.
ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def to_utm(lon: float, lat: float, zone: int) -> tuple[float, float]:
    """Easting and northing of a point; a negative zone is a southern one."""
    lam, phi = math.radians(lon - (abs(zone) * 6 - 183)), math.radians(lat)
    c = 2 * math.sqrt(_N) / (1 + _N)
    t = math.sinh(math.atanh(math.sin(phi)) - c * math.atanh(c * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.sqrt(1 + t * t))
    x = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    y = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    return EAST0 + K0 * _RADIUS * x, (NORTH0 if zone < 0 else 0.0) + K0 * _RADIUS * y


@dataclass(frozen=True)
class _Utm(Georef):
    """A UTM georeference whose x and y are longitude and latitude of its cells."""

    zone: int = 1

    def _lonlat(self) -> tuple[Column, Column]:
        east, north = super().x(), super().y()
        xi = (north - (NORTH0 if self.zone < 0 else 0.0)) / (K0 * _RADIUS)
        eta = (east - EAST0) / (K0 * _RADIUS)
        x, y = eta, xi
        for j, b in enumerate(BETA, 1):
            x = x - F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * b
            y = y - F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * b
        chi = F.asin(F.sin(y) / F.cosh(x))
        phi = chi
        for j, d in enumerate(DELTA, 1):
            phi = phi + F.sin(chi * (2 * j)) * d
        return F.degrees(F.atan2(F.sinh(x), F.cos(y))) + float(abs(self.zone) * 6 - 183), F.degrees(phi)

    def x(self, col: Column | str = "col") -> Column:
        return self._lonlat()[0]

    def y(self, row: Column | str = "row") -> Column:
        return self._lonlat()[1]


def convert_to_utm(grid: Grid, dx: float, zone: int | None = None) -> Grid:
    """A geographic grid on a UTM grid of spacing dx, by cubic convolution at each new cell's place."""
    from talusgrid.operators.tiling import cubic
    from talusgrid.sources.rasters import projection_of

    geo = grid.geo
    zone = zone or geo.utm_zone()
    x0, x1, y0, y1 = geo.bounds
    corners = [to_utm(x, y, zone) for x in (x0, x1) for y in (y0, y1)]
    east, north = min(c[0] for c in corners), min(c[1] for c in corners)
    nx, ny = int((max(c[0] for c in corners) - east) / dx) + 1, int((max(c[1] for c in corners) - north) / dx) + 1
    projection = projection_of((32600 if zone > 0 else 32700) + abs(zone))
    out = cubic(grid, _Utm(nx, ny, dx, east, north, projection, False, zone))
    return Grid(out.cells, Georef(nx, ny, dx, east, north, projection))
