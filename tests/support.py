"""Small grids as arrays and back, and plain reference algorithms."""

from __future__ import annotations

import heapq
import math

import numpy as np

from talusgrid.grid import Grid

STEPS = {1: (0, 1), 2: (1, 1), 4: (1, 0), 8: (1, -1), 16: (0, -1), 32: (-1, -1), 64: (-1, 0), 128: (-1, 1)}


def array(grid: Grid, band: str = "value") -> np.ndarray:
    out = np.full((grid.geo.ny, grid.geo.nx), np.nan)
    for r in grid.cells.select("row", "col", band).collect():
        out[r["row"], r["col"]] = np.nan if r[band] is None else r[band]
    return out


def receivers(codes: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
    ny, nx = codes.shape
    out = {}
    for (i, j), c in np.ndenumerate(codes):
        if int(c) in STEPS:
            a, b = i + STEPS[int(c)][0], j + STEPS[int(c)][1]
            if 0 <= a < ny and 0 <= b < nx:
                out[i, j] = (a, b)
    return out


def in_order(z: np.ndarray) -> list[tuple[int, int]]:
    nx = z.shape[1]
    return sorted(np.ndindex(z.shape), key=lambda c: (-z[c], c[0] * nx + c[1]))


def ordered_area(codes: np.ndarray, z: np.ndarray, pixel: float) -> np.ndarray:
    to, out = receivers(codes), np.full(z.shape, pixel)
    for c in in_order(z):
        if c in to:
            out[to[c]] += out[c]
    return out


def ordered_length(codes: np.ndarray, z: np.ndarray, dx: float) -> np.ndarray:
    to, out = receivers(codes), np.zeros(z.shape)
    for c in in_order(z):
        if c in to:
            step = dx * (1.41421356 if int(codes[c]) in (2, 8, 32, 128) else 1.0)
            out[to[c]] = max(out[to[c]], out[c] + step)
    return out


def heap_fill(z: np.ndarray) -> np.ndarray:
    w, ny, nx = z.copy(), *z.shape
    closed = np.zeros(z.shape, bool)
    heap = [(z[i, j], i, j) for i, j in np.ndindex(z.shape) if i in (0, ny - 1) or j in (0, nx - 1)]
    for _, i, j in heap:
        closed[i, j] = True
    heapq.heapify(heap)
    while heap:
        level, i, j = heapq.heappop(heap)
        for a in range(max(i - 1, 0), min(i + 2, ny)):
            for b in range(max(j - 1, 0), min(j + 2, nx)):
                if not closed[a, b]:
                    closed[a, b] = True
                    w[a, b] = max(w[a, b], level)
                    heapq.heappush(heap, (w[a, b], a, b))
    return w


def disc(r: float) -> list[tuple[int, int]]:
    n = math.ceil(r)
    return [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if math.hypot(i, j) < r]
