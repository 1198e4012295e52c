"""Shapes rendered one by one, to hold the library's batches to."""

import math

import numpy as np

from geoloom.functions import mvt
from geoloom.operators import geometry as G
from geoloom.operators.render import BUFFER, EXTENT, LAST_TOLERANCE, TOLERANCE
from geoloom.operators.render import pieces_of as pieces_of_batch
from geoloom.operators.shapes import Rings, rounded


def simplify(kind: int, shape: list, eps: float) -> list:
    least = 4 if kind == mvt.POLYGON else 2
    out = []
    for part in shape:
        kept = [r[G.rdp_mask(r, eps)] for r in part]
        if kind == mvt.POLYGON and len(kept[0]) < least:
            continue
        kept = [r for r in kept if len(r) >= least]
        if kept:
            out.append(kept)
    return out


def cut(kind: int, shape: list, low: tuple, high: tuple) -> list:
    """The shape inside a rectangle; a polygon goes with its outer ring."""
    out = []
    for part in shape:
        kept = []
        for i, r in enumerate(part):
            a, b = r.min(axis=0), r.max(axis=0)
            if (b < low).any() or (a > high).any():
                pieces = []
            elif (a >= low).all() and (b <= high).all():
                pieces = [r]
            elif kind == mvt.POINT:
                pieces = [r[((r >= low) & (r <= high)).all(axis=1)]]
            elif kind == mvt.LINE:
                pieces = G.clip_line(r, low, high)
            else:
                pieces = [G.clip_ring(r, low, high)]
            pieces = [p for p in pieces if len(p)]
            if kind == mvt.POLYGON and i == 0 and not pieces:
                break
            kept += pieces
        if kept:
            out.append(kept)
    return out


def quantised(kind: int, shape: list, origin: tuple) -> list:
    out = []
    for part in shape:
        kept = []
        for i, r in enumerate(part):
            q = rounded(r - origin)
            if kind != mvt.POINT:
                q = q[np.concatenate([[True], (q[1:] != q[:-1]).any(axis=1)])]
            if kind == mvt.LINE and len(q) < 2:
                continue
            if kind == mvt.POLYGON:
                area = int((q[:-1, 0] * q[1:, 1] - q[1:, 0] * q[:-1, 1]).sum())
                if len(q) < 4 or not area:
                    if i == 0:
                        break
                    continue
                if (area > 0) != (i == 0):
                    q = q[::-1]
            kept.append(q)
        if kept:
            out.append(kept)
    return out


def shape_size(kind: int, shape: list[list[np.ndarray]]) -> float:
    """Length of lines, or the root of the area of polygons without their holes, in the shape's units; 0 for points."""
    if kind == mvt.LINE:
        return float(sum(np.hypot(*np.diff(r, axis=0).T).sum() for part in shape for r in part))
    if kind != mvt.POLYGON:
        return 0.0
    total = 0.0
    for part in shape:
        # taken from the ring's first point, as areas are small beside the coordinates
        areas = [abs(float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum())) / 2 for x, y in ((r - r[0]).T for r in part)]
        total += max(0.0, areas[0] - sum(areas[1:]))
    return math.sqrt(total)


def pieces_of(kind: int, shape: list[list[np.ndarray]], low: int, high: int):
    """(z, x, y, size in pixels, command stream) for each tile that a feature (unit square) falls in, last zoom first.

    The shape is simplified further from zoom to zoom. It ends where nothing is left or, below the last zoom, where it
    is smaller than a pixel (see shape_size). Tiles don't wrap at the antimeridian.
    """
    for z in range(high, low - 1, -1):
        n = 1 << z
        if kind != mvt.POINT:
            shape = simplify(kind, shape, (LAST_TOLERANCE if z == high else TOLERANCE) / (256 * n))
        if not shape:
            return
        ends = np.array([f for part in shape for r in part for f in (r.min(axis=0), r.max(axis=0))])
        first, last = ends.min(axis=0), ends.max(axis=0)
        size = shape_size(kind, shape) * 256 * n
        if kind != mvt.POINT and z < high and size < 1:
            return
        world = [[r * float(EXTENT * n) for r in part] for part in shape]
        span = [int(v) for v in np.clip(np.floor(np.concatenate([first * n - BUFFER / EXTENT, last * n + BUFFER / EXTENT])), 0, n - 1)]
        work = [(world, *span)]
        while work:
            inside, x0, y0, x1, y1 = work.pop()
            inside = cut(kind, inside, (x0 * EXTENT - BUFFER, y0 * EXTENT - BUFFER), ((x1 + 1) * EXTENT + BUFFER, (y1 + 1) * EXTENT + BUFFER))
            if not inside:
                continue
            if x0 == x1 and y0 == y1:
                made = quantised(kind, inside, (x0 * EXTENT, y0 * EXTENT))
                if made:
                    yield z, x0, y0, size, mvt.commands(kind, made)
            elif x1 - x0 >= y1 - y0:
                mid = (x0 + x1) // 2
                work += [(inside, mid + 1, y0, x1, y1), (inside, x0, y0, mid, y1)]
            else:
                mid = (y0 + y1) // 2
                work += [(inside, x0, mid + 1, x1, y1), (inside, x0, y0, x1, mid)]


def rings_of(shapes: list) -> Rings:
    """The library's batch of shapes (lists of parts of rings); the item is the place in the list."""
    own = [(i, n, k == 0, r) for i, shape in enumerate(shapes) for n, part in enumerate(shape) for k, r in enumerate(part)]
    at = np.cumsum([0] + [len(r) for *_, r in own])
    return Rings(np.concatenate([r for *_, r in own]).astype(float), at, *(np.array([o[c] for o in own]) for c in range(3)))


def batch_pieces(kinds: list[int], shapes: list, starts: list[int], high: int) -> dict:
    """(item, z, x, y): (size, command stream) as the library's batches have it."""
    out = {}
    for z, item, x, y, size, streams, at in pieces_of_batch(rings_of(shapes), np.array(kinds), np.array(starts), high):
        for n, (i, a, b) in enumerate(zip(item.tolist(), x.tolist(), y.tolist())):
            assert (i, z, a, b) not in out
            out[i, z, a, b] = (size[n], streams[at[n] : at[n + 1]].tolist())
    return out
