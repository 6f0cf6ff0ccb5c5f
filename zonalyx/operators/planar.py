"""Polygons as planes cut by edges: noding, faces by odd-even, rings.

All edges of one or two polygons are cut where they meet. A piece belongs to the
boundary of the result if the result lies on exactly one side of it; which side holds a
polygon follows from the pieces above the middle of the piece. Boundary pieces, with
the result on their left, are walked into rings that do not cross. Coordinates are
rounded to a grid of 1e-11 of the extent first, so that pieces meet in equal points.
Work is numpy over arrays of edges; edges meet in cells, not all against all. Many
small planes are cut at once: their edges lie in one array, and meet within their plane.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Grid of coordinates, as a part of the extent.
GRID = 1e-11
#: Edges of a plane whose pairs are all looked at; those of larger ones meet in cells.
FEW = 24
#: Edges of planes that are cut together.
AT_ONCE = 2048


def _edges(rings: list) -> np.ndarray:
    """(n, 4) of the rings' edges; open rings are closed, rings of fewer than three points left out."""
    out = []
    for r in [] if rings is None else rings:
        p = np.array([(q["x"], q["y"]) for q in ([] if r is None else r)], float).reshape(-1, 2)
        p = p[np.isfinite(p).all(1)]
        if len(p) and (p[0] != p[-1]).any():
            p = np.vstack([p, p[:1]])
        if len(p) > 3:
            out.append(np.hstack([p[:-1], p[1:]]))
    return np.vstack(out) if out else np.empty((0, 4))


def _spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for every whole number from low to high of each row."""
    n = high - low + 1
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]


def _matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with a[i] == b[j]."""
    order = np.argsort(b, kind="stable")
    left, right = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    i, at = _spans(left, right - 1)
    return i, order[at]


def _starts(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and number of rows of each plane; of is sorted."""
    n = np.bincount(of)
    return np.cumsum(n) - n, n


def _candidates(e: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of edges of one plane whose boxes meet."""
    x0, x1 = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    y0, y1 = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    start, n = _starts(of)
    few = np.flatnonzero(n[of] <= FEW)
    row, j = _spans(few + 1, (start + n)[of[few]] - 1)
    i = few[row]
    keep = (x0[i] <= x1[j]) & (x0[j] <= x1[i]) & (y0[i] <= y1[j]) & (y0[j] <= y1[i])
    i, j = [i[keep]], [j[keep]]
    for k in np.flatnonzero(n > FEW):
        a, b = _by_cells(e[start[k] : start[k] + n[k]])
        i.append(a + start[k])
        j.append(b + start[k])
    return np.concatenate(i), np.concatenate(j)


def _by_cells(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of edges whose boxes meet, by the cells of a grid of about one edge's size."""
    x0, x1 = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    y0, y1 = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    sides = max(1, math.isqrt(len(e)))
    size = max((x1.max() - x0.min()) / sides, (y1.max() - y0.min()) / sides, float(np.median(np.maximum(x1 - x0, y1 - y0))), 1e-300)
    cx0, cx1 = ((v - x0.min()) // size for v in (x0, x1))
    cy0, cy1 = ((v - y0.min()) // size for v in (y0, y1))
    row, gx = _spans(cx0.astype(np.int64), cx1.astype(np.int64))
    again, gy = _spans(cy0.astype(np.int64)[row], cy1.astype(np.int64)[row])
    edge, cell = row[again], gx[again] * (sides + 2) * 4 + gy
    i, j = _matches(cell, cell)
    i, j = edge[i], edge[j]
    keep = (i < j) & (x0[i] <= x1[j]) & (x0[j] <= x1[i]) & (y0[i] <= y1[j]) & (y0[j] <= y1[i])
    pairs = np.unique(np.stack([i[keep], j[keep]], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _pieces(e: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges on whole coordinates cut where they meet: pieces and the edge each is of."""
    i, j = _candidates(e, of)
    p, r, q, s = e[i, :2], e[i, 2:] - e[i, :2], e[j, :2], e[j, 2:] - e[j, :2]
    cross = r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0]
    gap = q - p
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[:, 0] * s[:, 1] - gap[:, 1] * s[:, 0]) / cross
        u = (gap[:, 0] * r[:, 1] - gap[:, 1] * r[:, 0]) / cross
    hit = (cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    point = np.rint(p[hit] + t[hit, None] * r[hit])
    edge, cut = np.concatenate([i[hit], j[hit]]), np.vstack([point, point])
    # ends that lie on another edge, within the grid: collinear edges and touching ones
    for a, b in ((i, j), (j, i)):
        for end in (e[b, :2], e[b, 2:]):
            d = e[a, 2:] - e[a, :2]
            off = np.abs(d[:, 0] * (end[:, 1] - e[a, 1]) - d[:, 1] * (end[:, 0] - e[a, 0]))
            along = ((end - e[a, :2]) * d).sum(1)
            on = (off <= np.hypot(d[:, 0], d[:, 1])) & (along > 0) & (along < (d * d).sum(1))
            edge, cut = np.concatenate([edge, a[on]]), np.vstack([cut, end[on]])
    edge = np.concatenate([edge, np.arange(len(e)), np.arange(len(e))])
    cut = np.vstack([cut, e[:, :2], e[:, 2:]])
    along = ((cut - e[edge, :2]) * (e[edge, 2:] - e[edge, :2])).sum(1)
    order = np.lexsort((along, edge))
    edge, cut = edge[order], cut[order]
    same = (edge[1:] == edge[:-1]) & (cut[1:] != cut[:-1]).any(1)
    return np.hstack([cut[:-1], cut[1:]])[same], edge[:-1][same]


def _columns(asked: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of an asked row and one whose width may hold its middle, by columns of the plane."""
    x0, x1 = own[:, 0], own[:, 2]
    width = max((x1.max() - x0.min()) / len(own), 1e-300)
    at = lambda v: ((v - x0.min()) // width).astype(np.int64)
    row, column = _spans(at(x0), at(x1))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for part in np.array_split(asked, max(1, len(asked) // 2048)):
        cell = at((x0[part] + x1[part]) / 2)
        i, k = _spans(np.searchsorted(column, cell, "left"), np.searchsorted(column, cell, "right") - 1)
        yield part[i], row[k]


def _above(asked: np.ndarray, own: np.ndarray, odd: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For the rows of own that are asked: of how many pieces of each polygon of their plane, mod 2, lie over their middle. A plane has no equal rows."""
    x0, x1 = own[:, 0], own[:, 2]
    mx, my = (x0 + x1) / 2, (own[:, 1] + own[:, 3]) / 2
    out = np.zeros_like(odd)

    def count(i: np.ndarray, j: np.ndarray) -> None:
        over = (x0[j] <= mx[i]) & (mx[i] < x1[j]) & (i != j)
        i, j = i[over], j[over]
        high = own[j, 1] + (mx[i] - x0[j]) * (own[j, 3] - own[j, 1]) / (x1[j] - x0[j]) > my[i]
        np.add.at(out, i[high], odd[j[high]])

    start, n = _starts(of)
    few = asked[n[of[asked]] <= FEW]
    row, j = _spans(start[of[few]], (start + n)[of[few]] - 1)
    count(few[row], j)
    rest = asked[n[of[asked]] > FEW]
    for k in np.unique(of[rest]):
        for i, j in _columns(rest[of[rest] == k] - start[k], own[start[k] : start[k] + n[k]]):
            count(i + start[k], j + start[k])
    return out[asked] & 1


def _walk(starts: list[tuple], ends: list[tuple]) -> list[list[int]]:
    """Rings of pieces with the inside on their left: at a point the next piece is the first one clockwise from the way back."""
    leaving: dict[tuple[float, float], list[int]] = {}
    for k, p in enumerate(starts):
        leaving.setdefault(p, []).append(k)
    used, rings = [False] * len(starts), []
    for first in range(len(starts)):
        if used[first]:
            continue
        ring, k = [], first
        while not used[k]:
            used[k] = True
            ring.append(k)
            here = ends[k]
            free = [m for m in leaving.get(here, ()) if not used[m] or m == first]
            if not free:
                ring = []
                break
            if len(free) > 1:
                back = math.atan2(starts[k][1] - here[1], starts[k][0] - here[0])
                turn = lambda m, back=back, here=here: (back - math.atan2(ends[m][1] - here[1], ends[m][0] - here[0])) % (2 * math.pi) or 2 * math.pi
                free.sort(key=turn)
            k = free[0]
        if len(ring) > 2:
            rings.append(ring)
    return rings


def region(*polygons: list) -> tuple[list[np.ndarray], float]:
    """Closed rings around what all polygons hold by odd-even, and its area.

    Outer rings turn left, holes right, none crosses itself or another. One polygon
    gives its repaired form. Nothing in common gives no rings and 0.0.
    """
    return regions([polygons])[0]


def regions(planes: list[tuple]) -> list[tuple[list[np.ndarray], float]]:
    """region of each of many tuples of as many polygons."""
    return [r for k in range(0, len(planes), 256) for r in _regions(planes[k : k + 256])]


def _regions(planes: list[tuple]) -> list[tuple[list[np.ndarray], float]]:
    parts = [[_edges(p) for p in polygons] for polygons in planes]
    sizes = [len(x) for ps in parts for x in ps]
    m = len(parts[0])
    points, ring, at, area = cut_planes(
        np.vstack([x for ps in parts for x in ps]),
        np.repeat(np.repeat(np.arange(len(parts)), m), sizes),
        np.repeat(np.tile(np.arange(m), len(parts)), sizes),
        len(parts),
        m,
    )
    rings: list[list[np.ndarray]] = [[] for _ in parts]
    for k, r in zip(at, np.split(points, np.cumsum(ring)[:-1]), strict=False):
        rings[k].append(r)
    return list(zip(rings, area.tolist(), strict=True))


def ring_edges(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) of the edges of rings that lie one after another, and each edge's ring; as _edges for many rings."""
    fine = np.isfinite(x) & np.isfinite(y)
    p, ring = np.column_stack([x, y])[fine], ring[fine]
    if not len(p):
        return np.empty((0, 4)), ring
    last = np.append(ring[1:] != ring[:-1], True)
    ends = np.flatnonzero(last)
    begins = np.append(0, ends[:-1] + 1)
    again = np.arange(1, len(p) + 1)
    again[ends] = begins
    is_open = (p[begins] != p[ends]).any(1)
    points = ends - begins + 1 + is_open
    keep = np.repeat(points > 3, ends - begins + 1)
    keep[ends] &= is_open
    return np.hstack([p, p[again]])[keep], ring[keep]


def cut_planes(e: np.ndarray, of: np.ndarray, owner: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Regions of n planes of m polygons each: the points of all rings, each ring's number of points and plane, and the planes' areas.

    Edge k is of polygon owner[k] of plane of[k], and of is sorted. So many planes at a
    time are cut that the arrays stay small; a plane of more than FEW edges is cut alone.
    """
    start, size = np.searchsorted(of, np.arange(n)), np.bincount(of, minlength=n)
    large = np.append(np.flatnonzero(size > FEW), n)
    found, first = [], 0
    while first < n:
        least = int(np.searchsorted(start + size, start[first] + AT_ONCE, "right"))
        end = max(first + 1, min(least, int(large[np.searchsorted(large, first)])))
        rows = slice(start[first], start[end - 1] + size[end - 1])
        points, ring, at, area = _cut(e[rows], of[rows] - first, owner[rows], end - first, m)
        found.append((points, ring, at + first, area))
        first = end
    found = found or [_nothing(0)]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _nothing(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.empty((0, 2)), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(n)


def _cut(e: np.ndarray, of: np.ndarray, owner: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    held = np.zeros((n, m), bool)
    held[of, owner] = True
    whole = held.all(1)[of]  # a polygon without edges holds nothing
    e, of, owner = e[whole], of[whole], owner[whole]
    if not len(e):
        return _nothing(n)
    low, high = np.full((n, 2), np.inf), np.full((n, 2), -np.inf)
    for end in (e[:, :2], e[:, 2:]):
        np.minimum.at(low, of, end)
        np.maximum.at(high, of, end)
    some = np.isfinite(low).all(1)
    grid = np.where(some, np.maximum(np.where(some[:, None], high - low, 0.0).max(1), 1e-300) * GRID, 1.0)
    e = np.rint((e - np.tile(low, 2)[of]) / grid[of, None])
    live = (e[:, :2] != e[:, 2:]).any(1)
    e, of, owner = e[live], of[live], owner[live]
    if not len(e):
        return _nothing(n)
    pieces, edge = _pieces(e, of)
    of, owner = of[edge], owner[edge]
    for _ in range(4):  # rounding of cuts may make pieces meet anew
        again, parent = _pieces(pieces, of)
        moved = np.bincount(of, minlength=n) != np.bincount(of[parent], minlength=n)
        if not moved.any():
            break
        stay, go = ~moved[of], moved[of[parent]]
        source = np.concatenate([np.flatnonzero(stay), parent[go]])
        pieces, order = np.vstack([pieces[stay], again[go]]), np.argsort(of[source], kind="stable")
        pieces, of, owner = pieces[order], of[source][order], owner[source][order]
    # pieces point to larger x, then larger y; equal ones of a polygon cancel in pairs
    turned = (pieces[:, 0] > pieces[:, 2]) | ((pieces[:, 0] == pieces[:, 2]) & (pieces[:, 1] > pieces[:, 3]))
    pieces[turned] = pieces[turned][:, [2, 3, 0, 1]]
    order = np.lexsort((pieces[:, 3], pieces[:, 2], pieces[:, 1], pieces[:, 0], of))
    pieces, of, owner = pieces[order], of[order], owner[order]
    new = np.append(True, (pieces[1:] != pieces[:-1]).any(1) | (of[1:] != of[:-1]))
    own, count = pieces[new], np.zeros((int(new.sum()), m), np.int64)
    np.add.at(count, (np.cumsum(new) - 1, owner), 1)
    odd, of = count & 1, of[new]
    own, odd, of = own[odd.any(1)], odd[odd.any(1)], of[odd.any(1)]
    if not len(own):
        return _nothing(n)
    # which polygons hold the points just above each piece; for a vertical one, those of larger x
    above = np.zeros_like(odd)
    level = own[:, 0] < own[:, 2]
    if level.any():
        above[level] = _above(np.flatnonzero(level), own, odd, of)
    if not level.all():
        swapped = own[:, [1, 0, 3, 2]]
        down = swapped[:, 0] > swapped[:, 2]
        swapped[down] = swapped[down][:, [2, 3, 0, 1]]
        above[~level] = _above(np.flatnonzero(~level), swapped, odd, of)
    # left of a piece that points to larger x is above it, left of one that points up is smaller x
    left = np.where(level[:, None], above, above ^ odd)
    inner_left, inner_right = left.all(1), (left ^ odd).all(1)
    border = inner_left != inner_right
    own, inner_left, of = own[border], inner_left[border], of[border]
    if not len(own):
        return _nothing(n)
    start, end = np.where(inner_left[:, None], own[:, :2], own[:, 2:]), np.where(inner_left[:, None], own[:, 2:], own[:, :2])
    starts, ends, walked, length = list(map(tuple, start.tolist())), list(map(tuple, end.tolist())), [], []
    for a, b in zip(*_starts(of), strict=True):
        for r in _walk(starts[a : a + b], ends[a : a + b]):
            walked += [a + k for k in r]
            length.append(len(r))
    if not length:
        return _nothing(n)
    at, length = np.array(walked), np.array(length)
    begins = np.cumsum(length) - length
    p, q, plane, ring = start[at], end[at], of[at[begins]], np.repeat(np.arange(len(length)), length)
    area = np.zeros(n)
    np.add.at(area, plane, np.add.reduceat(p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1], begins) / 2)
    way, after = q - p, np.arange(1, len(p) + 1)
    after[begins + length - 1] = begins
    corner = way[:, 0] * way[after, 1] - way[:, 1] * way[after, 0] != 0
    left = np.bincount(ring[corner], minlength=len(length))
    corner &= left[ring] > 2
    corners, ring = q[corner], ring[corner]
    plane, left = plane[left > 2], left[left > 2]
    # closed: each ring begins with its last corner
    first = np.cumsum(left) - left
    points = np.insert(corners, first, corners[first + left - 1], axis=0)
    k = np.repeat(plane, left + 1)
    return points * grid[k, None] + low[k], left + 1, plane, area * grid * grid
