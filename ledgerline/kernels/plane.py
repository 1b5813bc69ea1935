"""Plane figures: rings, winding, overlay, buffer, containment and arcs. Plain Python and numpy, no Spark.

A ring is a list of (x, y), not closed; a figure is a list of rings, outer ones counter-clockwise and holes
clockwise. Every operation works from the lowest corner of its operands, so that large coordinates do not
cost digits, and takes the tolerance that its answer is to be read at.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable

import numpy as np

Point = tuple[float, float]
Ring = list[Point]
Figure = list[Ring]


def area(ring: Ring) -> float:
    """Signed area, positive if counter-clockwise."""
    if len(ring) < 3:
        return 0.0
    x0, y0 = ring[0]
    total = 0.0
    for (x, y), (u, v) in zip(ring, ring[1:] + ring[:1], strict=True):
        total += (x - x0) * (v - y0) - (u - x0) * (y - y0)
    return total / 2


def perimeter(ring: Ring) -> float:
    return sum(math.dist(a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def centroid(ring: Ring) -> Point | None:
    x0, y0 = ring[0]
    total = mx = my = 0.0
    for (x, y), (u, v) in zip(ring, ring[1:] + ring[:1], strict=True):
        x, y, u, v = x - x0, y - y0, u - x0, v - y0
        cross = x * v - u * y
        total, mx, my = total + cross, mx + (x + u) * cross, my + (y + v) * cross
    return (x0 + mx / (3 * total), y0 + my / (3 * total)) if total else None


def winding(p: Point, rings: Iterable[Ring]) -> int:
    """How often the rings go round a point, counter-clockwise."""
    x, y = p
    total = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if ay <= y < by and (bx - ax) * (y - ay) > (x - ax) * (by - ay):
                total += 1
            elif by <= y < ay and (bx - ax) * (y - ay) < (x - ax) * (by - ay):
                total -= 1
    return total


def to_segment(p: Point, a: Point, b: Point) -> float:
    """Distance of a point from a segment."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    square = dx * dx + dy * dy
    t = 0.0 if square == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / square))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def sides(rings: Iterable[Ring]) -> list[tuple[Point, Point]]:
    return [(a, b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]


def clearance(p: Point, figure: Figure) -> float:
    """Distance to the nearest side of the figure, holes included; negative outside."""
    d = min(to_segment(p, a, b) for a, b in sides(figure))
    return d if winding(p, figure) else -d


def meet(a: Point, b: Point, c: Point, d: Point) -> Point | None:
    """Where two segments that are not parallel cross."""
    rx, ry, sx, sy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
    cross = rx * sy - ry * sx
    if cross == 0:
        return None
    t = ((c[0] - a[0]) * sy - (c[1] - a[1]) * sx) / cross
    u = ((c[0] - a[0]) * ry - (c[1] - a[1]) * rx) / cross
    return (a[0] + t * rx, a[1] + t * ry) if 0 <= t <= 1 and 0 <= u <= 1 else None


class _Interner:
    """Points taken to the first one within the tolerance, by a grid of cells of that size."""

    def __init__(self, tolerance: float):
        self.t, self.cells, self.points = tolerance, defaultdict(list), []

    def _cell(self, p: Point) -> tuple[int, int]:
        return math.floor(p[0] / self.t), math.floor(p[1] / self.t)

    def find(self, p: Point) -> int | None:
        i, j = self._cell(p)
        near = [(math.dist(p, self.points[k]), k) for u in (i - 1, i, i + 1) for v in (j - 1, j, j + 1) for k in self.cells.get((u, v), ())]
        best = min(near, default=None)
        return best[1] if best and best[0] <= self.t else None

    def add(self, p: Point) -> int:
        k = self.find(p)
        if k is None:
            k = len(self.points)
            self.points.append(p)
            self.cells[self._cell(p)].append(k)
        return k


def _crossings(one: np.ndarray, others: np.ndarray) -> list[Point]:
    """Where one segment crosses others."""
    r, s = one[2:] - one[:2], others[:, 2:] - others[:, :2]
    cross = r[0] * s[:, 1] - r[1] * s[:, 0]
    slanted = cross != 0
    others, s, cross = others[slanted], s[slanted], cross[slanted]
    dx, dy = others[:, 0] - one[0], others[:, 1] - one[1]
    t, u = (dx * s[:, 1] - dy * s[:, 0]) / cross, (dx * r[1] - dy * r[0]) / cross
    t = t[(t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)]
    return [(float(x), float(y)) for x, y in one[:2] + t[:, None] * r]


def _side_table(rings: Iterable[Ring]) -> np.ndarray:
    return np.array([(*a, *b) for a, b in sides(rings)]).reshape(-1, 4)


def _turns(p: Point, table: np.ndarray) -> int:
    """As ``winding``, over a table of sides."""
    ax, ay, bx, by = table.T
    x, y = p
    left = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
    return int(((ay <= y) & (y < by) & (left > 0)).sum()) - int(((by <= y) & (y < ay) & (left < 0)).sum())


def arrange(operands: list[Figure], covered: Callable[[tuple[bool, ...]], bool], tolerance: float) -> Figure:
    """The rings around all points where ``covered`` holds for the operands that cover them.

    All ends and crossings are sorted and interned; every side is split at the points that lie on it; of each
    link the operands to its left and right are found; links with the wanted area on one side only are
    chained, turning as far right as they can. Slivers thinner than the tolerance are dropped.
    """
    every = [p for f in operands for ring in f for p in ring]
    if not every:
        return []
    ox, oy = min(p[0] for p in every), min(p[1] for p in every)
    moved = [[[(x - ox, y - oy) for x, y in ring] for ring in f] for f in operands]
    segments = [(a, b) for f in moved for a, b in sides(f)]
    table = np.array([(*a, *b) for a, b in segments])
    low, high = np.minimum(table[:, :2], table[:, 2:]) - tolerance, np.maximum(table[:, :2], table[:, 2:]) + tolerance
    candidates = {p for s in segments for p in s}
    for i in range(len(table) - 1):
        near = i + 1 + np.flatnonzero((low[i + 1 :] <= high[i]).all(1) & (high[i + 1 :] >= low[i]).all(1))
        candidates.update(_crossings(table[i], table[near]))
    known = _Interner(tolerance)
    for p in sorted(candidates):
        known.add(p)
    points, spots = known.points, np.array(known.points)
    links: set[tuple[int, int]] = set()
    chains: list[list[int]] = []
    for k, (a, b) in enumerate(segments):
        i, j = known.find(a), known.find(b)
        chains.append([i])
        if i == j:
            continue
        d = table[k, 2:] - table[k, :2]
        close = np.flatnonzero((spots >= low[k]).all(1) & (spots <= high[k]).all(1))
        at = (spots[close] - table[k, :2]) @ d
        off = spots[close] - table[k, :2] - np.clip(at / (d @ d), 0, 1)[:, None] * d
        held = np.hypot(off[:, 0], off[:, 1]) <= tolerance
        on = dict(zip(close[held].tolist(), at[held].tolist(), strict=True)) | {n: float((spots[n] - table[k, :2]) @ d) for n in (i, j)}
        along = sorted(on, key=on.get)
        links |= {(min(u, v), max(u, v)) for u, v in zip(along, along[1:], strict=False)}
        chains[-1] = along[:-1]
    parts = iter(chains)  # the rings as they run through the points that lie on them
    snapped = [_side_table([[points[k] for _ in ring for k in next(parts)] for ring in f]) for f in moved]
    out: dict[int, list[int]] = defaultdict(list)
    for u, v in links:
        (ax, ay), (bx, by) = points[u], points[v]
        length = math.hypot(bx - ax, by - ay)
        step = min(tolerance, length) / 1000
        mx, my, nx, ny = (ax + bx) / 2, (ay + by) / 2, -(by - ay) / length * step, (bx - ax) / length * step
        left, right = (covered(tuple(_turns(p, f) != 0 for f in snapped)) for p in ((mx + nx, my + ny), (mx - nx, my - ny)))
        if left != right:
            out[u if left else v].append(v if left else u)
    rings = []
    while out:
        start = min(out, key=lambda k: points[k])
        ring, at, back = [], start, None
        while True:
            choices = out[at]
            if back is None or len(choices) == 1:
                follow = min(choices, key=lambda k: points[k])
            else:
                came = math.atan2(points[back][1] - points[at][1], points[back][0] - points[at][0])
                turn = lambda k: (came - math.atan2(points[k][1] - points[at][1], points[k][0] - points[at][0])) % math.tau  # noqa: B023, E731
                follow = min(choices, key=lambda k: turn(k) or math.tau)  # noqa: B023
            choices.remove(follow)
            if not choices:
                del out[at]
            ring.append(at)
            back, at = at, follow
            if at == start or at not in out:
                break
        rings.append([points[k] for k in ring])
    kept = [canonical(simplified(r)) for r in rings]
    kept = [r for r in kept if len(r) > 2 and area(r) and 2 * abs(area(r)) / perimeter(r) >= tolerance]
    return sorted([(x + ox, y + oy) for x, y in r] for r in kept)


def simplified(ring: Ring) -> Ring:
    """The ring without corners at which it goes straight on."""
    out = []
    for before, p, after in zip(ring[-1:] + ring[:-1], ring, ring[1:] + ring[:1], strict=True):
        cross = (p[0] - before[0]) * (after[1] - p[1]) - (p[1] - before[1]) * (after[0] - p[0])
        if abs(cross) > 1e-12 * math.dist(before, p) * math.dist(p, after):
            out.append(p)
    return out


def canonical(ring: Ring) -> Ring:
    """The ring from its lowest corner on."""
    if not ring:
        return ring
    k = ring.index(min(ring))
    return ring[k:] + ring[:k]


def union(a: Figure, b: Figure, tolerance: float) -> Figure:
    return arrange([a, b], any, tolerance)


def intersection(a: Figure, b: Figure, tolerance: float) -> Figure:
    if len(a) == len(b) == 1 and convex(a[0]) and convex(b[0]):
        return clipped(a[0], b[0], tolerance)
    return arrange([a, b], all, tolerance)


def convex(ring: Ring) -> bool:
    """Whether a ring turns left at every corner and goes round once."""
    if len(ring) < 3:
        return False
    ways = [math.atan2(b[1] - a[1], b[0] - a[0]) for a, b in sides([ring])]
    turns = [(after - before) % math.tau for before, after in zip(ways, ways[1:] + ways[:1], strict=True)]
    return all(0 <= t < math.pi for t in turns) and abs(sum(turns) - math.tau) < 1e-6


def clipped(ring: Ring, by: Ring, tolerance: float) -> Figure:
    """What two convex rings have in common: one is cut by each side of the other. Slivers thinner than the tolerance are dropped."""
    left = list(ring)
    for (ax, ay), (bx, by_) in sides([by]):
        dx, dy = bx - ax, by_ - ay
        length = math.hypot(dx, dy)
        off = [(dx * (y - ay) - dy * (x - ax)) / length for x, y in left]
        kept: Ring = []
        for k, p in enumerate(left):
            q, d, e = left[k - 1], off[k], off[k - 1]
            if (d > 0) != (e > 0) and d != e:
                t = e / (e - d)
                kept.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
            if d > 0:
                kept.append(p)
        left = [p for k, p in enumerate(kept) if math.dist(p, kept[k - 1]) > 1e-12 * (1 + length)] if len(kept) > 1 else []
        if len(left) < 3:
            return []
    out = canonical(simplified(left))
    return [out] if len(out) > 2 and 2 * area(out) / perimeter(out) >= tolerance else []


def difference(a: Figure, b: Figure, tolerance: float) -> Figure:
    return arrange([a, b], lambda c: c[0] and not c[1], tolerance)


def figure_area(figure: Figure) -> float:
    return sum(area(r) for r in figure)


def pieces(figure: Figure) -> list[tuple[Ring, list[Ring]]]:
    """Outer rings with their holes; a hole belongs to the smallest outer ring around it."""
    outers = sorted((r for r in figure if area(r) > 0), key=area)
    holes: list[list[Ring]] = [[] for _ in outers]
    for hole in (r for r in figure if area(r) < 0):
        for k, outer in enumerate(outers):
            if winding(((hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2), [outer]):
                holes[k].append(hole)
                break
    return list(zip(outers, holes, strict=True))


def disc(centre: Point, radius: float, tolerance: float) -> Ring:
    """A circle as a polygon whose sides stay within a quarter of the tolerance, of 8 to 1024 corners."""
    n = math.ceil(math.pi / math.acos(max(-1.0, min(1.0, 1 - tolerance / (4 * radius))))) if tolerance < 4 * radius else 8
    n = max(8, min(1024, n + n % 2))
    return [(centre[0] + radius * math.cos(math.tau * k / n), centre[1] + radius * math.sin(math.tau * k / n)) for k in range(n)]


def slab(a: Point, b: Point, width: float) -> Ring:
    """The rectangle within ``width`` to both sides of a segment."""
    length = math.dist(a, b)
    nx, ny = -(b[1] - a[1]) / length * width, (b[0] - a[0]) / length * width
    return [(a[0] - nx, a[1] - ny), (b[0] - nx, b[1] - ny), (b[0] + nx, b[1] + ny), (a[0] + nx, a[1] + ny)]


def strip(a: Point, b: Point, width: float, tolerance: float) -> Figure:
    """All points within ``width`` of a segment, as overlapping rings."""
    return [slab(a, b, width), disc(a, width, tolerance), disc(b, width, tolerance)]


def buffer(figure: Figure, distance: float, tolerance: float) -> Figure:
    """The figure grown (or shrunk, if negative) by a distance; 0 changes nothing, less than the tolerance is an error."""
    if distance == 0:
        return figure
    if abs(distance) < tolerance:
        raise ValueError("a buffer below the tolerance decides nothing")
    strips = [ring for a, b in sides(figure) if a != b for ring in strip(a, b, abs(distance), tolerance)]
    return arrange([figure, strips], any if distance > 0 else (lambda c: c[0] and not c[1]), tolerance)


def inset(ring: Ring, setbacks: list[tuple[Point, Point, float]], tolerance: float) -> Figure | None:
    """A convex ring less what lies within each setback (a, b, width) of its sides; None where half planes do not decide it.

    Where all of the ring stands above the side (its feet fall on it), what is within the width of the side is what is
    within the width of its line; so it is for any convex ring with the same setback on all sides.
    """
    if not convex(ring):
        return None
    same = len(setbacks) == len(ring) and len({w for *_, w in setbacks}) == 1 and {frozenset(s[:2]) for s in setbacks} == {frozenset(s) for s in sides([ring])}
    left = list(ring)
    for a, b, width in setbacks:
        dx, dy = b[0] - a[0], b[1] - a[1]
        length = math.hypot(dx, dy)
        if length == 0:
            return None
        along = [((x - a[0]) * dx + (y - a[1]) * dy) / length for x, y in ring]
        off = [(dx * (y - a[1]) - dy * (x - a[0])) / length for x, y in ring]
        if min(off) < -tolerance and max(off) > tolerance or not same and (min(along) < -1e-12 * length or max(along) > length * (1 + 1e-12)):
            return None
        way = 1 if max(off) > -min(off) else -1
        kept: Ring = []
        high = [way * (dx * (y - a[1]) - dy * (x - a[0])) / length - width for x, y in left]
        for k, p in enumerate(left):
            q, d, e = left[k - 1], high[k], high[k - 1]
            if (d > 0) != (e > 0):
                t = e / (e - d)
                kept.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
            if d > 0:
                kept.append(p)
        left = [p for k, p in enumerate(kept) if math.dist(p, kept[k - 1]) > 1e-12 * (1 + length)] if len(kept) > 1 else []
        if len(left) < 3:
            return []
    out = canonical(simplified(left))
    return [out] if len(out) > 2 and 2 * area(out) / perimeter(out) >= tolerance else []


def _plain_containment(a: Ring, b: Ring, tolerance: float) -> str | None:
    """``containment`` of two convex rings, where what they leave of each other is nothing or clearly more than slivers; else None."""
    common = clipped(a, b, tolerance)
    if not common:
        return None
    shared, slivers = area(common[0]), 8 * tolerance * (perimeter(a) + perimeter(b))

    def within(inner: Ring, outer: Ring) -> bool | None:
        if all((bx - ax) * (y - ay) >= (x - ax) * (by - ay) for (ax, ay), (bx, by) in sides([outer]) for x, y in inner):
            return True
        return False if area(inner) - shared > slivers else None

    b_in_a, a_in_b = within(b, a), within(a, b)
    if b_in_a is None or a_in_b is None:
        return None
    return "coincident" if a_in_b and b_in_a else "inside" if b_in_a else "surrounds" if a_in_b else "overlapping"


def containment(a: Figure, b: Figure, tolerance: float) -> str:
    """How ``b`` stands to ``a``: disjoint, touching, overlapping, inside (b in a), surrounds (b around a) or coincident."""
    if len(a) == len(b) == 1 and convex(a[0]) and convex(b[0]) and (plain := _plain_containment(a[0], b[0], tolerance)):
        return plain
    common = intersection(a, b, tolerance)
    if not common:
        near = any(to_segment(p, c, d) <= tolerance for x, y in ((a, b), (b, a)) for ring in x for p in ring for c, d in sides(y))
        near = near or any(meet(*s, *t) for s in sides(a) for t in sides(b))
        return "touching" if near else "disjoint"
    only_a, only_b = difference(a, b, tolerance), difference(b, a, tolerance)
    if not only_a and not only_b:
        return "coincident"
    return "inside" if not only_b else "surrounds" if not only_a else "overlapping"


def gap(a: Figure, b: Figure) -> float:
    """The least distance between the boundaries of two figures."""
    if any(meet(*s, *t) for s in sides(a) for t in sides(b)):
        return 0.0
    return min(to_segment(p, c, d) for x, y in ((a, b), (b, a)) for ring in x for p in ring for c, d in sides(y))


def overrun(inner: Figure, outer: Figure) -> float:
    """How far the corners of one figure lie outside another."""
    return max((-clearance(p, outer) for ring in inner for p in ring), default=0.0)


def fault(ring: Ring, tolerance: float) -> str | None:
    """Why a ring is no figure: degenerate or self-crossing."""
    if len(ring) < 3 or perimeter(ring) == 0 or 2 * abs(area(ring)) / perimeter(ring) < tolerance:
        return "degenerate"
    own = sides([ring])
    n = len(own)
    for i in range(n):
        for j in range(i + 1, n):
            if (j - i) % n in (1, n - 1):
                continue
            if meet(*own[i], *own[j]) is not None:
                return "self-crossing"
    return None


def nesting(rings: list[Ring], tolerance: float) -> list[int]:
    """How many other rings are around each ring; raises if two cross or can not be told apart."""
    depths = []
    for i, ring in enumerate(rings):
        depth = 0
        probes = ring + [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in sides([ring])]
        for j, other in enumerate(rings):
            if i == j:
                continue
            clear = [p for p in probes if min(to_segment(p, a, b) for a, b in sides([other])) > tolerance]
            votes = {winding(p, [other]) != 0 for p in clear}
            if not votes:
                raise ValueError("indistinct rings")
            if len(votes) > 1:
                raise ValueError("crossing rings")
            depth += votes.pop()
        depths.append(depth)
    return depths


def figure_of(rings: list[Ring], tolerance: float) -> Figure:
    """Rings as a figure: by nesting, those at odd depth become holes."""
    depths = nesting(rings, tolerance)
    return [r if (area(r) > 0) == (d % 2 == 0) else r[::-1] for r, d in zip(rings, depths, strict=True)]


# Arcs: an edge from one corner to another around a centre, through a point that says which way.


def sweep(start: Point, end: Point, centre: Point, through: Point) -> float:
    """The signed angle from start to end on the side of the through point."""
    a, b, c = (math.atan2(p[1] - centre[1], p[0] - centre[0]) for p in (start, end, through))
    forward = (b - a) % math.tau or math.tau
    return forward if (c - a) % math.tau <= forward else forward - math.tau


def arc_length(radius: float, angle: float) -> float:
    return radius * abs(angle)


def arc_area(radius: float, angle: float) -> float:
    """The signed area between an arc and its chord."""
    return radius * radius * (angle - math.sin(angle)) / 2


def divisions(radius: float, angle: float, tolerance: float, most: int = 1 << 16) -> int:
    """Chords whose distance from the arc stays within the tolerance."""
    if tolerance >= 2 * radius:
        return 1
    return max(1, min(most, math.ceil(abs(angle) / (2 * math.acos(1 - tolerance / radius)))))


def tessellate(start: Point, end: Point, centre: Point, through: Point, tolerance: float) -> list[Point]:
    """Corners of the chords of an arc, ends included."""
    radius, angle = math.dist(start, centre), sweep(start, end, centre, through)
    n = divisions(radius, angle, tolerance)
    at = math.atan2(start[1] - centre[1], start[0] - centre[0])
    inner = [(centre[0] + radius * math.cos(at + angle * k / n), centre[1] + radius * math.sin(at + angle * k / n)) for k in range(1, n)]
    return [start, *inner, end]


# Surfaces.


def hull(points: list[Point]) -> Ring:
    """The convex hull, counter-clockwise from the lowest point."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq: Iterable[Point]) -> list[Point]:
        out: list[Point] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(reversed(pts))


def triangulate(points: list[Point]) -> list[tuple[int, int, int]]:
    """Delaunay triangles of distinct points by incremental insertion; refuses fewer than three points and collinear ones.

    Points come from left to right, so a triangle whose circle ends to the left of a point is one of the answer and
    is set aside: a point is compared with the triangles along the front, and not with all.
    """
    n = len(points)
    if n < 3:
        raise ValueError("a surface needs three points")
    if len(hull(points)) < 3:
        raise ValueError("the points are collinear")
    ox, oy = min(p[0] for p in points), min(p[1] for p in points)
    span = max(max(p[0] for p in points) - ox, max(p[1] for p in points) - oy)
    pts = [(x - ox, y - oy) for x, y in points] + [(-1e4 * span, -1e4 * span), (2e4 * span, -1e4 * span), (-1e4 * span, 2e4 * span)]
    px, py = np.array(pts).T
    room = 1024
    corner, circle, live = np.zeros((room, 3), np.int64), np.zeros((room, 3)), np.zeros(room, bool)
    free = list(range(room - 1, -1, -1))
    top = 0  # rows from here on are not in use

    def add(i: int, j: int, k: int) -> None:
        nonlocal top, room, corner, circle, live
        (ax, ay), (bx, by), (cx, cy) = pts[i], pts[j], pts[k]
        d = 2 * ((bx - ax) * (cy - ay) - (cx - ax) * (by - ay))
        if d < 0:
            i, j, (ax, ay), (bx, by), d = j, i, (bx, by), (ax, ay), -d
        if d == 0:
            return
        b2, c2 = (bx - ax) ** 2 + (by - ay) ** 2, (cx - ax) ** 2 + (cy - ay) ** 2
        ux, uy = ((cy - ay) * b2 - (by - ay) * c2) / d, ((bx - ax) * c2 - (cx - ax) * b2) / d
        if not free:
            free.extend(range(2 * room - 1, room - 1, -1))
            corner, circle, live = (np.concatenate([t, np.zeros_like(t)]) for t in (corner, circle, live))
            room *= 2
        row = free.pop()
        corner[row], circle[row], live[row] = (i, j, k), (ax + ux, ay + uy, (ux * ux + uy * uy) * (1 - 1e-12)), True
        top = max(top, row + 1)

    add(n, n + 1, n + 2)
    done: list[list[int]] = []
    for count, p in enumerate(sorted(range(n), key=lambda k: pts[k])):
        if count % 32 == 0:
            past = px[p] - circle[:top, 0]
            behind = np.flatnonzero(live[:top] & (past > 0) & (past * past > circle[:top, 2]))
            done += corner[behind].tolist()
            live[behind] = False
            free.extend(behind.tolist())
            free.sort(reverse=True)  # low rows first, so that few rows are looked at
            top = int(live[:top].nonzero()[0].max(initial=-1)) + 1
        held = circle[:top]
        bad = np.flatnonzero(live[:top] & ((px[p] - held[:, 0]) ** 2 + (py[p] - held[:, 1]) ** 2 < held[:, 2])).tolist()
        edges = {(t[k], t[(k + 1) % 3]) for t in corner[bad].tolist() for k in range(3)}
        live[bad] = False
        free.extend(bad)
        for i, j in edges:
            if (j, i) not in edges:
                add(i, j, p)
    return sorted(tuple(sorted(t)) for t in done + corner[live].tolist() if max(t) < n)


def barycentric(p: Point, a: Point, b: Point, c: Point) -> tuple[float, float, float]:
    d = (b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])
    v = ((p[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (p[1] - a[1])) / d
    w = ((b[0] - a[0]) * (p[1] - a[1]) - (p[0] - a[0]) * (b[1] - a[1])) / d
    return 1 - v - w, v, w


def assembly(edges: list[tuple[str, str, str]], run: bool = False) -> str | None:
    """Why authored edges (edge, start, end) are no simple ring, or no simple run: None if they are."""
    names = [e for e, _, _ in edges]
    if len(set(names)) < len(names):
        return "an edge is written twice"
    at: dict[str, list[int]] = defaultdict(list)
    for k, (_, a, b) in enumerate(edges):
        at[a].append(k)
        at[b].append(k)
    if any(len(ks) > 2 for ks in at.values()):
        return "more than two edges meet in a corner"
    seen, todo = {0}, [0]
    while todo:
        k = todo.pop()
        for c in edges[k][1:]:
            for j in at[c]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
    if len(seen) < len(edges):
        return "the edges are in pieces"
    loose = sum(len(ks) == 1 for ks in at.values())
    if loose != (2 if run else 0):
        return "the run comes back to its start" if run else "the ring does not close"
    pairs = zip(edges, edges[1:] + ([] if run else edges[:1]), strict=False)
    if any(not set(x[1:]) & set(y[1:]) for x, y in pairs):
        return "the edges are not in the order in which they are walked"
    return None
