"""Plane kernels: worked figures, identities and refusals."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.kernels import plane

T = 1e-6


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


@pytest.mark.parametrize("shift", [0.0, 4.0e5])
def test_overlay_of_two_boxes(shift):
    a, b = [box(shift, shift, 4, 4)], [box(shift + 2, shift + 1, 4, 2)]
    assert plane.figure_area(plane.union(a, b, T)) == pytest.approx(20)
    (common,) = plane.intersection(a, b, T)
    assert [c for p in common for c in p] == pytest.approx([c for p in box(shift + 2, shift + 1, 2, 2) for c in p])
    assert plane.figure_area(plane.difference(a, b, T)) == pytest.approx(12)


def test_courtyards_and_touching_pieces():
    plate, yard = [box(0, 0, 10, 10)], [box(3, 3, 4, 4)]
    ring = plane.difference(plate, yard, T)
    assert len(ring) == 2 and plane.figure_area(ring) == pytest.approx(84)
    assert [len(h) for _, h in plane.pieces(ring)] == [1]
    assert plane.figure_area(plane.union([box(0, 0, 1, 1)], [box(1, 0, 1, 1)], T)) == pytest.approx(2)
    assert len(plane.union([box(0, 0, 1, 1)], [box(1, 0, 1, 1)], T)) == 1
    assert len(plane.union([box(0, 0, 1, 1)], [box(1, 1, 1, 1)], T)) == 2
    assert plane.intersection([box(0, 0, 1, 1)], [box(1, 0, 1, 1)], T) == []


@pytest.mark.parametrize(
    ("b", "want"),
    [(box(20, 0, 1, 1), "disjoint"), (box(10, 0, 5, 5), "touching"), (box(5, 5, 10, 2), "overlapping"), (box(2, 2, 3, 3), "inside"), (box(-1, -1, 12, 12), "surrounds"), (box(0, 0, 10, 10), "coincident")],
)
def test_containment(b, want):
    assert plane.containment([box(0, 0, 10, 10)], [b], T) == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_inclusion_and_exclusion(seed):
    r = random.Random(seed)
    figures = []
    for _ in range(2):
        n, cx, cy = r.randint(3, 8), r.uniform(0, 4), r.uniform(0, 4)
        angles = sorted(r.uniform(0, math.tau) for _ in range(n))
        figures.append([plane.hull([(cx + 3 * math.cos(t), cy + 3 * math.sin(t)) for t in angles])])
    a, b = figures
    if any(plane.fault(f[0], 1e-3) for f in figures):
        return
    one, both, rest = (plane.figure_area(f(a, b, T)) for f in (plane.union, plane.intersection, plane.difference))
    assert one + both == pytest.approx(plane.figure_area(a) + plane.figure_area(b), abs=1e-3)
    assert rest + both == pytest.approx(plane.figure_area(a), abs=1e-3)


def test_buffers():
    grown = plane.buffer([box(0, 0, 10, 10)], 1.0, 1e-3)
    assert plane.figure_area(grown) == pytest.approx(100 + 40 + math.pi, abs=0.05)
    assert plane.figure_area(plane.buffer([box(0, 0, 10, 10)], -1.0, 1e-3)) == pytest.approx(64, abs=1e-6)
    assert plane.buffer([box(0, 0, 1, 1)], -0.6, 1e-3) == []
    with pytest.raises(ValueError, match="tolerance"):
        plane.buffer([box(0, 0, 1, 1)], 1e-4, 1e-3)


def test_arcs():
    s, e, c, th = (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (0.0, 1.0)
    assert plane.sweep(s, e, c, th) == pytest.approx(math.pi)
    assert plane.sweep(s, e, c, (0.0, -1.0)) == pytest.approx(-math.pi)
    assert plane.arc_length(1, math.pi) == pytest.approx(math.pi) and plane.arc_area(1, math.pi) == pytest.approx(math.pi / 2)
    chain = plane.tessellate(s, e, c, th, 1e-3)
    assert len(chain) == plane.divisions(1, math.pi, 1e-3) + 1
    assert all(abs(plane.to_segment(c, a, b) - 1) <= 1e-3 for a, b in zip(chain, chain[1:], strict=False))


def test_faults_and_nesting():
    assert plane.fault([(0, 0), (2, 2), (2, 0), (0, 2)], T) == "self-crossing" or plane.area([(0, 0), (2, 2), (2, 0), (0, 2)]) == 0
    assert plane.fault([(0, 0), (3, 3), (3, 0), (0, 2)], T) == "self-crossing"
    assert plane.fault([(0, 0), (1, 0), (2, 0)], T) == "degenerate"
    assert plane.nesting([box(0, 0, 9, 9), box(1, 1, 5, 5), box(2, 2, 1, 1)], T) == [0, 1, 2]
    assert plane.figure_area(plane.figure_of([box(0, 0, 9, 9), box(1, 1, 5, 5), box(2, 2, 1, 1)], T)) == pytest.approx(81 - 25 + 1)
    with pytest.raises(ValueError, match="crossing"):
        plane.nesting([box(0, 0, 4, 4), box(2, 2, 4, 4)], T)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_triangles_cover_the_hull_and_are_empty(seed):
    r = random.Random(seed)
    points = list({(round(r.uniform(0, 9), 3), round(r.uniform(0, 9), 3)) for _ in range(r.randint(4, 30))})
    triangles = plane.triangulate(points)
    total = sum(abs(plane.area([points[k] for k in t])) for t in triangles)
    assert total == pytest.approx(plane.area(plane.hull(points)), rel=1e-3)


def test_surface_refusals_and_weights():
    with pytest.raises(ValueError, match="three"):
        plane.triangulate([(0, 0), (1, 1)])
    with pytest.raises(ValueError, match="collinear"):
        plane.triangulate([(0, 0), (1, 1), (2, 2)])
    assert plane.barycentric((0.25, 0.25), (0, 0), (1, 0), (0, 1)) == pytest.approx((0.5, 0.25, 0.25))


@pytest.mark.parametrize(
    ("edges", "run", "fault"),
    [
        (["ab", "bc", "ca"], False, None),
        (["ab", "cb", "ca"], False, None),
        (["ab", "bc", "ca", "ab"], False, "written twice"),
        (["ab", "bc"], False, "does not close"),
        (["ab", "bc"], True, None),
        (["ab", "bc", "ca"], True, "comes back"),
        (["ab", "bc", "bd"], True, "more than two"),
        (["ab", "bc", "ca", "de", "ef", "fd"], False, "in pieces"),
        (["ab", "cd", "bc", "da"], False, "not in the order"),
    ],
)
def test_assembly(edges, run, fault):
    named = [(e, e[0], e[1]) for e in edges]
    got = plane.assembly(named, run)
    assert got is None if fault is None else fault in got


def test_triangles_along_a_front_cover_the_hull():
    """What is set aside behind the front is what all triangles together give: their areas are the hull's, and no circle holds a point."""
    rng = random.Random(7)
    points = list({(rng.randrange(3000) / 100, float(rng.randrange(40))) for _ in range(900)})
    made = plane.triangulate(points)
    whole = sum(abs(plane.area([points[i] for i in t])) for t in made)
    assert whole == pytest.approx(plane.area(plane.hull(points)), rel=1e-6)
    for t in made[::40]:
        (ax, ay), (bx, by), (cx, cy) = (points[i] for i in t)
        d = 2 * ((bx - ax) * (cy - ay) - (cx - ax) * (by - ay))
        if abs(d) < 1e-6:
            continue
        b2, c2 = (bx - ax) ** 2 + (by - ay) ** 2, (cx - ax) ** 2 + (cy - ay) ** 2
        ux, uy = ((cy - ay) * b2 - (by - ay) * c2) / d, ((bx - ax) * c2 - (cx - ax) * b2) / d
        assert all(math.hypot(x - ax - ux, y - ay - uy) >= math.hypot(ux, uy) * (1 - 1e-6) for x, y in points)


def test_convex_answers_are_those_of_the_overlay(monkeypatch):
    """Half planes give what the overlay gives: containment of convex pairs, and what setbacks leave of convex plots."""
    rng = random.Random(5)
    boxes = [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)] for x, y, w, h in [tuple(float(rng.randrange(1, 6)) for _ in range(4)) for _ in range(14)]]
    rounds = [plane.hull([(rng.uniform(0, 8), rng.uniform(0, 8)) for _ in range(7)]) for _ in range(6)]
    pairs = [(a, b) for a in boxes + rounds for b in boxes + rounds]
    fast = [plane.containment([a], [b], 1e-6) for a, b in pairs]
    assert sum(plane._plain_containment(a, b, 1e-6) is not None for a, b in pairs) > 150
    monkeypatch.setattr(plane, "_plain_containment", lambda *_: None)
    assert fast == [plane.containment([a], [b], 1e-6) for a, b in pairs]
    for ring in boxes[:4] + rounds:
        for widths in ([0.4] * len(ring), [0.7, *[0.2] * (len(ring) - 1)]):
            own = [(a, b, w) for (a, b), w in zip(plane.sides([ring]), widths, strict=True)]
            left = plane.inset(ring, own, 1e-3)
            if left is not None:
                strips = [r for a, b, w in own for r in plane.strip(a, b, w, 1e-3)]
                slow = plane.arrange([[ring], strips], lambda c: c[0] and not c[1], 1e-3)
                assert plane.figure_area(left) == pytest.approx(plane.figure_area(slow), abs=0.02)
    assert plane.inset(boxes[0], [(*boxes[0][:2], 0.5)], 1e-3) is not None
