"""Arcs, carried regions, revisions."""

import subprocess

import pytest

from ledgerline.kernels import plane
from ledgerline.operators import arcs, regions
from ledgerline.sources import revisions

ARC = "x1 double, y1 double, x2 double, y2 double, cx double, cy double, tx double, ty double"


def test_arcs_match_the_kernel(spark):
    rows = [(1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, -1.0), (5.0, 2.0, 3.0, 4.0, 3.0, 2.0, 4.5, 3.3), (2.0, 0.0, 2.0, 0.0, 0.0, 0.0, -2.0, 0.0)]
    for r in arcs.tessellated(spark.createDataFrame(rows, ARC), 1e-2).collect():
        start, end, centre, through = (r.x1, r.y1), (r.x2, r.y2), (r.cx, r.cy), (r.tx, r.ty)
        assert r.sweep == pytest.approx(plane.sweep(start, end, centre, through)) and r.segment == pytest.approx(plane.arc_area(r.radius, r.sweep))
        want = plane.tessellate(start, end, centre, through, 1e-2)
        assert len(want) == len(r.chords) and all(c.x == pytest.approx(p[0], abs=1e-9) and c.y == pytest.approx(p[1], abs=1e-9) for c, p in zip(r.chords, want, strict=True))


def test_unread_arcs(spark):
    edges = spark.createDataFrame([("e1",), ("e2",)], "edge string")
    claims = spark.createDataFrame([("e1", "centre", True), ("e1", "width", True), ("e2", "centre", False), ("e2", "through", True)], "subject string, predicate string, live boolean")
    predicates = spark.createDataFrame([("centre", "coordinate"), ("through", "coordinate"), ("width", "scalar")], "name string, shape string")
    assert {(r.edge, tuple(r.predicates)) for r in arcs.unread(edges, claims, predicates, ["through"]).collect()} == {("e1", ("centre",))}


def test_regions_in_another_frame(spark):
    square = [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 1.0}]]
    figs = spark.createDataFrame([("a", "site", square), ("b", "root", square)], f"figure string, frame string, rings {regions.FIGURE}")
    turn = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    steps = spark.createDataFrame([("site", "root", "m", "m", ([10.0, 20.0, 0.0], turn, 2.0))], "frame string, parent string, unit string, parent_unit string, transform struct<translation:array<double>,rotation:array<double>,scale:double>")
    got = {r.figure: (r.frame, [[(p.x, p.y) for p in ring] for ring in r.rings]) for r in regions.carried(figs, steps).collect()}
    assert got["a"] == ("root", [[(10.0, 20.0), (10.0, 22.0), (8.0, 22.0), (8.0, 20.0)]]) and got["b"][1][0][2] == (1.0, 1.0)
    assert plane.area(got["a"][1][0]) == 4.0


def test_revisions(spark, tmp_path):
    home = tmp_path / "repo"
    home.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(home), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    text = '(project (globalid-namespace "https://example.org/m"))\n'
    (home / "a.dfc").write_text(text)
    git("add", ".")
    git("commit", "-q", "-m", "one")
    (home / "a.dfc").write_text(text + '(namespace site (description "x"))\n')
    git("commit", "-q", "-am", "two")
    base = revisions.load(spark, str(home), "HEAD~1", str(tmp_path / "base"))
    assert base.namespaces.count() == 0 and revisions.load(spark, str(home), "main", str(tmp_path / "head")).namespaces.count() == 1
    assert revisions.merge_base(str(home), "HEAD", "HEAD~1") == revisions.resolve(str(home), "HEAD~1")
    assert revisions.last_changes(spark, str(home)).select("path", "commit").first() == ("a.dfc", revisions.resolve(str(home), "HEAD"))
    assert revisions.unified("a\nb\n", "a\nc\n", "x") == "--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n" and revisions.unified("a", "a", "x") == ""
    with pytest.raises(ValueError, match="."):
        revisions.resolve(str(home), "nothing")


def test_a_facet_without_area_holds_nothing(spark):
    """Corners in one line make a facet that divides by nothing; the facets beside it answer."""
    from ledgerline.operators import surface

    at = lambda n, x, y: (n, float(x), float(y), 2.0 * x - 3.0 * y, 0.1)
    flat = ("r", 0, at(1, 0, 0), at(2, 1, 1), at(3, 2, 2), None)
    solid = ("r", 1, at(1, 0, 0), at(3, 2, 2), at(4, 2, 0), None)
    corner = "struct<shot:int,x:double,y:double,z:double,sigma:double>"
    facets = spark.createDataFrame([flat, solid], f"region string, facet int, a {corner}, b {corner}, c {corner}, fault string")
    asked = spark.createDataFrame([(1, "r", 1.0, 1.0), (2, "r", 1.5, 0.5)], "query int, region string, x double, y double")
    assert {r.query: round(r.z, 9) for r in surface.elevations(asked, facets).collect()} == {1: -1.0, 2: 1.5}


def test_equal_shapes_are_decided_once(spark, monkeypatch):
    """Figures with the same rings have one answer: 40 figures of 4 shapes are 16 pairs of shapes, whatever the pairs of figures."""
    boxes = [(k, 0, n, x + dx * 2.0, 0.0 + dy * 2.0) for k in range(40) for x in [float(k % 4)] for n, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]
    figs = regions.figures(spark.createDataFrame(boxes, "figure int, ring int, ord int, x double, y double"), 1e-6)
    sizes = []
    monkeypatch.setattr(regions, "containment", lambda pairs, t, f=regions.containment: sizes.append(pairs.count()) or f(pairs, t))
    got = {(r.a, r.b): r.state for r in regions.containment_of_all(figs, 1e-6, 10.0).collect()}
    state = {0: "coincident", 1: "overlapping", 2: "touching"}
    assert got == {(a, b): state[abs(a % 4 - b % 4)] for a in range(40) for b in range(a + 1, 40) if abs(a % 4 - b % 4) < 3} and sizes[0] <= 16
