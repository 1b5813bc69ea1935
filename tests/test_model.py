"""Questions about one small model: two rooms that share a wall, a plot with setbacks, and a revision."""

import json

import pytest

from ledgerline.__main__ import run
from ledgerline.plans import model_queries as q
from ledgerline.sources import entity


def claim(predicate, value, accuracy="(accuracy (independent 0.01 m))", day="2026-01-01", more=""):
    return f'({predicate} (value {value}) (source "survey") (method m:gnss) (date "{day}") {accuracy}{more})'


CORNERS = {"a": (0, 0), "b": (6, 0), "c": (10, 0), "d": (10, 8), "e": (6, 8), "f": (0, 8)}
EDGES = {"ab": "ab", "bc": "bc", "cd": "cd", "de": "de", "ef": "ef", "fa": "fa", "be": "be"}


def model_text(corners=CORNERS, area="48.0", extra=""):
    parts = [
        '(project (label "Small") (globalid-namespace "https://example.org/small"))',
        *(f'(namespace {n} (description "{n}"))' for n in ("site", "g", "m", "frame")),
        '(type Room (kind Space) (geometry area) (description "A room") (invariant boundary-loops-close (tolerance close)) (invariant claim-agrees-with-geometry (predicate area) (tolerance area)))',
        '(type Floor (kind Storey) (geometry area) (description "A floor") (invariant contained-areas-sum (tolerance area)))',
        '(type House (kind Building) (geometry absent) (description "A house"))(type Plot (kind Site) (geometry absent) (description "A plot"))(type Wall (kind Element) (geometry absent) (geometry line) (description "A wall"))(type Fire (kind Zone) (geometry absent) (description "A zone"))',
        "(predicate position (unit m) (shape coordinate) (dimension 2)) (predicate area (unit m2) (shape scalar)) (predicate setback (unit m) (shape scalar))",
        "(tolerance close (value 0.01 m)) (tolerance area (value 0.5 m2)) (frame frame:g (unit m)) (route all (file \"all.dfc\"))",
        *(f"(vertex g:{n} (frame frame:g) {claim('position', f'({x}.0 {y}.0) m')})" for n, (x, y) in corners.items()),
        *(f"(edge g:{n} (frame frame:g) (vertices g:{v[0]} g:{v[1]}) {'(backed-by site:W)' if n == 'be' else ''})" for n, v in EDGES.items()),
        "(loop g:left (frame frame:g) (edges g:ab g:be g:ef g:fa)) (loop g:right (frame frame:g) (edges g:bc g:cd g:de g:be)) (loop g:all (frame frame:g) (edges g:ab g:bc g:cd g:de g:ef g:fa)) (loop g:run (frame frame:g) (edges g:ab g:bc))",
        "(node site:P (kind Site) (type Plot)) (node site:B (kind Building) (type House) (within site:P)) (node site:F (kind Storey) (type Floor) (geometry area) (within site:B) (boundary g:all))",
        f"(node site:L (kind Space) (type Room) (geometry area) (within site:F) (boundary g:left) (member-of site:Z) {claim('area', area + ' m2', '(accuracy (independent 0.1 m2))')})",
        "(node site:R (kind Space) (type Room) (geometry area) (within site:F) (boundary g:right)) (node site:W (kind Element) (type Wall) (within site:F)) (node site:K (kind Element) (type Wall) (geometry line) (within site:F) (boundary g:run)) (node site:Z (kind Zone) (type Fire))",
        extra,
    ]
    return "\n".join(parts)


def write(folder, text):
    folder.mkdir(exist_ok=True)
    (folder / "m.dfc").write_text(text)
    return f"file://{folder}"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return write(tmp_path_factory.mktemp("small") / "a", model_text())


@pytest.fixture(scope="module")
def model(spark, root):
    return entity.load_model(spark, root)


def test_the_model_has_no_faults(model):
    assert model.faults().collect() == []


def test_measures(model):
    got = {r.id: r for r in q.measure(model, "position", 1e-3).collect()}
    assert got["site:L"].area == pytest.approx(48) and got["site:R"].area == pytest.approx(32) and got["site:F"].area == pytest.approx(80)
    assert got["site:K"].length == 10.0 and got["g:be"].length == 8.0 and got["site:R"].length == pytest.approx(24)


def test_relations(model):
    assert {r.node: r.fault for r in q.assembled(model).collect()} == {"site:F": None, "site:L": None, "site:R": None, "site:K": None}
    assert {(r.a, r.b, tuple(r.via)) for r in q.adjacent(model).collect() if "L" in r.a + r.b and "R" in r.a + r.b} == {("site:L", "site:R", ("g:be",)), ("site:R", "site:L", ("g:be",))}
    assert {r.edge: r.boundary for r in q.classification(model).collect()}["g:be"] == "physical"
    assert [(r.node, r.depth) for r in q.traverse(model, "site:P", "contains").collect()] == [("site:B", 1), ("site:F", 2), ("site:K", 3), ("site:L", 3), ("site:R", 3), ("site:W", 3)]
    assert [r.node for r in q.traverse(model, "site:P", "contains", type_="Room").collect()] == ["site:L", "site:R"]
    assert [r.node for r in q.traverse(model, "site:L", "contained-by").collect()] == ["site:F", "site:B", "site:P"]
    assert [r.node for r in q.traverse(model, "site:Z", "members-of").collect()] == ["site:L"]
    assert [r.node for r in q.traverse(model, "g:left", "boundary-of").collect()] == ["site:L"]
    drawn = {r.id: r.undrawn for r in q.plan_of(model, "site:F", "position", 1e-3).collect()}
    assert drawn == {"site:L": None, "site:R": None, "site:W": "no-boundary", "site:K": "unreadable-boundary"}


def test_checks_pass_and_fail(spark, model, tmp_path):
    violations, tallies = q.check(model, "position", 1e-3)
    assert violations.collect() == []
    assert {r.check: (r.ran, r.failed) for r in tallies.collect()} == {"boundary-loops-close": (2, 0), "claim-agrees-with-geometry": (2, 0), "contained-areas-sum": (1, 0)}
    wrong = entity.load_model(spark, write(tmp_path / "w", model_text(area="60.0").replace("(edges g:bc g:cd g:de g:be)", "(edges g:bc g:cd g:de)")))
    found = {(r.check, r.subject) for r in q.check(wrong, "position", 1e-3)[0].collect()}
    assert ("claim-agrees-with-geometry", "site:L") in found and ("boundary-loops-close", "site:R") in found


def test_buildable_needs_every_setback(spark, tmp_path):
    with_all = model_text().replace("(edge g:", "(edge  g:")
    for n in ("ab", "be", "ef", "fa"):
        with_all = with_all.replace(f"(edge  g:{n} (frame frame:g)", f"(edge g:{n} (frame frame:g) {claim('setback', '1.0 m')}")
    got = {r.figure: (r.status, r.area) for r in q.buildable_of(entity.load_model(spark, write(tmp_path / "s", with_all)), "position", "setback", 1e-3).collect()}
    assert got["site:L"][0] == "region" and got["site:L"][1] == pytest.approx(24, abs=0.05) and got["site:R"] == ("refused", None)


def test_revisions(spark, model, tmp_path):
    moved = entity.load_model(spark, write(tmp_path / "m", model_text(CORNERS | {"c": (11, 0)}).replace("(node site:W (kind Element) (type Wall) (within site:F))", "").replace("(backed-by site:W)", "")))
    found = {(r.kind, r.subject) for r in q.compare(model, moved).collect()}
    assert found == {("boundary-moved-without-claim", "g:c"), ("id-disappeared-without-supersession", "site:W")}
    assert q.compare(model, model).count() == 0


COMMANDS = [
        (["list-types"], 0, '"name":"Room"'),
        (["list-instances", "Room"], 0, "site:R"),
        (["list-instances", "Hall"], 1, "[]"),
        (["list-geometry", "--predicate", "position", "--family", "vertex"], 0, "g:a"),
        (["get", "site:L"], 0, '"predicate":"area"'),
        (["resolve", "site:L", "area"], 0, '"reason":"only"'),
        (["resolve", "site:R", "area"], 1, '"reason":"unclaimed"'),
        (["claims", "site:L"], 0, '"status":"current"'),
        (["conflicts"], 1, "[]"),
        (["route", "site:L"], 0, "all.dfc"),
        (["traverse", "site:F", "contains", "--depth", "1"], 0, "site:R"),
        (["measure", "site:L"], 0, '"area":48.0'),
        (["tessellate", "[[1,0],[-1,0],[0,0],[0,1]]"], 0, "0.0"),
        (["site", "site:L", "site:F"], 0, '"verdict":"might-fit"'),
        (["plan", "site:F"], 0, "no-boundary"),
        (["export"], 0, "IFCBUILDINGSTOREY"),
        (["export-map", "--srs", "EPSG:1"], 0, "gml:Polygon"),
        (["check"], 0, '"violations":[]'),
        (["fmt", "--check"], 3, "m.dfc"),
        (["version"], 0, "version"),
        (["add-node", '{"id": "site:N", "kind": "Space", "type": "Nothing"}'], 3, "undeclared type"),
]


@pytest.mark.parametrize(("argv", "code", "part"), COMMANDS, ids=[c[0][0] for c in COMMANDS])
def test_commands(spark, root, model, monkeypatch, argv, code, part):
    monkeypatch.setattr(entity, "load_model", lambda *_: model)  # one model, loaded and checked once
    monkeypatch.setattr(entity.Model, "faults", lambda self: model.diagnostics.withColumn("subject", model.diagnostics.path))
    got, text = run(spark, [argv[0], *argv[1:], "--root", root])
    assert got == code and part in text
    assert json.loads(text)["kind"] == argv[0]


def test_a_faulty_model_answers_nothing(spark, tmp_path):
    code, text = run(spark, ["list-types", "--root", write(tmp_path / "f", "(node site:R (kind Space) (type Hall))")])
    assert code == 3 and "undeclared type Hall" in text


def test_a_moved_end_of_an_open_boundary_is_found(spark, model, tmp_path):
    """A boundary that does not close has a corner more than edges: each of them may have moved."""
    open_ = model_text().replace("(edges g:bc g:cd g:de g:be)", "(edges g:bc g:cd g:de)")
    base = entity.load_model(spark, write(tmp_path / "o", open_))
    for corner in "d":
        x, y = CORNERS[corner]
        head = entity.load_model(spark, write(tmp_path / corner, model_text(CORNERS | {corner: (x + 1, y)}).replace("(edges g:ab g:bc g:cd g:de g:ef g:fa)", "(edges g:ab g:be g:ef g:fa)").replace("(edges g:bc g:cd g:de g:be)", "(edges g:bc g:cd g:de)")))
        assert ("boundary-moved-without-claim", f"g:{corner}") in {(r.kind, r.subject) for r in q.compare(base, head).collect()}
