"""Operators on small tables with figures worked by hand."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import units
from ledgerline.operators import budget, frames, geometry, graph, lookup, observe, regions, resolution, review, rules, surface
from ledgerline.sources import observations
from ledgerline.streaming import ingest

CLAIM = "subject string, predicate string, sigma double, unit string, day date, live boolean"
D = [dt.date(2026, 1, k) for k in range(1, 9)]


def claims(spark, rows):
    rows = list(rows)
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, CLAIM)


RULES = [
    ("only", [(0.1, "m", 0)], "only"),
    ("unranked", [(None, None, 0)], "unranked"),
    ("twice unknown", [(None, None, 0), (None, None, 1)], "ambiguous"),
    ("accuracy", [(0.1, "m", 0), (0.2, "m", 5), (None, None, 7)], "accuracy"),
    ("recency", [(0.1, "m", 0), (0.1, "m", 2)], "recency"),
    ("tie", [(0.1, "m", 2), (0.1, "m", 2)], "ambiguous"),
    ("units", [(0.1, "m", 0), (0.1, "ft", 5)], "ambiguous"),
    ("one of two", [(0.1, "m", 0), (None, None, 5)], "accuracy"),
]


def test_every_reason(spark):
    rows = [(name, "p", s, u, D[d], True) for name, held, _ in RULES for s, u, d in held]
    rows.append(("gone", "p", 0.1, "m", D[0], False))
    asked = spark.createDataFrame([(n, "p") for n, _, _ in RULES] + [("gone", "p"), ("never", "p")], "subject string, predicate string")
    got = {r.subject: r for r in resolution.resolve(claims(spark, rows), asked).collect()}
    assert {n: got[n].reason for n, _, _ in RULES} == {n: r for n, _, r in RULES}
    assert got["gone"].reason == got["never"].reason == "unclaimed"
    assert got["accuracy"].sigma == 0.1 and got["recency"].day == D[2] and got["units"].n_candidates == 2 and got["unranked"].sigma is None
    marked = {(r.subject, r.reason) for r in resolution.marked(claims(spark, rows)).collect()}
    assert marked == {(n, r) for n, _, r in RULES}
    status = {}
    for r in resolution.audit(claims(spark, rows)).collect():
        status.setdefault(r.subject, []).append(r.status)
    assert sorted(status["accuracy"]) == ["current", "outranked", "unranked"] and status["gone"] == ["retracted"] and status["tie"] == ["tied"] * 2 == status["units"]
    assert {r.subject for r in resolution.conflicts(claims(spark, rows)).collect()} == {n for n, held, _ in RULES if len(held) > 1}


def test_the_budget_of_a_sited_plot(spark):
    """Nine claims: four corners each of plot and footprint, and the fit that relates their frames."""
    terms = [("s", f"P{k}", "independent", 0.003, "m", None, 0) for k in range(4)] + [("s", f"B{k}", "independent", 0.004, "m", None, 0) for k in range(4)]
    terms += [("s", c, "systematic", 0.008, "m", "control:CP-1", 1) for c in ("P0", "P1", "P2", "P3", "B0", "B1", "B2", "B3", "fit")]
    terms += [("s", "fit", "independent", 0.012, "m", None, 0), ("s", "fit", "systematic", 0.005, "m", "control:CP-2", 2)]
    rows = spark.createDataFrame(terms + terms[:3], "answer string, claim string, kind string, magnitude double, unit string, source string, ord int")
    merged = budget.terms(rows)
    assert merged.count() == 11
    shared = merged.where("name = 'control:CP-1'").first()
    assert len(shared.contributors) == 9
    got = budget.combined(merged).first()
    assert got.sigma == pytest.approx(0.0203224, abs=1e-7) and got.status == "known"
    assert budget.dominant(merged).first().name == "P0#0" or budget.dominant(merged).first().magnitude == 0.012
    mixed = budget.combined(budget.terms(rows.unionAll(spark.createDataFrame([("s", "x", "independent", 1.0, "ft", None, 0)], rows.schema)))).first()
    assert mixed.status == "mixed" and mixed.sigma is None
    lost = budget.combined(merged, spark.createDataFrame([("s",)], "answer string")).first()
    assert lost.status == "unknown" and lost.sigma is None


def test_bands(spark):
    row = spark.createDataFrame([(0.02, 0.01, 0.03), (0.02, 0.01, None), (0.005, 0.01, 0.001)], "d double, f double, s double")
    got = [tuple(r) for r in row.select(*[c.alias(n) for n, c in budget.banded(F.col("d"), F.col("f"), F.col("s")).items()]).collect()]
    assert got == [(0.03, True, True, True), (0.01, False, False, False), (0.01, False, False, True)]


def test_walks_stop_at_cycles_and_depths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    start = spark.createDataFrame([("a",)], "start string")
    assert {(r.node, r.depth) for r in graph.walk(edges, start).collect()} == {("b", 1), ("c", 2), ("d", 3)}
    assert graph.walk(edges, start, 1).count() == 1
    assert {r.id for r in graph.on_cycles(edges).collect()} == {"a", "b", "c"}
    sup = spark.createDataFrame([("x", "y"), ("y", "z"), ("z", None)], "id string, superseded_by string")
    assert {(r.id, r.current, r.steps) for r in graph.chain(sup).collect()} == {("x", "z", 2), ("y", "z", 1), ("z", "z", 0)}


def test_nesting_of_kinds(spark):
    nodes = spark.createDataFrame([("s", "Site", None), ("b", "Building", "s"), ("r", "Space", "b"), ("z", "Zone", "s")], "id string, kind string, within string")
    assert {r.id for r in lookup.misplaced(nodes).collect()} == {"r", "z"}


def test_frames_there_and_back(spark):
    turn = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    fr = spark.createDataFrame([("root", "m", None, None), ("site", "ft", "root", "t1"), ("shed", "m", "site", "t2")], "frame string, unit string, parent string, transform_claim string")
    value = lambda t, s: ((t, turn, s),)
    held = spark.createDataFrame([("t1", value([100.0, 200.0, 5.0], 1.0)), ("t2", value([10.0, 0.0, 0.0], 2.0))], "id string, value struct<transform:struct<translation:array<double>,rotation:array<double>,scale:double>>")
    steps = frames.resolved(fr, held)
    points = spark.createDataFrame([(1, "shed", 3.0, 4.0, 0.0), (2, "root", 1.0, 1.0, 1.0)], "id int, frame string, x double, y double, z double")
    got = {r.id: r for r in frames.at_root(points, steps).collect()}
    k = 0.3048
    sx, sy = 10 - 2 * 4 / k, 2 * 3 / k  # in the site's feet
    assert (got[1].x, got[1].y, got[1].z) == pytest.approx((100 - sy * k, 200 + sx * k, 5.0)) and got[1].root == "root"
    assert (got[2].x, got[2].root) == (1.0, "root")
    site = steps.where("frame = 'site'").withColumns({"x": F.lit(got[1].x), "y": F.lit(got[1].y), "z": F.lit(5.0)})
    back = site.select(*frames.from_parent([F.col(c) for c in "xyz"], F.col("transform"), F.col("unit"), F.col("parent_unit"))).first()
    assert tuple(back) == pytest.approx((sx, sy, 0.0))
    low = frames.meeting(frames.paths(fr), "shed", "root").first()
    assert (low.ancestor, low.up, low.down) == ("root", 2, 0)


def ring(name, n, x, y, w, h):
    return [(name, n, k, float(x + dx * w), float(y + dy * h)) for k, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]


def figures(spark, *rings):
    return spark.createDataFrame([c for r in rings for c in r], "figure string, ring int, ord int, x double, y double")


def test_regions(spark):
    rows = figures(spark, ring("plate", 0, 0, 0, 10, 10), ring("plate", 1, 3, 3, 4, 4), ring("yard", 0, 3, 3, 4, 4), ring("room", 0, 1, 1, 1, 1), [("bow", 0, k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (3.0, 3.0), (3.0, 0.0), (0.0, 2.0)])])
    figs = regions.figures(rows, 1e-3)
    got = {r.figure: r for r in figs.collect()}
    assert got["plate"].area == pytest.approx(84) and got["plate"].perimeter == pytest.approx(56) and got["bow"].fault == "self-crossing"
    within = {(r.inner, r.outer) for r in regions.derived_within(figs, 1e-3, 5.0).collect()}
    assert within == {("room", "plate")}
    pairs = regions.meeting(figs, figs, 2.0).where("a < b")
    states = {(r.a, r.b): r.state for r in regions.containment(pairs, 1e-3).collect()}
    assert states[("plate", "yard")] == "touching" and states[("plate", "room")] == "inside"
    grown = {r.figure: r.area for r in regions.buffered(figs.where("figure = 'room'"), 1.0, 1e-3).collect()}
    assert grown["room"] == pytest.approx(1 + 4 + 3.14159, abs=0.05)
    notes = spark.createDataFrame([("room", "area", "1.0", True)], "subject string, predicate string, value string, live boolean")
    nodes = spark.createDataFrame([("room", "area", True), ("bow", "area", True), ("idea", None, False), ("lid", "point", False)], "id string, geometry string, has_loop boolean")
    drawn = {r.id: r for r in regions.plan(nodes, figs, notes).collect()}
    assert {k: v.undrawn for k, v in drawn.items()} == {"room": None, "bow": "unreadable-boundary", "idea": "no-boundary", "lid": "no-position"} and len(drawn["room"].annotations) == 1


def test_siting_and_buildable(spark):
    plots = regions.figures(figures(spark, ring("plot", 0, 0, 0, 40, 30)), 1e-3)
    shapes = regions.figures(figures(spark, ring("in", 0, 4, 10, 10, 10), ring("near", 0, 0.01, 10, 10, 10), ring("over", 0, -2, 10, 10, 10), ring("far", 0, 50, 0, 5, 5), ring("hazy", 0, 4, 10, 10, 10)), 1e-3)
    sigma = spark.createDataFrame([("in", 0.0203), ("near", 0.0203), ("over", 0.0203), ("far", 0.0203), ("hazy", None)], "figure string, sigma double")
    got = {r.footprint: (round(r.clearance, 6), r.verdict) for r in regions.siting(shapes.join(sigma, "figure").withColumn("plot", F.lit("plot")), plots, 1e-3, 0.0).collect()}
    assert got == {"in": (4.0, "fits"), "near": (0.01, "might-fit"), "over": (-2.0, "does-not-fit"), "far": (-10.0, "does-not-fit"), "hazy": (4.0, "unknown")}
    corners = [(0, 0), (40, 0), (40, 30), (0, 30)]
    sides = [("plot", *map(float, (*a, *b)), s) for a, b, s in zip(corners, corners[1:] + corners[:1], (5.0, 0.0, 2.0, 0.0), strict=True)]
    schema = "figure string, ax double, ay double, bx double, by double, setback double"
    left = regions.buildable(plots, spark.createDataFrame(sides, schema), 1e-3).first()
    assert left.status == "region" and left.area == pytest.approx(40 * 23, abs=0.1)  # a thousandth along the sides
    assert regions.buildable(plots, spark.createDataFrame([*sides[:3], (*sides[3][:5], None)], schema), 1e-3).first().status == "refused"
    assert regions.buildable(plots, spark.createDataFrame([(*s[:5], 20.0) for s in sides], schema), 1e-3).first().status == "consumed"


@pytest.mark.parametrize(("sigma", "want"), [(0.021, 0.0215), (0.002, None)])
def test_the_fall_of_a_patio(spark, sigma, want):
    shots = [("patio", f"s{i}{j}", 1.5 * i, 1.25 * j, 100 + 0.0125 * 1.25 * j, sigma) for i in range(5) for j in range(5)]
    held = spark.createDataFrame(shots, "region string, shot string, x double, y double, z double, sigma double")
    facets = surface.facets(held)
    assert facets.count() == 32
    queries = spark.createDataFrame([("low", "patio", 3.0, 0.5), ("high", "patio", 3.0, 4.5), ("off", "patio", 9.0, 9.0)], "query string, region string, x double, y double")
    found = surface.elevations(queries, facets)
    assert {r.query: round(r.z, 6) for r in found.collect()} == {"low": 100.00625, "high": 100.05625}
    fall = surface.falls(spark.createDataFrame([("p", "high", "low")], "pair string, start string, end string"), found, held).first()
    assert fall.fall == pytest.approx(0.05) and fall.run == 4.0 and fall.gradient == pytest.approx(0.0125)
    assert sigma < fall.sigma < 1.5 * sigma
    same = surface.falls(spark.createDataFrame([("p", "low", "low")], "pair string, start string, end string"), found, held).first()
    assert same.sigma == 0.0 and same.fall == 0.0
    bad = surface.facets(spark.createDataFrame([("line", "a", 0.0, 0.0, 1.0, 0.1), ("line", "b", 1.0, 1.0, 1.0, 0.1), ("line", "c", 2.0, 2.0, 1.0, 0.1)], held.schema)).first()
    assert bad.fault == "the points are collinear"


def test_membership_and_nearest(spark):
    rows = figures(spark, ring("plot", 0, 0, 0, 10, 10), ring("plot", 1, 8, 8, 1, 1))
    rows = regions.figures(rows, 1e-6).select("figure", F.posexplode("rings").alias("ring", "c")).select("figure", "ring", F.posexplode("c").alias("ord", "p")).select("figure", "ring", "ord", "p.x", "p.y")
    shots = spark.createDataFrame([(1, 5.0, 5.0, 0.1, 0.0), (2, 9.95, 5.0, 0.1, 0.0), (3, 12.0, 5.0, 0.1, 0.0), (4, 5.0, 5.0, 0.1, None), (5, 8.5, 8.5, 0.0, 0.0), (6, 10.05, 5.0, 0.1, 0.0)], "point int, x double, y double, h double, sigma double")
    got = {r.point: r.state for r in geometry.membership(shots, rows, 0.01, 4.0).collect()}
    assert got == {1: "inside", 2: "ambiguous", 4: "ambiguous", 6: "ambiguous"}


LOG = """# id at frame x y z method fix h v antenna session
obs o:1 2026-05-06T09:14:22Z f:g 1.0 2.0 3.0e0 m:rtk fix:fixed 0.01 0.02 1.8 s:a

  obs o:2 2026-05-06T11:14:22+02:00 f:g 1.0 2.0 3.0 m:rtk fix:fixed 0.01 0.02 1.8 s:a
retire r:1 2026-05-07T09:00:00Z o:1 "a bad \\"mark\\""
obs o:3 2026-05-06T09:14:22 f:g 1.0 2.0 3.0 m:rtk fix:fixed 0.01 0.02 1.8 s:a
obs o:4 2026-05-06T09:14:22-00:00 f:g 1.0 2.0 3.0 m:rtk fix:fixed 0.01 0.02 1.8 s:a
obs o:5 2026-05-06T09:14:22Z f:g 1 2.0 3.0 m:rtk fix:fixed 0.01 0.02 1.8 s:a
obs o:6 2026-05-06T09:14:22Z f:g 1.0 2.0 3.0 m:rtk fix:fixed -0.01 0.02 1.8 s:a
obs o:7 2026-05-06T09:14:22Z f:g 1.0 2.0 3.0 m:rtk
shot o:8
retire r:2 2026-05-07T09:00:00Z o:1 ""
obs o9 2026-05-06T09:14:22Z f:g 1.0 2.0 3.0 m:rtk fix:fixed 0.01 0.02 1.8 s:a
"""


def test_observation_lines(spark, tmp_path):
    (tmp_path / "a.obs").write_text(LOG)
    records = observations.parsed(observations.read_lines(spark, f"file://{tmp_path}"))
    good = {r.id: r for r in observations.observations(records).collect()}
    assert set(good) == {"o:1", "o:2"} and good["o:1"].z == 3.0 and good["o:1"]["at"] == good["o:2"]["at"] and good["o:2"].line == 4
    gone = observations.retirements(records).collect()
    assert [(r.supersedes, r.reason) for r in gone] == [("o:1", 'a bad "mark"')]
    faults = {r.line: r.message for r in observations.diagnostics(records).collect()}
    assert faults == {6: "an ambiguous timestamp: no offset", 7: "an ambiguous timestamp: no offset", 8: "not a real number", 9: "a negative precision or height", 10: "obs takes 12 fields, not 7", 11: "unknown form shot", 12: "an empty reason", 13: "not an id"}
    assert [r.id for r in observe.current(observations.observations(records), observations.retirements(records)).collect()] == ["o:2"]


def test_faults_across_a_log(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [("a", 1, "obs", "o1", t, None), ("a", 2, "obs", "o1", t, None), ("a", 3, "retire", "r1", t - dt.timedelta(1), "o1"), ("a", 4, "retire", "r2", t, "o1"), ("a", 5, "retire", "r3", t, "none"), ("a", 6, "retire", "r4", t, "r4"), ("a", 7, "retire", "r5", t, "o2"), ("b", 1, "obs", "o2", t, None)]
    got = {(r.line, r.severity, r.message.split(":")[0]) for r in observe.faults(spark.createDataFrame(rows, "path string, line int, form string, id string, at timestamp, supersedes string")).collect()}
    assert got == {(2, "error", "identity written before"), (3, "warning", "retired before it was taken"), (4, "error", "retired twice"), (5, "error", "no such record"), (6, "error", "a retirement of itself"), (7, "error", "written later in the log")}


def test_streamed_logs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.obs").write_text(LOG)
    for name in ("x", "y"):
        ingest.start(ingest.lines(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination(120)
        if name == "x":
            assert [r.id for r in ingest.current(spark, f"file://{tmp_path}/out").collect()] == ["o:2"]
            (tmp_path / "in" / "b.obs").write_text('retire r:9 2026-05-07T09:00:00Z o:2 "late"\nobs o:10 2026-05-06T09:14:22Z f:g 1.0 2.0 3.0 m:rtk fix:fixed 0.01 0.02 1.8 s:b\n')
    assert [r.id for r in ingest.current(spark, f"file://{tmp_path}/out").collect()] == ["o:10"]
    assert spark.read.parquet(f"file://{tmp_path}/out/faults").count() == 8


def test_rules(spark):
    params = "map<string,array<string>>"
    types = spark.createDataFrame([("Floor", [("contained-areas-sum", {"tolerance": ["area"]}), ("required-claim", {"predicate": ["width"]})])], f"name string, invariants array<struct<check:string,params:{params}>>")
    nodes = spark.createDataFrame([("f1", "Floor", "Storey", None), ("f2", "Floor", "Storey", None), ("r1", "Room", "Space", "f1"), ("r2", "Room", "Space", "f1"), ("r3", "Room", "Space", "f2"), ("r4", "Room", "Space", "f2")], "id string, type string, kind string, within string")
    asserts = spark.createDataFrame([("f2", "contained-areas-do-not-overlap", {"tolerance": ["area"]}), ("r1", "sits-inside", {"container": ["f1"]}), ("r1", "stays-clear-of-zone", {"zone": ["r2"]}), ("r3", "stays-clear-of-zone", {"zone": ["r4"]}), ("r1", "no-such-check", {}), ("r2", "sits-inside", {"container": ["f1"], "colour": ["x"]})], f"subject string, check string, params {params}")
    figs = regions.figures(figures(spark, ring("f1", 0, 0, 0, 10, 8), ring("r1", 0, 0, 0, 6, 8), ring("r2", 0, 6, 0, 4, 8), ring("f2", 0, 0, 0, 10, 8), ring("r3", 0, 0, 0, 6, 8), ring("r4", 0, 5, 0, 5, 8)), 1e-6).withColumn("corner_sigma", F.lit(0.001))
    tolerances = spark.createDataFrame([("area", 0.5)], "name string, value double")
    bound = rules.bound(types, nodes, asserts)
    assert {(r.subject, r.message) for r in rules.invalid(bound).collect()} == {("r1", "unknown check"), ("r2", "unknown parameter")}
    tables = {"nodes": nodes, "areas": figs, "tolerances": tolerances}
    found = rules.run(bound, tables, ["contained-areas-sum", "contained-areas-do-not-overlap", "sits-inside", "stays-clear-of-zone"])
    got = {(r.check, r.subject) for r in found.collect()}
    assert got == {("contained-areas-sum", "f2"), ("contained-areas-do-not-overlap", "f2"), ("stays-clear-of-zone", "r3")}
    tally = {r.check: (r.rules, r.ran, r.failed, r.unimplemented) for r in rules.tallies(bound, found).collect()}
    assert tally["contained-areas-sum"] == (2, 2, 1, 0) and tally["required-claim"] == (2, 0, 0, 2)


def test_review_findings(spark):
    schema = "subject string, predicate string, source string, method string, day int, value double, live boolean, id string, superseded_by string"
    base = spark.createDataFrame([("v1", "position", "s", "m", 1, 1.0, True, "c1", None), ("v2", "position", "s", "m", 1, 2.0, True, "c2", None)], schema)
    head = spark.createDataFrame([("v1", "position", "s", "m", 1, 1.5, True, "c1", None), ("v2", "position", "s", "m", 1, 2.0, False, "c2", "c9"), ("v3", "position", "t", "m", 2, 3.0, True, "c3", None)], schema)
    old = spark.createDataFrame([("n", ["v1", "v2"]), ("o", ["v1", "v2"])], "node string, corners array<string>")
    new = spark.createDataFrame([("n", ["v2", "v2"]), ("o", ["v1", "v3"])], "node string, corners array<string>")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    parts = {
        "boundary-moved-without-claim": review.moved(base, head).select("subject").unionAll(review.rerouted(old, new, base, head)),
        "claim-deprecated-without-replacement": review.deprecated(base, head).select("subject"),
        "id-disappeared-without-supersession": review.disappeared(ids("a", "b"), ids("b")).select(F.col("id").alias("subject")),
    }
    got = {(r.kind.split("-")[0], r.subject, r.ruling) for r in review.findings(parts, {"id-disappeared-without-supersession": "warning"}).collect()}
    assert got == {("boundary", "v1", "failure"), ("boundary", "n", "failure"), ("claim", "v2", "failure"), ("id", "a", "warning")}


def test_scalars(spark):
    row = spark.createDataFrame([("ns:a:b", "2026-02-30", "2026-02-28", "1.", "1.0e2", "12")], "i string, d string, e string, r string, s string, t string")
    got = row.select(units.namespace(F.col("i")), units.local(F.col("i")), units.is_id(F.col("i")), units.full_date(F.col("d")), units.full_date(F.col("e")), units.real(F.col("r")), units.real(F.col("s")), units.real(F.col("t"))).first()
    assert tuple(got) == ("ns", "a:b", True, None, dt.date(2026, 2, 28), None, 100.0, None)
    assert len(units.global_id("https://example.org", "site:a")) == 22 and units.compressed_uuid(b"\0" * 16) == "0" * 22 and units.compressed_uuid(b"\xff" * 16) == "3" + "$" * 21
    assert units.tree_digest([("b", b"1"), ("a", b"2")]) == units.tree_digest([("a", b"2"), ("b", b"1")]) != units.tree_digest([("a", b"21"), ("b", b"")])


def test_adjacency_is_not_dealt_out_pair_by_pair(spark):
    """Pairs are made where the rows of a node are, with ids of any type; nothing of the size of the pairs is exchanged."""
    rows = [(f"n{k % 7}", f"e{k % 5}") for k in range(35)] + [("n1", None), (None, "e1")]
    df = spark.createDataFrame(rows, "node string, edge string")
    found = graph.adjacent(df)
    assert {(r.a, r.b, tuple(r.via)) for r in found.collect()} == {(f"n{i}", f"n{j}", tuple(f"e{k}" for k in range(5))) for i in range(7) for j in range(7) if i != j}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.strip().splitlines()[0].lstrip().startswith("MapInArrow") and "Join" not in plan


def test_steps_end_where_a_component_is_reached(spark, monkeypatch):
    """Where every node is next to every other of its component no second step is walked; a chain beside it goes on."""
    whole = [(a, b) for a in range(6) for b in range(6) if a != b]
    chain = [(k, k + 1) for k in range(10, 14)]
    pairs = spark.createDataFrame([(a, b, [0]) for a, b in whole + chain + [(b, a) for a, b in chain]], "a long, b long, via array<long>")
    made = []
    monkeypatch.setattr(graph, "written", lambda df, name, put=graph.written: made.append(put(df, name)) or made[-1])
    got = {(r.start, r.node, r.depth) for r in graph.within_steps(pairs, pairs.select(F.col("a").alias("start")), 2).collect()}
    steps = {(k, k + d, abs(d)) for k in range(10, 15) for d in (-2, -1, 1, 2) if 10 <= k + d <= 14}
    assert got == {(a, b, 1) for a, b in whole} | steps
    assert {r.start for df in made if df.columns == ["start"] for r in df.collect()} == {10, 11, 12, 13, 14}


def test_coincident_points_are_joined_without_a_broadcast(spark, monkeypatch):
    """No table of the size of the points is built by the driver, and nodes go by an id and not by key and cell."""
    points = spark.createDataFrame([(k, "a", k * 0.3, 0.0, 1.0) for k in range(30)] + [(k, "b", k * 2.0, 0.0, 1.0) for k in range(30, 40)], "id long, k string, x double, y double, sigma double")
    links = []
    monkeypatch.setattr(geometry, "components", lambda edges, f=geometry.components, **more: links.append((edges, more)) or f(edges, **more))
    found = geometry.coincident(points, 0.5, ["k"])
    assert sorted((r.k, r.id, len(r.members)) for r in found.collect()) == [("a", 0, 30), *[("b", k, 1) for k in range(30, 40)]]
    assert links[0][0].dtypes == [("a", "bigint"), ("b", "bigint")] and links[0][1] == {"hint": "merge"}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
