"""The closed registry of checks: binding to subjects, running, tallies. Checks that decide nothing are counted apart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import budget, frames, regions

VIOLATION = "check string, subject string, message string"


@dataclass(frozen=True)
class Check:
    """``parameters`` has the kind of each, with a question mark where it may be left out; ``run`` takes the bound rules (subject, params) and the tables it reads, and returns violations (subject, message)."""

    name: str
    forms: tuple[str, ...]
    parameters: dict[str, str]
    run: Callable[[DataFrame, dict[str, DataFrame]], DataFrame] | None = None


def _param(name: str) -> F.Column:
    return F.element_at("params", name)[0]


def _floored(rules: DataFrame, t: dict[str, DataFrame], *names: str) -> DataFrame:
    """The rules with ``floor``: the value of the tolerance that the first parameter given names."""
    named = rules.withColumn("_tolerance", F.coalesce(*map(_param, names)))
    values = t["tolerances"].select(F.col("name").alias("_tolerance"), F.col("value").alias("floor")) if "tolerances" in t else None
    out = named.join(values, "_tolerance", "left") if values is not None else named.withColumn("floor", F.lit(None).cast("double"))
    return out.withColumn("floor", F.coalesce("floor", F.lit(1e-6))).drop("_tolerance")


def _shapes(t: dict[str, DataFrame], *columns: str) -> DataFrame:
    """Figures as (figure, position, columns): those read from one predicate, or from whichever a rule names."""
    areas = t["areas"] if "position" in t["areas"].columns else t["areas"].withColumn("position", F.lit(None).cast("string"))
    for name in ("corner_sigma",):
        if name not in areas.columns:
            areas = areas.withColumn(name, F.lit(None).cast("double"))
    return areas.select("figure", F.col("position").alias("_position"), *columns)


def _placed(rules: DataFrame, shapes: DataFrame, subject: str = "subject", how: str = "inner") -> DataFrame:
    """The rules joined with the figures of one of their columns, by the position predicate that they name."""
    bound = rules.withColumn("_asked", _param("position"))
    same = (F.col(subject) == F.col("figure")) & (F.col("_position").isNull() | F.col("_asked").isNull() | (F.col("_position") == F.col("_asked")))
    return bound.join(shapes, same, how).drop("_asked", "_position", "figure")


def _loops_close(rules: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """Every ring is one closed chain of its edges, or its loose ends lie within the tolerance of each other by the position predicate.

    Rings of lines are passed over. Without ``assembled`` the degrees of corners decide.
    """
    bound = _floored(rules, t, "tolerance").withColumn("_asked", _param("position")).drop("params")
    rings = bound.join(t["rings"].where("not open").select(F.col("node").alias("subject"), "loop", "start", "end"), "subject")
    ends = rings.select("subject", "loop", "floor", "_asked", F.explode(F.array("start", "end")).alias("corner"))
    odd = ends.groupBy("subject", "loop", "floor", "_asked", "corner").agg(F.count("*").alias("n")).where("n <> 2")
    if "positions" in t:
        at = t["positions"].select(F.col("vertex").alias("corner"), F.col("predicate").alias("_asked"), "x", "y")
        loose = odd.join(at, ["corner", "_asked"], "left")
        other = loose.select("subject", "loop", F.col("corner").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
        met = loose.join(other, ["subject", "loop"]).where("corner <> other and n = 1").where(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) <= F.col("floor"))
        odd = odd.join(met.select("subject", "loop", "corner"), ["subject", "loop", "corner"], "left_anti")
    wrong = odd.select("subject", "loop").distinct()
    if "assembled" in t:
        faults = t["assembled"].where("fault is not null and fault <> 'the ring does not close'").select(F.col("node").alias("subject"), "loop")
        closed = t["rings"].where("not open").select(F.col("node").alias("subject"), "loop")
        wrong = wrong.unionAll(faults.join(closed, ["subject", "loop"], "left_semi").join(bound.select("subject"), "subject", "left_semi")).distinct()
    return wrong.select("subject", F.concat(F.lit("does not close: "), "loop").alias("message"))


def _areas_sum(rules: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """The areas of what a subject contains against its own, or against a claimed figure, within the area tolerance.

    ``kind``, ``type`` and ``member-of`` narrow what is summed. A claimed figure widens the band by its uncertainty;
    a subject that contains nothing with a shape, or claims no figure, is left alone.
    """
    bound = _floored(rules, t, "area-tolerance", "tolerance")
    zones = F.col("member_of") if "member_of" in t["nodes"].columns else F.array().cast("array<string>")
    inner = t["nodes"].select("id", F.col("kind").alias("k"), F.col("type").alias("ty"), zones.alias("zones"), F.col("within").alias("subject"))
    joined = bound.join(inner, "subject")
    narrowed = [(_param("kind"), F.col("k") == _param("kind")), (_param("type"), F.col("ty") == _param("type"))]
    zone = F.coalesce(_param("member-of"), _param("zone"))
    for given, fits in [*narrowed, (zone, F.array_contains("zones", zone))]:
        joined = joined.where(given.isNull() | fits)
    parts = _placed(joined, _shapes(t, F.col("area").alias("part")), "id").groupBy("subject", "params", "floor").agg(F.sum("part").alias("parts"))
    own = _placed(parts.where(_param("predicate").isNull()), _shapes(t, F.col("area").alias("whole"))).withColumn("sigma", F.lit(None).cast("double"))
    wholes = own.select("subject", "floor", "parts", "whole", "sigma")
    if "resolved" in t:
        claimed = t["resolved"].select("subject", F.col("predicate").alias("_predicate"), F.col("value").alias("whole"), "sigma")
        asked = parts.withColumn("_predicate", _param("predicate")).join(claimed, ["subject", "_predicate"])
        wholes = wholes.unionAll(asked.select("subject", "floor", "parts", "whole", "sigma"))
    holds = budget.banded(F.abs(F.col("parts") - F.col("whole")), F.col("floor"), F.col("sigma"))["holds"]
    return wholes.where(~holds).select("subject", F.format_string("holds %.4f of %.4f", "parts", "whole").alias("message"))


def _agrees(rules: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """A resolved scalar against the computed area, or length where its unit is one of length, within the larger of floor and uncertainty.

    The floor is the discrepancy tolerance, or the tolerance where none is named. A corner's uncertainty moves an
    area by the perimeter and a length by itself; a side without accuracy adds no term.
    """
    bound = _floored(rules, t, "discrepancy", "tolerance").withColumn("_predicate", _param("predicate"))
    units_ = F.col("value_unit") if "value_unit" in t["resolved"].columns else F.lit(None).cast("string")
    claims = t["resolved"].select("subject", F.col("predicate").alias("_predicate"), F.col("value").alias("claimed"), "sigma", units_.alias("_unit"))
    claimed = bound.join(claims, ["subject", "_predicate"]).where("claimed is not null")
    shapes = _shapes(t, "area", F.col("perimeter").alias("length"), "corner_sigma")
    if "lengths" in t:
        none = F.lit(None).cast("double")
        sides = t["lengths"].select("figure", F.lit(None).cast("string").alias("_position"), none.alias("area"), "length", none.alias("corner_sigma"))
        shapes = shapes.unionByName(sides)
    both = _placed(claimed, shapes)
    linear = F.coalesce(F.col("_unit").isin("m", "mm", "cm", "km", "ft", "usft", "in"), F.lit(False)) | F.col("area").isNull()
    measured = F.when(linear, F.col("length")).otherwise(F.col("area"))
    sigma = F.hypot(F.coalesce("sigma", F.lit(0.0)), F.coalesce(F.col("corner_sigma") * F.when(linear, F.lit(1.0)).otherwise(F.col("length")), F.lit(0.0)))
    judged = both.withColumns({"measured": measured, "wide": sigma}).where("measured is not null")
    holds = budget.banded(F.abs(F.col("claimed") - F.col("measured")), F.col("floor"), F.col("wide"))["holds"]
    return judged.where(~holds).select("subject", F.format_string("claims %.4f, measures %.4f", "claimed", "measured").alias("message"))


def _no_overlap(rules: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """No two contained regions, of one kind if the rule names it, have anything in common beyond slivers of the tolerance."""
    bound = _floored(rules, t, "tolerance").select(F.col("subject").alias("parent"), "params", "floor", _param("kind").alias("_kind"))
    inner = t["nodes"].select(F.col("id").alias("child"), F.col("within").alias("parent"), F.col("kind").alias("k")).join(bound, "parent").where("_kind is null or _kind = k")
    figs = _placed(inner, _shapes(t, "rings"), "child").select(F.col("child").alias("figure"), "parent", F.col("floor").alias("tolerance"), "rings").where("rings is not null")
    pairs = regions.meeting(figs, figs, 25.0, ["parent", "tolerance"]).where("a < b")
    common = regions.overlay(pairs, "intersection", None).where("size(rings) > 0").join(pairs.select("a", "b", "parent"), ["a", "b"])
    return common.select(F.col("parent").alias("subject"), F.concat(F.col("a"), F.lit(" overlaps "), F.col("b")).alias("message"))


def _sided(rules: DataFrame, t: dict[str, DataFrame], other: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, rings_a, rings_b, tolerance, sigma_a, sigma_b) of the figures that rules name and their subjects, and those without a shape."""
    bound = _floored(rules, t, "tolerance").withColumn("other", _param(other))
    outer = _placed(bound, _shapes(t, F.col("rings").alias("rings_a"), F.col("corner_sigma").alias("sigma_a")), "other", "left")
    both = _placed(outer, _shapes(t, F.col("rings").alias("rings_b"), F.col("corner_sigma").alias("sigma_b")), "subject", "left")
    known = both.where("rings_a is not null and rings_b is not null")
    pairs = known.select(F.col("other").alias("a"), F.col("subject").alias("b"), "rings_a", "rings_b", F.col("floor").alias("tolerance"), "sigma_a", "sigma_b").dropDuplicates(["a", "b", "tolerance"])
    return pairs, both.where("rings_a is null or rings_b is null")


def _sits_inside(rules: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """The subject reaches past the container's boundary by no more than the tolerance or the quadrature of both sides' corners.

    A subject without a region is judged by its points, if ``points`` (subject, position, x, y, sigma) has any.
    """
    pairs, bare = _sided(rules, t, "container")
    depths = regions.reach_outside(pairs.select("a", "b", "rings_a", "rings_b", "tolerance")).join(pairs.select("a", "b", F.col("tolerance").alias("floor"), "sigma_a", "sigma_b"), ["a", "b"])
    if "points" in t:
        at = t["points"].select("subject", F.col("position").alias("_at"), "x", "y", F.col("sigma").alias("sigma_p"))
        dots = bare.where("rings_a is not null").withColumn("_asked", _param("position")).join(at, "subject").where("_asked is null or _at = _asked")
        spot = F.array(F.array(F.struct("x", "y")))
        placed = dots.select(F.col("other").alias("a"), F.col("subject").alias("b"), "rings_a", spot.cast(regions.FIGURE).alias("rings_b"), F.col("floor").alias("tolerance"), "sigma_a", F.col("sigma_p").alias("sigma_b"))
        found = regions.points_outside(placed).groupBy("a", "b").agg(F.max("depth").alias("depth"))
        own = placed.groupBy("a", "b").agg(F.min("tolerance").alias("floor"), F.max("sigma_a").alias("sigma_a"), F.max("sigma_b").alias("sigma_b"))
        depths = depths.unionByName(found.join(own, ["a", "b"]))
        bare = bare.join(dots.select("subject", "other"), ["subject", "other"], "left_anti")
    sigma = F.hypot(F.coalesce("sigma_a", F.lit(0.0)), F.coalesce("sigma_b", F.lit(0.0)))
    holds = budget.banded(F.col("depth"), F.col("floor"), sigma)["holds"]
    out = depths.where(~holds).select(F.col("b").alias("subject"), F.format_string("reaches %.4f past %s", "depth", "a").alias("message"))
    return out.unionAll(bare.select("subject", F.concat(F.lit("no shape to compare with "), "other").alias("message")))


def _stays_clear(rules: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """The subject and the zone have nothing in common beyond slivers of the tolerance."""
    pairs, bare = _sided(rules, t, "zone")
    found = regions.overlay(pairs, "intersection", None).where("size(rings) > 0")
    out = found.select(F.col("b").alias("subject"), F.format_string("has %.4f in common with %s", "area", "a").alias("message"))
    return out.unionAll(bare.select("subject", F.concat(F.lit("no shape to compare with "), "other").alias("message")))


def _backing(rules: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """Backing ids name elements."""
    elements = t["nodes"].where("kind = 'Element'").select(F.col("id").alias("element"))
    named = rules.select("subject").join(t["backing"], F.col("subject") == F.col("edge"))
    return named.join(elements, "element", "left_anti").select("subject", F.concat(F.lit("backed by no element: "), "element").alias("message"))


def _frame_budget(rules: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """The combined uncertainty of the transforms between a subject's frame and the one that the rule names, within a limit.

    A subject in the named frame passes, since nothing is transformed; one without a frame, or with a route of
    unknown accuracy, does not. ``subjects`` has (id, frame) of every family.
    """
    bound = _floored(rules, t, "limit").withColumn("target", _param("frame"))
    placed = bound.join(t["subjects"].select(F.col("id").alias("subject"), F.col("frame").alias("own")), "subject")
    moved = placed.where("own is null or target is null or own <> target")
    pairs = moved.where("own is not null and target is not null").select(F.col("own").alias("a"), F.col("target").alias("b"))
    rooted = t["paths"].groupBy("frame").agg(F.max(F.struct("depth", "ancestor"))["ancestor"].alias("root"))
    found = frames.budgets(t["paths"], pairs, t["transforms"], t["terms"]).select(F.col("a").alias("own"), F.col("b").alias("target"), "sigma")
    ends = [rooted.select(F.col("frame").alias(c), F.col("root").alias(f"{c}_root")) for c in ("own", "target")]
    judged = moved.join(found, ["own", "target"], "left").join(ends[0], "own", "left").join(ends[1], "target", "left")
    apart = F.coalesce(F.col("own_root") != F.col("target_root"), F.lit(True))
    return judged.where(apart | F.col("sigma").isNull() | (F.col("sigma") > F.col("floor"))).select("subject", F.lit("the route between the frames is unknown or beyond its limit").alias("message"))


def _ground_to_grid(rules: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """A chain whose root names a reference system under ``crs`` states ``ground-to-grid`` somewhere, or has a scale that is not 1.

    ``frame_claims`` has (frame, predicate) of what is stated of frames, ``scales`` (frame, scale).
    """
    bound = rules.select("subject", _param("crs").alias("crs"), _param("ground-to-grid").alias("factor"))
    placed = bound.join(t["subjects"].select(F.col("id").alias("subject"), "frame"), "subject").where("frame is not null")
    chain = placed.join(t["paths"], "frame")
    said = t["frame_claims"].select(F.col("frame").alias("ancestor"), "predicate").distinct()
    scaled = t["scales"].where("scale <> 1.0").select(F.col("frame").alias("ancestor"), F.lit(True).alias("scaled"))
    keys = ["subject", "crs", "factor"]
    top = placed.join(t["paths"].groupBy("frame").agg(F.max(F.struct("depth", "ancestor"))["ancestor"].alias("root")), "frame")
    projected = top.join(said.select(F.col("ancestor").alias("root"), F.col("predicate").alias("crs")), ["root", "crs"], "left_semi").select(*keys)
    stated = chain.join(said.select("ancestor", F.col("predicate").alias("factor")), ["ancestor", "factor"], "left_semi").select(*keys)
    fitted = chain.join(scaled, "ancestor", "left_semi").select(*keys)
    silent = projected.join(stated, keys, "left_anti").join(fitted, keys, "left_anti")
    return silent.select("subject", F.lit("no frame of the chain states ground to grid").alias("message")).distinct()


# The registered checks, the forms they examine and the parameters they take.
CHECKS = {
    c.name: c
    for c in (
        Check("boundary-loops-close", ("node",), {"tolerance": "tolerance", "position": "predicate?"}, _loops_close),
        Check("claim-agrees-with-geometry", ("node", "edge", "loop"), {"predicate": "predicate", "position": "predicate", "tolerance": "tolerance", "discrepancy": "tolerance"}, _agrees),
        Check("contained-areas-do-not-overlap", ("node",), {"tolerance": "tolerance", "position": "predicate", "kind": "kind?"}, _no_overlap),
        Check("contained-areas-sum", ("node",), {"tolerance": "tolerance", "area-tolerance": "tolerance", "position": "predicate", "predicate": "predicate?", "kind": "kind?", "type": "type?", "member-of": "node?"}, _areas_sum),
        Check("cross-frame-budget-holds", ("node", "vertex", "edge", "loop"), {"frame": "frame", "limit": "tolerance"}, _frame_budget),
        Check("edge-backing-resolves", ("edge",), {}, _backing),
        Check("ground-to-grid-stated", ("node", "vertex", "edge", "loop"), {"crs": "predicate", "ground-to-grid": "predicate", "position": "predicate"}, _ground_to_grid),
        Check("sits-inside", ("node",), {"container": "node", "tolerance": "tolerance", "position": "predicate"}, _sits_inside),
        Check("stays-clear-of-zone", ("node",), {"zone": "node", "tolerance": "tolerance", "position": "predicate"}, _stays_clear),
        Check("edge-endpoints-differ", ("edge",), {}),
        Check("required-claim", ("node", "vertex", "edge", "loop"), {"predicate": "predicate"}),
        Check("within-resolves", ("node",), {}),
        Check("zone-members-resolve", ("node",), {}),
    )
}


def bound(types: DataFrame, nodes: DataFrame, assertions: DataFrame) -> DataFrame:
    """All rules (check, subject, params, origin): invariants on the instances of their type, and assertions."""
    invariants = types.select(F.col("name").alias("type"), F.explode("invariants").alias("i")).join(nodes.select("id", "type"), "type")
    one = invariants.select(F.col("i.check").alias("check"), F.col("id").alias("subject"), F.col("i.params").alias("params"), F.lit("invariant").alias("origin"))
    return one.unionAll(assertions.select("check", "subject", "params", F.lit("assertion").alias("origin")))


def invalid(rules: DataFrame) -> DataFrame:
    """Rules that name no registered check, or parameters that it does not take."""
    known = F.create_map(*[x for n, c in CHECKS.items() for x in (F.lit(n), F.array(*map(F.lit, c.parameters)) if c.parameters else F.array().cast("array<string>"))])
    takes = known[F.col("check")]
    extra = F.array_except(F.coalesce(F.map_keys("params"), F.array().cast("array<string>")), takes)
    return rules.where(takes.isNull() | (F.size(extra) > 0)).select("check", "subject", F.when(takes.isNull(), "unknown check").otherwise("unknown parameter").alias("message"))


def incomplete(rules: DataFrame) -> DataFrame:
    """Rules that lack a parameter which their check requires: (check, subject, missing)."""
    needs = F.create_map(*[x for n, c in CHECKS.items() for x in (F.lit(n), F.array(*[F.lit(p) for p, kind in c.parameters.items() if not kind.endswith("?")]).cast("array<string>"))])
    missing = F.array_except(needs[F.col("check")], F.coalesce(F.map_keys("params"), F.array().cast("array<string>")))
    return rules.withColumn("missing", missing).where("size(missing) > 0").select("check", "subject", "missing")


def run(rules: DataFrame, tables: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
    """Violations (check, subject, message) of all runnable checks: one query for each check, not for each rule."""
    parts = []
    for name, check in CHECKS.items():
        if check.run is not None and (names is None or name in names):
            found = check.run(rules.where(F.col("check") == name), tables)
            parts.append(found.select(F.lit(name).alias("check"), F.col("subject").cast("string").alias("subject"), "message"))
    if not parts:
        return rules.sparkSession.createDataFrame([], VIOLATION)
    return reduce(DataFrame.unionAll, parts)


def tallies(rules: DataFrame, violations: DataFrame) -> DataFrame:
    """(check, rules, ran, failed, passed, unimplemented)."""
    runnable = F.col("check").isin([n for n, c in CHECKS.items() if c.run])
    failed = violations.select("check", "subject").distinct().withColumn("bad", F.lit(True))
    joined = rules.select("check", F.col("subject").cast("string").alias("subject")).join(failed, ["check", "subject"], "left")
    bad = F.sum(F.when(F.col("bad"), 1).otherwise(0))
    ran = F.sum(F.when(runnable, 1).otherwise(0))
    return joined.groupBy("check").agg(F.count("*").alias("rules"), ran.alias("ran"), bad.alias("failed"), (ran - bad).alias("passed"), F.sum(F.when(runnable, 0).otherwise(1)).alias("unimplemented"))
