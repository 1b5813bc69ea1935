"""The named questions about a loaded model, composed from the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.kernels import plane
from ledgerline.operators import frames, graph, lookup, regions, resolution, review, rules
from ledgerline.scratch import written
from ledgerline.sources.entity import Model


def entities(model: Model) -> DataFrame:
    """(id, family, type, kind, frame, label) of everything that has an id."""
    none = F.lit(None).cast("string")
    parts = [model.nodes.select("id", F.lit("node").alias("family"), "type", "kind", "frame", "label")]
    for family, table in (("vertex", model.vertices), ("edge", model.edges), ("loop", model.loops)):
        parts.append(table.select("id", F.lit(family).alias("family"), none.alias("type"), none.alias("kind"), "frame", "label"))
    parts.append(model.frames.select(F.col("frame").alias("id"), F.lit("frame").alias("family"), none.alias("type"), none.alias("kind"), none.alias("frame"), "label"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def get(model: Model, id_: str) -> DataFrame:
    """An entity with its live claims; nothing if the model does not hold it."""
    live = model.live_claims.where("live").select("subject", "predicate", "value", "source", "method", "accuracy", "day")
    return lookup.nested(entities(model).where(F.col("id") == id_), live)


def resolved(model: Model, predicate: str | None = None) -> DataFrame:
    """The answer for each (subject, predicate): the one candidate's claim, and why; no answer where it is ambiguous."""
    claims = model.live_claims
    if predicate is not None:
        claims = claims.where(F.col("predicate") == predicate)
    rows = resolution.marked(claims).where("candidate and n_candidates = 1")
    return rows.select("subject", "predicate", "reason", "value", "sigma", "unit", "day", "source", "method", "id")


def positions(model: Model, predicate: str) -> DataFrame:
    """(vertex, x, y, z, sigma) of subjects with one current position; a third component that is not written is 0."""
    c = F.col("value.coord")
    return resolved(model, predicate).where("value.coord is not null").select(F.col("subject").alias("vertex"), c[0].alias("x"), c[1].alias("y"), F.coalesce(F.get(c, F.lit(2)), F.lit(0.0)).alias("z"), "sigma")


def boundary_edges(model: Model) -> DataFrame:
    """(node, loop, loop_ord, edge, edge_ord, start, end) of all boundaries, in authored order."""
    nodes = model.nodes.select(F.col("id").alias("node"), F.col("geometry"), F.posexplode("boundary").alias("loop_ord", "loop"))
    loops = model.loops.select(F.col("id").alias("loop"), F.posexplode("edges").alias("edge_ord", "edge"))
    edges = model.edges.select(F.col("id").alias("edge"), "start", "end")
    return nodes.join(loops, "loop").join(edges, "edge")


def rings(model: Model) -> DataFrame:
    """``boundary_edges`` with ``open`` (a run: the node draws a line) and the corner that each edge is walked from."""
    by = Window.partitionBy("node", "loop").orderBy("edge_ord")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = boundary_edges(model).withColumn("open", F.col("geometry") == "line")
    following = {n: F.coalesce(F.lead(c).over(by), F.first(c).over(whole)) for n, c in (("next_start", "start"), ("next_end", "end"))}
    rows = rows.withColumns(following).withColumn("n_edges", F.count("*").over(whole))
    shared = lambda c: (F.col(c) == F.col("next_start")) | (F.col(c) == F.col("next_end"))
    forward = F.when(shared("end") & shared("start"), F.col("edge_ord") == 0).otherwise(shared("end"))
    return rows.withColumn("corner", F.when(forward, F.col("start")).otherwise(F.col("end"))).drop("next_start", "next_end")


def assembled(model: Model) -> DataFrame:
    """(node, loop, fault) of every boundary: why its edges are no ring (or no run, for a line), or null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            faults = [plane.assembly([(e["edge"], e["start"], e["end"]) for e in edges], geometry == "line") for edges, geometry in zip(frame["walked"], frame["geometry"], strict=True)]
            yield frame[["node", "loop"]].assign(fault=pd.Series(faults, dtype=object))

    rows = boundary_edges(model).groupBy("node", "loop").agg(F.sort_array(F.collect_list(F.struct("edge_ord", "edge", "start", "end"))).alias("walked"), F.first("geometry").alias("geometry"))
    return rows.mapInPandas(run, "node string, loop string, fault string")


def figures(model: Model, position: str, tolerance: float) -> DataFrame:
    """Regions of all nodes with closed boundaries; a ring that does not close, or has a corner without a position, has no region."""
    walked = rings(model).where("not open")
    corners_of = F.size(F.array_distinct(F.flatten(F.collect_list(F.array("start", "end")))))
    loose = walked.groupBy("node", "loop").agg(corners_of.alias("corners"), F.count("*").alias("n")).where("corners <> n")  # no ring has more corners than edges
    closed = walked.join(loose.select("node"), "node", "left_anti")
    placed = closed.join(positions(model, position).select(F.col("vertex").alias("corner"), "x", "y", "sigma"), "corner", "left")
    known = placed.groupBy("node").agg(F.max(F.col("x").isNull().cast("int")).alias("missing"), F.max("sigma").alias("corner_sigma"))
    corners = placed.join(known.where("missing = 0").select("node"), "node", "left_semi").select(F.col("node").alias("figure"), F.col("loop_ord").alias("ring"), F.col("edge_ord").alias("ord"), "x", "y")
    return regions.figures(corners, tolerance).join(known.select(F.col("node").alias("figure"), "corner_sigma"), "figure")


def classification(model: Model) -> DataFrame:
    """(edge, boundary): physical where an element backs the edge, else virtual."""
    backing = model.edges.select(F.col("id").alias("edge"), F.explode_outer("backed_by").alias("element"))
    elements = model.nodes.where("kind = 'Element'").select(F.col("id").alias("element"), F.lit(1).alias("held"))
    counted = backing.join(elements, "element", "left").groupBy("edge").agg(F.count("held").alias("n"))
    return counted.select("edge", F.when(F.col("n") > 0, "physical").otherwise("virtual").alias("boundary"))


def adjacent(model: Model) -> DataFrame:
    return graph.adjacent(boundary_edges(model).select("node", "edge"))


def traverse(model: Model, start: str, relation: str, depth: int | None = None, kind: str | None = None, type_: str | None = None) -> DataFrame:
    """(node, depth) by one relation; filters narrow what is reported, not what is walked."""
    begin = model.nodes.sparkSession.createDataFrame([(start,)], "start string")
    if relation == "contains":
        found = graph.descendants(model.nodes, begin, depth)
    elif relation == "contained-by":
        found = graph.ancestors(model.nodes, begin, depth)
    elif relation == "members-of":
        member = model.nodes.select(F.explode("member_of").alias("source"), F.col("id").alias("target"))
        found = graph.walk(member, begin, depth)
    elif relation == "boundary-of":
        found = graph.walk(boundary_edges(model).select(F.col("loop").alias("source"), F.col("node").alias("target")), begin, depth)
    elif relation == "adjacent-to":
        found = graph.within_steps(adjacent(model), begin, 1 if depth is None else depth)
    else:
        raise ValueError(f"no relation {relation}")
    out = found.select("node", "depth").join(model.nodes.select(F.col("id").alias("node"), "kind", "type"), "node")
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    if type_ is not None:
        out = out.where(F.col("type") == type_)
    return out.orderBy("depth", "node")


def measure(model: Model, position: str, tolerance: float) -> DataFrame:
    """(id, form, length, area, x, y): edges by their ends, runs by their edges, regions by their rings, points by their place."""
    at = positions(model, position)
    a = at.select(F.col("vertex").alias("start"), *[F.col(c).alias(f"{c}1") for c in "xyz"])
    b = at.select(F.col("vertex").alias("end"), *[F.col(c).alias(f"{c}2") for c in "xyz"])
    square = sum((F.pow(F.col(f"{c}2") - F.col(f"{c}1"), F.lit(2.0)) for c in "xyz"), F.lit(0.0))
    sides = model.edges.select(F.col("id").alias("edge"), "start", "end").join(a, "start").join(b, "end").select("edge", F.sqrt(square).alias("length"))
    none = F.lit(None).cast("double")
    edges = sides.select(F.col("edge").alias("id"), F.lit("edge").alias("form"), "length", none.alias("area"))
    runs = rings(model).where("open").join(sides, "edge", "left").groupBy("node").agg(F.sum("length").alias("length"), F.max(F.col("length").isNull().cast("int")).alias("missing"))
    lines = runs.select(F.col("node").alias("id"), F.lit("line").alias("form"), F.when(F.col("missing") == 0, F.col("length")).alias("length"), none.alias("area"))
    areas = figures(model, position, tolerance).select(F.col("figure").alias("id"), F.lit("region").alias("form"), F.col("perimeter").alias("length"), "area")
    points = model.nodes.where("geometry = 'point'").select(F.col("id")).join(at.withColumnRenamed("vertex", "id"), "id").select("id", F.lit("point").alias("form"), none.alias("length"), none.alias("area"))
    return edges.unionAll(lines).unionAll(areas).unionAll(points)


def tessellate(start: tuple, end: tuple, centre: tuple, through: tuple, tolerance: float) -> list[tuple[float, float]]:
    return plane.tessellate(start, end, centre, through, tolerance)


def plan_of(model: Model, storey: str, position: str, tolerance: float, annotate: list[str] | None = None) -> DataFrame:
    """Everything inside a storey: its outline, or why it has none, and its live claims."""
    inside = traverse(model, storey, "contains").select(F.col("node").alias("id"))
    nodes = model.nodes.join(inside, "id", "left_semi").select("id", "geometry", (F.size("boundary") > 0).alias("has_loop"), "kind", "type", "label")
    notes = model.live_claims.select("subject", "predicate", F.to_json("value").alias("value"), "live")
    if annotate is not None:
        notes = notes.where(F.col("predicate").isin(annotate))
    return regions.plan(nodes, figures(model, position, tolerance), notes).orderBy("id")


def buildable_of(model: Model, position: str, setback: str, tolerance: float) -> DataFrame:
    """What setbacks on their edges leave of all plots that have one; an edge without a current claim refuses its plot."""
    at = positions(model, position)
    claimed = resolved(model, setback).select(F.col("subject").alias("edge"), F.col("value.scalar").alias("setback"))
    sides = rings(model).where("not open").join(claimed, "edge", "left")
    placed = sides.join(at.select(F.col("vertex").alias("start"), F.col("x").alias("ax"), F.col("y").alias("ay")), "start").join(at.select(F.col("vertex").alias("end"), F.col("x").alias("bx"), F.col("y").alias("by")), "end")
    asked = placed.where("setback is not null").select(F.col("node").alias("figure")).distinct()
    figs = figures(model, position, tolerance).where("fault is null").join(asked, "figure", "left_semi")
    return regions.buildable(figs, placed.select(F.col("node").alias("figure"), "ax", "ay", "bx", "by", "setback"), tolerance)


def observed(model: Model) -> DataFrame:
    """(entity, file) of the observation logs that entities name."""
    tables = [model.nodes, model.vertices, model.edges, model.loops]
    out = None
    for t in tables:
        part = t.select(F.col("id").alias("entity"), F.explode("observed_in").alias("file"))
        out = part if out is None else out.unionAll(part)
    return out


def at_root(model: Model, position: str) -> DataFrame:
    """Positions of vertices carried to the root frame."""
    placed = positions(model, position).join(model.vertices.select(F.col("id").alias("vertex"), "frame"), "vertex")
    return frames.at_root(placed.select("vertex", "frame", "x", "y", "z"), frames.resolved(model.frames, model.claims))


def subjects(model: Model) -> DataFrame:
    """(id, frame) of everything that a rule may be about."""
    out = model.nodes.select("id", "frame")
    for t in (model.vertices, model.edges, model.loops):
        out = out.unionAll(t.select("id", "frame"))
    return out


def transform_terms(model: Model) -> DataFrame:
    """Accuracy terms (claim, kind, magnitude, unit, source, ord) of the claims that frames name as their transforms."""
    held = model.live_claims.where("live").join(model.frames.select(F.col("transform_claim").alias("id")).distinct(), "id", "left_semi")
    one = held.select(F.col("id").alias("claim"), F.posexplode("accuracy").alias("ord", "t"))
    return one.select("claim", "t.kind", "t.magnitude", "t.unit", "t.source", "ord")


def transform_budget(model: Model, pairs: DataFrame) -> DataFrame:
    """Combined uncertainty of the routes between pairs (a, b) of frames."""
    transforms = model.frames.where("parent is not null").select("frame", F.coalesce("transform_claim", F.lit("")).alias("claim"))
    return frames.budgets(frames.paths(model.frames), pairs, transforms, transform_terms(model))


def in_frame(model: Model, id_: str, position: str, target: str) -> DataFrame:
    """A vertex's position in another frame, with the uncertainty of the route there."""
    placed = positions(model, position).where(F.col("vertex") == id_).join(model.vertices.select(F.col("id").alias("vertex"), "frame"), "vertex")
    points = placed.select("vertex", "frame", F.lit(target).alias("target"), "x", "y", "z", "sigma")
    moved = frames.carried(points, frames.resolved(model.frames, model.claims))
    budgets = transform_budget(model, points.select(F.col("frame").alias("a"), F.col("target").alias("b")))
    return moved.join(budgets.select(F.col("a").alias("frame"), F.col("b").alias("target"), F.col("sigma").alias("route_sigma"), F.col("status").alias("route")), ["frame", "target"], "left")


class Tables(dict):
    """Tables by name that are made, and written once, when a check first reads them."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        super().__init__()
        self.makers = makers

    def __contains__(self, name: object) -> bool:
        return name in self.makers

    def __missing__(self, name: str) -> DataFrame:
        self[name] = made = written(self.makers[name](), f"check-{name}")
        return made


def check_tables(model: Model, position: str, tolerance: float, bound: DataFrame) -> Tables:
    """What the checks read. Figures are made for every position predicate that a rule names, or else for ``position``."""
    named = [r.p for r in bound.select(F.element_at("params", "position")[0].alias("p")).where("p is not null").distinct().collect()]  # names of the registry
    names = named or [position]
    held = lambda name: F.lit(name if named else None).cast("string")
    each = lambda make: reduce(DataFrame.unionByName, map(make, names))
    walked = lambda: made["rings"]

    def points(name: str) -> DataFrame:
        ends = walked().where("open").select(F.col("node").alias("subject"), F.explode(F.array("start", "end")).alias("vertex")).distinct()
        own = model.nodes.where("geometry = 'point'").select(F.col("id").alias("subject"), F.col("id").alias("vertex"))
        at = made["positions"].where(F.col("predicate") == name).select("vertex", "x", "y", "sigma")
        return ends.unionAll(own).join(at, "vertex").select("subject", held(name).alias("position"), "x", "y", "sigma")

    def frame_claims() -> DataFrame:
        stated = model.claims.where("rank <> 'deprecated'").select("subject", "predicate").unionAll(model.plain_values.select("subject", "predicate"))
        return stated.join(model.frames.select(F.col("frame").alias("subject")), "subject", "left_semi").select(F.col("subject").alias("frame"), "predicate")

    transforms = lambda: model.frames.where("parent is not null").select("frame", F.coalesce("transform_claim", F.lit("")).alias("claim"))
    scales = lambda: frames.resolved(model.frames, model.live_claims).where("transform is not null").select("frame", F.col("transform.scale").alias("scale"))
    scalars = lambda: resolved(model).where("value.scalar is not null").select("subject", "predicate", F.col("value.scalar").alias("value"), "sigma", F.col("value.unit").alias("value_unit"))
    made = Tables({
        "nodes": lambda: model.nodes, "rings": lambda: rings(model), "assembled": lambda: assembled(model), "positions": lambda: each(lambda n: positions(model, n).withColumn("predicate", F.lit(n))),
        "areas": lambda: each(lambda n: figures(model, n, tolerance).withColumn("position", held(n))), "points": lambda: each(points),
        "lengths": lambda: measure(model, names[0], tolerance).where("form = 'edge'").select(F.col("id").alias("figure"), "length"), "tolerances": lambda: model.tolerances, "resolved": scalars,
        "backing": lambda: model.edges.select(F.col("id").alias("edge"), F.explode("backed_by").alias("element")), "subjects": lambda: subjects(model), "paths": lambda: frames.paths(model.frames),
        "transforms": transforms, "terms": lambda: transform_terms(model), "frame_claims": frame_claims, "scales": scales,
    })
    return made


def check(model: Model, position: str, tolerance: float, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Violations and tallies of all rules of a model; ``position`` locates corners for rules that name no predicate."""
    bound = written(rules.bound(model.types, model.nodes, model.assertions), "rules")
    present = [r.check for r in bound.select("check").distinct().collect()]  # names of the registry
    asked = [n for n in rules.CHECKS if n in present and (names is None or n in names)]
    violations = written(rules.run(bound, check_tables(model, position, tolerance, bound), asked), "violations")
    return violations, rules.tallies(bound, violations)


def compare(base: Model, head: Model, policy: dict[str, str] | None = None) -> DataFrame:
    """Findings between two revisions of a model."""
    claims = lambda m: m.live_claims.select("subject", "predicate", "source", "method", "day", F.to_json("value").alias("value"), "live", "id", "superseded_by")
    corners = lambda m: rings(m).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("loop_ord", "edge_ord", "corner"))).alias("c")).select("node", F.transform("c", lambda x: x["corner"]).alias("corners"))
    b, h = claims(base), claims(head)
    on_boundary = boundary_edges(head).select(F.explode(F.array("start", "end")).alias("subject")).distinct()  # an open run has a corner more than edges
    moved = review.moved(b.where("live"), h.where("live")).join(on_boundary, "subject", "left_semi").select("subject")
    retired = head.nodes.where("retired is not null").select("id")
    gone = review.disappeared(base.ids(), head.ids().unionAll(retired)).select(F.col("id").alias("subject"))
    return review.findings({
        "boundary-moved-without-claim": moved.unionAll(review.rerouted(corners(base), corners(head), b, h)).distinct(),
        "claim-deprecated-without-replacement": review.deprecated(b.where("id is not null"), h.where("id is not null")).select("subject"),
        "id-disappeared-without-supersession": gone,
    }, policy).orderBy("kind", "subject")
