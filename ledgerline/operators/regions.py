"""Regions of nodes and what is decided with them, through Arrow-batched kernels.

Figures travel as ``array<array<struct<x,y>>>``. Pairs are formed by joins on frames and overlapping grid
cells; only pairs whose bounds meet reach a kernel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.kernels import plane
from ledgerline.operators import budget, frames
from ledgerline.scratch import written

FIGURE = "array<array<struct<x:double,y:double>>>"


def _read(value) -> plane.Figure:
    return [[(p["x"], p["y"]) for p in ring] for ring in value] if value is not None else []


def _write(figure: plane.Figure) -> list:
    return [[{"x": x, "y": y} for x, y in ring] for ring in figure]


def figures(rings: DataFrame, tolerance: float) -> DataFrame:
    """(figure, rings, area, perimeter, fault) from corners (figure, ring, ord, x, y).

    Rings are nested, so that holes wind clockwise; a figure with a fault has null rings and figures.
    """
    corners = rings.groupBy("figure", "ring").agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))).alias("c"))
    one = corners.groupBy("figure").agg(F.sort_array(F.collect_list(F.struct("ring", F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("c")))).alias("r"))
    one = one.select("figure", F.transform("r", lambda r: r["c"]).alias("raw"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, raw in zip(frame["figure"], frame["raw"], strict=True):
                parts = _read(raw)
                fault = next((f for f in (plane.fault(r, tolerance) for r in parts) if f), None)
                figure = None
                if fault is None:
                    try:
                        figure = plane.figure_of(parts, tolerance)
                    except ValueError as e:
                        fault = str(e)
                rows.append((name, _write(figure) if figure else None, plane.figure_area(figure) if figure else None, sum(map(plane.perimeter, figure)) if figure else None, fault))
            yield pd.DataFrame(rows, columns=["figure", "rings", "area", "perimeter", "fault"])

    kind = dict(rings.dtypes)["figure"]
    return one.mapInPandas(run, f"figure {kind}, rings {FIGURE}, area double, perimeter double, fault string")


def bounded(figs: DataFrame) -> DataFrame:
    """Adds the bounds of ``rings``."""
    xs, ys = (F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p[c]))) for c in ("x", "y"))  # noqa: B023
    return figs.withColumns({"minx": F.array_min(xs), "maxx": F.array_max(xs), "miny": F.array_min(ys), "maxy": F.array_max(ys)})


def meeting(left: DataFrame, right: DataFrame, cell: float, on: list[str] | None = None, reach: float = 0.0) -> DataFrame:
    """Pairs (a, b, rings_a, rings_b) whose bounds, widened by ``reach``, overlap; formed cell by cell, each pair once."""
    on = on or []

    def spread(figs: DataFrame, side: str) -> DataFrame:
        cells = lambda low, high: F.explode(F.sequence(F.floor((F.col(low) - reach) / cell), F.floor((F.col(high) + reach) / cell)))
        out = bounded(figs.where("rings is not null")).withColumn("gx", cells("minx", "maxx")).withColumn("gy", cells("miny", "maxy"))
        return out.select(*on, "gx", "gy", F.col("figure").alias(side), F.col("rings").alias(f"rings_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in ("minx", "maxx", "miny", "maxy")])

    pairs = spread(left, "a").join(spread(right, "b"), [*on, "gx", "gy"])
    apart = (F.col("minx_a") - reach > F.col("maxx_b")) | (F.col("minx_b") - reach > F.col("maxx_a")) | (F.col("miny_a") - reach > F.col("maxy_b")) | (F.col("miny_b") - reach > F.col("maxy_a"))
    first_x = F.floor((F.greatest("minx_a", "minx_b") - reach) / cell)
    first_y = F.floor((F.greatest("miny_a", "miny_b") - reach) / cell)
    return pairs.where(~apart).where((F.col("gx") == first_x) & (F.col("gy") == first_y)).select(*on, "a", "b", "rings_a", "rings_b")


def _paired(pairs: DataFrame, columns: dict[str, str], kernel: Callable[..., tuple], tolerance: float | None = None) -> DataFrame:
    """``kernel`` of the two figures and the tolerance of every pair, which is that of its row unless one is given."""
    kinds = dict(pairs.dtypes)
    added = ", ".join(f"{n} {t}" for n, t in columns.items())
    own = F.lit(float(tolerance)) if tolerance is not None else F.col("tolerance")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(a, b, *kernel(_read(x), _read(y), t)) for a, b, x, y, t in zip(frame["a"], frame["b"], frame["rings_a"], frame["rings_b"], frame["tolerance"], strict=True)]
            yield pd.DataFrame(rows, columns=["a", "b", *columns])

    return pairs.select("a", "b", "rings_a", "rings_b", own.alias("tolerance")).mapInPandas(run, f"a {kinds['a']}, b {kinds['b']}, {added}")


def overlay(pairs: DataFrame, operation: str, tolerance: float | None) -> DataFrame:
    """(a, b, rings, area) of union, intersection or difference of every pair; a pair may have a tolerance of its own."""
    kernel = {"union": plane.union, "intersection": plane.intersection, "difference": plane.difference}[operation]

    def run(x: plane.Figure, y: plane.Figure, t: float) -> tuple:
        out = kernel(x, y, t)
        return _write(out), plane.figure_area(out)

    return _paired(pairs, {"rings": FIGURE, "area": "double"}, run, tolerance)


def containment(pairs: DataFrame, tolerance: float | None) -> DataFrame:
    """(a, b, state): how b stands to a."""
    return _paired(pairs, {"state": "string"}, lambda x, y, t: (plane.containment(x, y, t),), tolerance)


def containment_of_all(figs: DataFrame, tolerance: float, cell: float) -> DataFrame:
    """(a, b, state) of all pairs of figures, a before b, whose bounds meet: how b stands to a.

    Figures with the same rings have one shape; each pair of shapes is met and decided once, and figures take the answer of theirs.
    """
    held = figs.where("rings is not null")
    shapes = written(held.groupBy("rings").agg(F.min("figure").alias("figure")), "shapes")
    own = written(held.select("figure", "rings").join(shapes.select("rings", F.col("figure").alias("shape")), "rings").select("figure", "shape"), "shape-of")
    decided = written(containment(meeting(shapes, shapes, cell), tolerance), "decided")
    side = lambda f, k: own.select(F.col("figure").alias(f), F.col("shape").alias(k))
    named = decided.select(F.col("a").alias("sa"), F.col("b").alias("sb"), "state")
    return named.join(side("a", "sa"), "sa").join(side("b", "sb"), "sb").where("a < b").select("a", "b", "state")


def reach_outside(pairs: DataFrame, tolerance: float | None = None) -> DataFrame:
    """(a, b, depth): how far b reaches past the boundary of a, 0 where it does not."""

    def depth(x: plane.Figure, y: plane.Figure, t: float) -> tuple:
        outside = plane.difference(y, x, t)
        return (plane.overrun(outside, x) if outside else 0.0,)

    return _paired(pairs, {"depth": "double"}, depth, tolerance)


def points_outside(pairs: DataFrame) -> DataFrame:
    """(a, b, depth): how far the one point that ``rings_b`` holds lies outside of a, 0 where it does not."""

    def depth(x: plane.Figure, y: plane.Figure, _: float) -> tuple:
        return (max(0.0, -plane.clearance(y[0][0], x)),)

    return _paired(pairs, {"depth": "double"}, depth)


def buffered(figs: DataFrame, distance: float, tolerance: float) -> DataFrame:
    """(figure, rings, area) of every figure grown or shrunk by a distance."""
    kind = dict(figs.dtypes)["figure"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [plane.buffer(_read(r), distance, tolerance) for r in frame["rings"]]
            yield pd.DataFrame({"figure": frame["figure"], "rings": [_write(f) for f in made], "area": [plane.figure_area(f) for f in made]})

    return figs.where("rings is not null").select("figure", "rings").mapInPandas(run, f"figure {kind}, rings {FIGURE}, area double")


def derived_within(figs: DataFrame, tolerance: float, cell: float, on: list[str] | None = None) -> DataFrame:
    """(inner, outer) of all figures of one frame that lie inside another."""
    pairs = meeting(figs, figs, cell, on).where("a <> b")
    return containment(pairs, tolerance).where("state = 'inside'").select(F.col("b").alias("inner"), F.col("a").alias("outer"))


def siting(footprints: DataFrame, plots: DataFrame, tolerance: float, margin: float, terms: DataFrame | None = None) -> DataFrame:
    """Verdicts (footprint, plot, clearance, sigma, verdict) on footprints (figure, plot, rings, sigma) in plots (figure, rings).

    The clearance is the gap to the plot's boundary inside, less than nothing by the overrun of a part outside,
    or by the gap of what lies outside altogether. Against the margin and one standard deviation: fits,
    might-fit, does-not-fit, or unknown where the uncertainty is. With ``terms`` (figure, claim, kind, magnitude,
    unit, source, ord) the uncertainty is the budget of both sides together, in which a claim or a systematic
    source that both rest on counts once; without, the sigma of the footprint and, if plots have one, of the plot.
    """
    names = footprints.select(F.col("figure").alias("b"), F.col("plot").alias("a"), F.col("rings").alias("rings_b"), "sigma")
    held = plots.select(F.col("figure").alias("a"), F.col("rings").alias("rings_a"), (F.col("sigma") if "sigma" in plots.columns else F.lit(0.0)).alias("sigma_a"))
    pairs = names.join(held, "a").withColumn("sigma", F.hypot("sigma", "sigma_a"))

    def clear(x: plane.Figure, y: plane.Figure, _: float) -> tuple:
        outside = plane.difference(y, x, tolerance)
        if not outside or not plane.intersection(y, x, tolerance):
            return (plane.gap(y, x) * (-1 if outside else 1),)
        return (-plane.overrun(outside, x),)

    if terms is not None:
        both = pairs.select("a", "b", F.struct("a", "b").alias("answer"), F.explode(F.array("a", "b")).alias("figure"))
        rows = both.join(terms, "figure").select("answer", "claim", "kind", "magnitude", "unit", "source", "ord")
        bare = both.join(terms.select("figure"), "figure", "left_anti").select("answer")
        known = budget.combined(budget.terms(rows), bare).select(F.col("answer.a").alias("a"), F.col("answer.b").alias("b"), "sigma")
        pairs = pairs.drop("sigma").join(known, ["a", "b"], "left")
    found = _paired(pairs, {"clearance": "double"}, clear, tolerance).join(pairs.select("a", "b", "sigma"), ["a", "b"])
    spare = F.col("clearance") - F.lit(margin)
    verdict = F.when(F.col("sigma").isNull(), "unknown").when(spare > F.col("sigma"), "fits").when(spare < -F.col("sigma"), "does-not-fit").otherwise("might-fit")
    return found.select(F.col("b").alias("footprint"), F.col("a").alias("plot"), "clearance", "sigma", verdict.alias("verdict"))


def buildable(parcels: DataFrame, setbacks: DataFrame, tolerance: float) -> DataFrame:
    """(figure, rings, area, status) of parcels less the strips along their edges.

    ``setbacks`` has one row for each edge (figure, ax, ay, bx, by, setback); an edge without a setback (null)
    refuses the parcel, which is not the same as a setback of 0.
    """
    edges = setbacks.groupBy("figure").agg(F.collect_list(F.struct("ax", "ay", "bx", "by", "setback")).alias("edges"))
    kind = dict(parcels.dtypes)["figure"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, rings, own in zip(frame["figure"], frame["rings"], frame["edges"], strict=True):
                if own is None or any(pd.isna(e["setback"]) for e in own):
                    rows.append((name, None, None, "refused"))
                    continue
                figure, kept = _read(rings), [((e["ax"], e["ay"]), (e["bx"], e["by"]), e["setback"]) for e in own if e["setback"] > 0]
                if len(figure) == 1 and (left := plane.inset(figure[0], kept, tolerance)) is not None:
                    rows.append((name, _write(left), plane.figure_area(left), "region" if left else "consumed"))
                    continue
                strips = [r for e in own if e["setback"] > 0 for r in plane.strip((e["ax"], e["ay"]), (e["bx"], e["by"]), e["setback"], tolerance)]
                left = plane.arrange([figure, strips], lambda c: c[0] and not c[1], tolerance) if strips else figure
                rows.append((name, _write(left), plane.figure_area(left), "region" if left else "consumed"))
            yield pd.DataFrame(rows, columns=["figure", "rings", "area", "status"])

    return parcels.select("figure", "rings").join(edges, "figure", "left").mapInPandas(run, f"figure {kind}, rings {FIGURE}, area double, status string")


def plan(nodes: DataFrame, figs: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Every node (id, geometry, has_loop) of a storey with its rings, or the reason why it is not drawn, and its annotations."""
    joined = nodes.join(figs.select(F.col("figure").alias("id"), "rings", "area", "fault"), "id", "left")
    reason = F.when(F.col("rings").isNotNull(), None).when((F.col("geometry") == "point"), "no-position").when(~F.col("has_loop"), "no-boundary").otherwise("unreadable-boundary")
    out = joined.withColumn("undrawn", reason).drop("fault")
    if claims is None:
        return out
    notes = claims.where("live").groupBy(F.col("subject").alias("id")).agg(F.sort_array(F.collect_list(F.struct("predicate", "value"))).alias("annotations"))
    return out.join(notes, "id", "left")


def carried(figs: DataFrame, steps: DataFrame) -> DataFrame:
    """Figures (figure, frame, rings) with their corners carried up to the root frame."""
    corners = figs.select("figure", "frame", F.posexplode("rings").alias("r", "ring")).select("figure", "frame", "r", F.posexplode("ring").alias("k", "p"))
    moved = frames.at_root(corners.select("figure", "frame", "r", "k", "p.x", "p.y", F.lit(0.0).alias("z")), steps)
    rings = moved.groupBy("figure", "root", "r").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("c"))
    whole = rings.groupBy("figure", "root").agg(F.array_sort(F.collect_list(F.struct("r", F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("c")))).alias("rings"))
    return whole.select("figure", F.col("root").alias("frame"), F.transform("rings", lambda r: r["c"]).alias("rings"))
