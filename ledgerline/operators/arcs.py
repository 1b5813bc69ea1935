"""Arcs as expressions: an edge around a centre, through a point that says which way it bends."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = 2 * math.pi


def _turned(angle: Column) -> Column:
    """An angle from 0 up to a full turn."""
    return angle - F.floor(angle / TURN) * TURN


def sweep(x1: Column, y1: Column, x2: Column, y2: Column, cx: Column, cy: Column, tx: Column, ty: Column) -> Column:
    """The signed angle from start to end on the side of the through point; equal ends are a full turn."""
    a, b, t = F.atan2(y1 - cy, x1 - cx), F.atan2(y2 - cy, x2 - cx), F.atan2(ty - cy, tx - cx)
    ahead = _turned(b - a)
    forward = F.when(ahead == 0, F.lit(TURN)).otherwise(ahead)
    return F.when(_turned(t - a) <= forward, forward).otherwise(forward - TURN)


def measured(arcs: DataFrame) -> DataFrame:
    """Adds radius, sweep, length and the signed area between arc and chord to (x1, y1, x2, y2, cx, cy, tx, ty)."""
    c = [F.col(n) for n in ("x1", "y1", "x2", "y2", "cx", "cy", "tx", "ty")]
    rows = arcs.withColumns({"radius": F.hypot(c[0] - c[4], c[1] - c[5]), "sweep": sweep(*c)})
    return rows.withColumns({"length": F.col("radius") * F.abs("sweep"), "segment": F.col("radius") * F.col("radius") * (F.col("sweep") - F.sin("sweep")) / 2})


def tessellated(arcs: DataFrame, tolerance: float, most: int = 1 << 16) -> DataFrame:
    """``measured`` with ``chords``: corners of chords that stay within the tolerance of the arc, ends included."""
    rows = measured(arcs)
    half = F.acos(F.greatest(F.lit(-1.0), 1 - F.lit(tolerance) / F.col("radius")))
    n = F.when(F.col("radius") * 2 <= tolerance, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(F.abs("sweep") / (2 * half)))))
    rows = rows.withColumns({"n_chords": n.cast("int"), "from_angle": F.atan2(F.col("y1") - F.col("cy"), F.col("x1") - F.col("cx"))})

    def corner(k: Column) -> Column:
        angle = F.col("from_angle") + F.col("sweep") * k / F.col("n_chords")
        last = k == F.col("n_chords")
        x = F.when(k == 0, F.col("x1")).when(last, F.col("x2")).otherwise(F.col("cx") + F.col("radius") * F.cos(angle))
        y = F.when(k == 0, F.col("y1")).when(last, F.col("y2")).otherwise(F.col("cy") + F.col("radius") * F.sin(angle))
        return F.struct(x.alias("x"), y.alias("y"))

    return rows.withColumn("chords", F.transform(F.sequence(F.lit(0), F.col("n_chords")), corner)).drop("from_angle")


def unread(edges: DataFrame, claims: DataFrame, predicates: DataFrame, read: list[str]) -> DataFrame:
    """(edge, predicates): bounding edges with a live coordinate claim under a predicate that nobody read."""
    shaped = predicates.where("shape = 'coordinate'").select(F.col("name").alias("predicate"))
    held = claims.where("live").join(shaped, "predicate").where(~F.col("predicate").isin(*read) if read else F.lit(True))
    return edges.select("edge").distinct().join(held.select(F.col("subject").alias("edge"), "predicate"), "edge").groupBy("edge").agg(F.sort_array(F.collect_set("predicate")).alias("predicates"))
