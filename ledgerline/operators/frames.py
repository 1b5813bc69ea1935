"""Coordinate frames: a tree whose steps are measured transforms p_parent = t + s R convert(p)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.units import ratio
from ledgerline.operators import budget, graph
from ledgerline.scratch import written


def resolved(frames: DataFrame, claims: DataFrame) -> DataFrame:
    """Frames (frame, unit, parent, transform_claim) with the transform that their claim holds, and their parent's unit."""
    transforms = claims.select(F.col("id").alias("transform_claim"), F.col("value.transform").alias("transform"))
    parents = frames.select(F.col("frame").alias("parent"), F.col("unit").alias("parent_unit"))
    return frames.join(transforms, "transform_claim", "left").join(parents, "parent", "left")


def paths(frames: DataFrame) -> DataFrame:
    """(frame, ancestor, depth): every frame above each frame, and itself at depth 0."""
    steps = graph.closure(frames.where("parent is not null").select("parent", F.col("frame").alias("child")))
    own = frames.select(F.col("frame"), F.col("frame").alias("ancestor"), F.lit(0).alias("depth"))
    return own.unionAll(steps.select(F.col("node").alias("frame"), "ancestor", "depth"))


def meeting(all_paths: DataFrame, a: str, b: str) -> DataFrame:
    """The lowest frame that both chains pass through, and the steps up to it from each."""
    x = all_paths.where(F.col("frame") == a).select("ancestor", F.col("depth").alias("up"))
    y = all_paths.where(F.col("frame") == b).select("ancestor", F.col("depth").alias("down"))
    return x.join(y, "ancestor").orderBy(F.col("up") + F.col("down"), "ancestor").limit(1)


def to_parent(p: list[Column], transform: Column, unit: Column, parent_unit: Column) -> list[Column]:
    """A point one step up; the units are converted before the rotation."""
    k = ratio(unit, parent_unit)
    r, t, s = transform["rotation"], transform["translation"], transform["scale"]
    return [t[i] + s * (r[3 * i] * (p[0] * k) + r[3 * i + 1] * (p[1] * k) + r[3 * i + 2] * (p[2] * k)) for i in range(3)]


def _cofactors(m: list[Column]) -> list[Column]:
    """The transposed cofactors of a 3 x 3 matrix: its inverse times its determinant."""
    return [
        m[4] * m[8] - m[5] * m[7], m[2] * m[7] - m[1] * m[8], m[1] * m[5] - m[2] * m[4],
        m[5] * m[6] - m[3] * m[8], m[0] * m[8] - m[2] * m[6], m[2] * m[3] - m[0] * m[5],
        m[3] * m[7] - m[4] * m[6], m[1] * m[6] - m[0] * m[7], m[0] * m[4] - m[1] * m[3],
    ]


def from_parent(p: list[Column], transform: Column, unit: Column, parent_unit: Column) -> list[Column]:
    """A point one step down, by the inverse matrix; null where the transform can not be inverted."""
    k = ratio(parent_unit, unit)
    r, t, s = transform["rotation"], transform["translation"], transform["scale"]
    m = [r[i] for i in range(9)]
    d = [(p[i] - t[i]) / s for i in range(3)]
    cofactor = _cofactors(m)
    det = m[0] * cofactor[0] + m[1] * cofactor[3] + m[2] * cofactor[6]
    fine = (det != 0) & (s != 0)
    return [F.when(fine, (cofactor[3 * i] * d[0] + cofactor[3 * i + 1] * d[1] + cofactor[3 * i + 2] * d[2]) / det * k) for i in range(3)]


def _product(a: Column, b: Column) -> list[Column]:
    """The product of two 3 x 3 matrices, row by row."""
    return [sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)]


def _applied(m: Column, b: Column, p: list[Column]) -> list[Column]:
    return [m[3 * i] * p[0] + m[3 * i + 1] * p[1] + m[3 * i + 2] * p[2] + b[i] for i in range(3)]


def composed(frames_resolved: DataFrame) -> DataFrame:
    """(frame, root, m, b): the way of every frame to its root as p -> m p + b, whatever its depth; a cycle is an error.

    Ways double in each round. The tables are those of the registry; nothing is collected.
    """
    k, t = ratio(F.col("unit"), F.col("parent_unit")), F.col("transform")
    moves = F.col("parent").isNotNull()
    one = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])
    m = F.when(moves, F.transform(t["rotation"], lambda r: r * t["scale"] * k)).otherwise(one)
    b = F.when(moves, t["translation"]).otherwise(F.array(*[F.lit(0.0)] * 3))
    now = written(frames_resolved.select("frame", F.coalesce("parent", "frame").alias("root"), m.alias("m"), b.alias("b")).dropDuplicates(["frame"]), "frames")
    for _ in range(max(2, now.count().bit_length() + 1)):
        up = now.select(F.col("frame").alias("root"), F.col("root").alias("far"), F.col("m").alias("m2"), F.col("b").alias("b2"))
        further = F.col("far").isNotNull() & (F.col("far") != F.col("root"))
        step = now.join(up, "root", "left").select(
            "frame", F.when(further, F.col("far")).otherwise(F.col("root")).alias("root"),
            F.when(further, F.array(*_product(F.col("m2"), F.col("m")))).otherwise(F.col("m")).alias("m"),
            F.when(further, F.array(*_applied(F.col("m2"), F.col("b2"), [F.col("b")[i] for i in range(3)]))).otherwise(F.col("b")).alias("b"), further.alias("moved"),
        )
        step = written(step, "frames")
        now = step.drop("moved")
        if not step.where("moved").head(1):
            return now
    raise ValueError("frames have a cycle")


def at_root(points: DataFrame, frames_resolved: DataFrame) -> DataFrame:
    """Points (frame, x, y, z, ...) carried up to the root frame by one join with the composed ways."""
    joined = points.join(composed(frames_resolved).withColumnRenamed("frame", "_frame"), F.col("frame") == F.col("_frame"), "left")
    moved = _applied(F.col("m"), F.col("b"), [F.col(c) for c in "xyz"])
    known = F.col("m").isNotNull()
    out = joined.withColumns({c: F.when(known, p).otherwise(F.col(c)) for c, p in zip("xyz", moved, strict=True)})
    return out.select(*points.columns, F.coalesce("root", "frame").alias("root"))


def carried(points: DataFrame, frames_resolved: DataFrame) -> DataFrame:
    """Points (frame, target, x, y, z, ...) in their target frame: up to the root and down again; null where there is no way.

    Units are converted on the way, as each step's matrix holds them.
    """
    ways = written(composed(frames_resolved), "ways")
    up = ways.select(F.col("frame").alias("_from"), F.col("root").alias("_root"), F.col("m").alias("_m"), F.col("b").alias("_b"))
    down = ways.select(F.col("frame").alias("_to"), F.col("root").alias("_other"), F.col("m").alias("_m2"), F.col("b").alias("_b2"))
    joined = points.join(up, F.col("frame") == F.col("_from"), "left").join(down, F.col("target") == F.col("_to"), "left")
    p = _applied(F.col("_m"), F.col("_b"), [F.col(c) for c in "xyz"])
    d = [p[i] - F.col("_b2")[i] for i in range(3)]
    m = [F.col("_m2")[i] for i in range(9)]
    cofactor = _cofactors(m)
    det = m[0] * cofactor[0] + m[1] * cofactor[3] + m[2] * cofactor[6]
    fine = (F.col("_root") == F.col("_other")) & (det != 0)
    back = [F.when(fine, (cofactor[3 * i] * d[0] + cofactor[3 * i + 1] * d[1] + cofactor[3 * i + 2] * d[2]) / det) for i in range(3)]
    return joined.withColumns(dict(zip("xyz", back, strict=True))).select(*points.columns)


def route(all_paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, frame, way): the frames of ``pairs`` (a, b) whose own transform a route crosses, up or down.

    A route goes up to the lowest frame that both chains pass through and down from there, so what it crosses
    stands in one of the two chains and not in the other.
    """
    once = pairs.select("a", "b").distinct()
    up = once.join(all_paths.select(F.col("frame").alias("a"), F.col("ancestor").alias("frame")), "a")
    down = once.join(all_paths.select(F.col("frame").alias("b"), F.col("ancestor").alias("frame")), "b")
    keys = ["a", "b", "frame"]
    out = up.select(*keys).join(down, keys, "left_anti").withColumn("way", F.lit("up"))
    return out.unionAll(down.select(*keys).join(up, keys, "left_anti").withColumn("way", F.lit("down")))


def budgets(all_paths: DataFrame, pairs: DataFrame, transforms: DataFrame, terms: DataFrame) -> DataFrame:
    """Combined uncertainty (a, b, sigma, unit, n_terms, status) of the routes of ``pairs`` (a, b).

    ``transforms`` has (frame, claim) of all frames with a parent, ``terms`` the accuracy terms of claims (claim, kind,
    magnitude, unit, source, ord). A systematic term that two transforms share counts once, linearly. A crossed
    transform without terms makes the budget unknown; a route that crosses nothing has an uncertainty of 0.
    """
    crossed = route(all_paths, pairs).join(transforms, "frame").withColumn("answer", F.struct("a", "b"))
    own = terms.join(crossed.select("answer", "claim").distinct(), "claim").select("answer", "claim", "kind", "magnitude", "unit", "source", "ord")
    bare = crossed.join(terms.select("claim"), "claim", "left_anti").select("answer")
    found = budget.combined(budget.terms(own), bare)
    every = pairs.select("a", "b").distinct().withColumn("answer", F.struct("a", "b")).join(found, "answer", "left")
    still = F.col("status").isNull()
    return every.select("a", "b", F.when(still, F.lit(0.0)).otherwise(F.col("sigma")).alias("sigma"), "unit", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("status", F.lit("known")).alias("status"))
