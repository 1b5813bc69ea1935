"""Which claim is current for each subject and predicate, and why (budgets are one standard deviation).

A claim is a row (subject, predicate, sigma, unit, day, live); ``sigma`` is null where its accuracy is unknown,
which is not zero. The rules, in order: a claim without a known sigma can not win while another has one; of
each unit the smallest sigma survives; survivors of two units are ambiguous, and dates do not decide between
them; of the survivors the most recent day wins; what is left of several is ambiguous. Comparisons are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["subject", "predicate"]


def live(claims: DataFrame) -> DataFrame:
    return claims.where("live")


def marked(claims: DataFrame) -> DataFrame:
    """Live claims with ``n_live``, ``n_rankable``, and whether each is a survivor (``best``) and a candidate.

    All windows share one partitioning, so the rows are exchanged once.
    """
    by_key, by_unit = Window.partitionBy(*KEY), Window.partitionBy(*KEY, "unit")
    rows = live(claims).withColumns({"n_live": F.count("*").over(by_key), "n_rankable": F.count("sigma").over(by_key)})
    rows = rows.withColumn("best", F.coalesce(F.col("sigma") == F.min("sigma").over(by_unit), F.lit(False)))
    rows = rows.withColumns({
        "n_best": F.sum(F.col("best").cast("int")).over(by_key),
        "low": F.min(F.when(F.col("best"), F.col("unit"))).over(by_key),
        "high": F.max(F.when(F.col("best"), F.col("unit"))).over(by_key),
        "latest": F.max(F.when(F.col("best"), F.col("day"))).over(by_key),
    })
    mixed = F.col("low") != F.col("high")
    candidate = F.when(F.col("n_rankable") == 0, True).when(mixed, F.col("best")).otherwise(F.col("best") & (F.col("day") == F.col("latest")))
    rows = rows.withColumns({"mixed": F.coalesce(mixed, F.lit(False)), "candidate": F.coalesce(candidate, F.lit(False))})
    rows = rows.withColumn("n_candidates", F.sum(F.col("candidate").cast("int")).over(by_key))
    return rows.withColumn("reason", _reason())


def _reason() -> Column:
    unranked = F.when(F.col("n_live") == 1, "unranked").otherwise("ambiguous")
    decided = F.when(F.col("n_live") == 1, "only").when(F.col("n_best") > 1, "recency").otherwise("accuracy")
    return F.when(F.col("n_rankable") == 0, unranked).when(F.col("mixed") | (F.col("n_candidates") > 1), "ambiguous").otherwise(decided)


def resolve(claims: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """One row per (subject, predicate): reason, counts, the winner's sigma, unit and day, and the answer.

    The answer also has the single claim whose accuracy is unknown, which wins nothing. Keys of ``asked``
    without live claims are unclaimed. Claims that repeat are added up before they are exchanged.
    """
    summed = live(claims).groupBy(*KEY, "unit", "sigma", "day").agg(F.count("*").alias("n"))
    by_unit = summed.groupBy(*KEY, "unit", "sigma").agg(F.sum("n").alias("n"), F.max("day").alias("day"), F.max(F.struct("day", "n")).alias("last"))
    best = Window.partitionBy(*KEY, "unit").orderBy(F.col("sigma").asc_nulls_last())
    ranked = by_unit.withColumn("first", (F.row_number().over(best) == 1) & F.col("sigma").isNotNull())
    top = F.col("first")
    totals = ranked.groupBy(*KEY).agg(
        F.sum("n").alias("n_live"),
        F.sum(F.when(F.col("sigma").isNotNull(), F.col("n")).otherwise(0)).alias("n_rankable"),
        F.sum(F.when(top, F.col("n")).otherwise(0)).alias("n_best"),
        F.sum(top.cast("int")).alias("n_units"),
        F.max(F.when(top, F.struct(F.col("last.day").alias("day"), F.col("last.n").alias("n"), "sigma", "unit"))).alias("w"),
        F.max("day").alias("any_day"),
    )
    mixed = F.col("n_units") > 1
    n_candidates = F.when(F.col("n_rankable") == 0, F.col("n_live")).when(mixed, F.col("n_best")).otherwise(F.col("w.n"))
    out = totals.withColumns({"mixed": mixed, "n_candidates": n_candidates}).withColumn("reason", _reason())
    decided = F.col("reason").isin("only", "recency", "accuracy")
    out = out.select(
        *KEY, "reason", "n_live", "n_rankable", "n_candidates",
        F.when(decided, F.col("w.sigma")).alias("sigma"),
        F.when(decided, F.col("w.unit")).alias("unit"),
        F.when(decided, F.col("w.day")).when(F.col("reason") == "unranked", F.col("any_day")).alias("day"),
    )
    if asked is None:
        return out
    found = asked.select(*KEY).distinct().join(out, KEY, "left")
    return found.withColumns({"reason": F.coalesce("reason", F.lit("unclaimed"))} | {n: F.coalesce(n, F.lit(0)) for n in ("n_live", "n_rankable", "n_candidates")})


def strict(resolved: DataFrame, predicates: DataFrame) -> DataFrame:
    """Adds ``status``: ambiguity of a strict predicate is an error, of any other a report."""
    joined = resolved.join(predicates.select(F.col("name").alias("predicate"), "strict"), "predicate", "left")
    status = F.when(F.col("reason") == "unclaimed", 1).when((F.col("reason") == "ambiguous") & F.coalesce("strict", F.lit(False)), 5).when(F.col("reason") == "ambiguous", 4).otherwise(0)
    return joined.withColumn("status", status).drop("strict")


def conflicts(claims: DataFrame, ambiguous: bool | None = None) -> DataFrame:
    """The register: every key with two live claims or more, whether or not they agree, and its resolution."""
    out = resolve(claims).where("n_live >= 2")
    if ambiguous is not None:
        out = out.where((F.col("reason") == "ambiguous") == F.lit(ambiguous))
    return out


def audit(claims: DataFrame) -> DataFrame:
    """Every claim with its status: current, tied, unranked, outranked or retracted."""
    rows = marked(claims)
    status = (
        F.when(F.col("reason") == "unranked", "unranked")
        .when(F.col("candidate") & (F.col("n_candidates") == 1), "current")
        .when(F.col("candidate"), "tied")
        .when(F.col("sigma").isNull(), "unranked")
        .otherwise("outranked")
    )
    columns = claims.columns
    return rows.withColumn("status", status).select(*columns, "status").unionByName(claims.where("not live").withColumn("status", F.lit("retracted")))
