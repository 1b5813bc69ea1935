"""Error budgets: independent terms in quadrature, systematic terms linearly and once.

Terms are rows (answer, claim, kind, magnitude, unit, source) with kind independent or systematic. Systematic
terms of one source and unit are one term, of the largest magnitude. A claim without terms makes the budget
unknown; so do terms of two units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def terms(rows: DataFrame) -> DataFrame:
    """The merged terms of each answer: (answer, kind, name, unit, magnitude, contributors). Rows that stand twice change nothing."""
    shared = F.col("kind") == "systematic"
    name = F.when(shared, F.col("source")).otherwise(F.concat(F.col("claim").cast("string"), F.lit("#"), F.col("ord").cast("string")))
    return rows.groupBy("answer", "kind", name.alias("name"), "unit").agg(F.max(F.abs("magnitude")).alias("magnitude"), F.sort_array(F.collect_set("claim")).alias("contributors"))


def sigma(kind: Column, magnitude: Column) -> Column:
    """Aggregate: the combined standard uncertainty of merged terms."""
    independent = F.sum(F.when(kind == "independent", magnitude * magnitude).otherwise(0.0))
    linear = F.sum(F.when(kind == "systematic", magnitude).otherwise(0.0))
    return F.sqrt(independent + linear * linear)


def combined(merged: DataFrame, unknown: DataFrame | None = None) -> DataFrame:
    """One row per answer: sigma (null if unknown), unit, number of terms and status.

    ``unknown`` has the answers with a claim that states no accuracy.
    """
    out = merged.groupBy("answer").agg(
        sigma(F.col("kind"), F.col("magnitude")).alias("sigma"), F.min("unit").alias("unit"), F.max("unit").alias("other"), F.count("*").alias("n_terms")
    )
    if unknown is None:
        out = out.withColumn("lost", F.lit(False))
    else:
        out = out.join(unknown.select("answer").distinct().withColumn("lost", F.lit(True)), "answer", "full_outer").withColumn("lost", F.coalesce("lost", F.lit(False)))
    status = F.when(F.col("lost"), "unknown").when(F.col("unit") != F.col("other"), "mixed").otherwise("known")
    out = out.withColumn("status", status)
    known = F.col("status") == "known"
    return out.select("answer", F.when(known, F.col("sigma")).alias("sigma"), F.when(known, F.col("unit")).alias("unit"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"), "status")


def dominant(merged: DataFrame) -> DataFrame:
    """The term of each answer that contributes most, the first by name of equals."""
    return merged.groupBy("answer").agg(F.min(F.struct((-F.col("magnitude")).alias("m"), "name", "kind")).alias("t")).select("answer", F.col("t.name").alias("name"), F.col("t.kind").alias("kind"), (-F.col("t.m")).alias("magnitude"))


def widened(value: Column, factor: float) -> Column:
    return value * F.lit(float(factor))


def confidence(factor: Column) -> Column:
    """The customary label of a coverage factor."""
    return F.when(factor == 1.0, "68%").when(factor == 2.0, "95%").when(factor == 3.0, "99.7%").otherwise(F.concat(F.lit("k="), factor.cast("string")))


def banded(difference: Column, floor: Column, sigma: Column) -> dict[str, Column]:
    """A comparison within the larger of a floor and an uncertainty: applied band, widened, decisive, holds."""
    applied = F.greatest(floor, F.coalesce(sigma, F.lit(0.0)))
    wide = applied > floor
    return {"applied": applied, "widened": wide, "decisive": wide & (floor < difference) & (difference <= applied), "holds": difference <= applied}


def weighted(rows: DataFrame) -> DataFrame:
    """Budget of an interpolation: signed coefficients of a term are summed before their size counts.

    Rows are (answer, kind, name, unit, coefficient, magnitude); terms that two ends share cancel.
    """
    summed = rows.groupBy("answer", "kind", "name", "unit").agg(F.sum("coefficient").alias("coefficient"), F.max("magnitude").alias("m"))
    return combined(summed.select("answer", "kind", "name", "unit", F.abs(F.col("coefficient") * F.col("m")).alias("magnitude")))
