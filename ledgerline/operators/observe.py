"""Observation logs: what is current, sessions, and rules across a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current(observations: DataFrame, retirements: DataFrame) -> DataFrame:
    """Observations (id, ...) that no retirement (supersedes) names."""
    return observations.join(retirements.select(F.col("supersedes").alias("id")).distinct(), "id", "left_anti")


def retired(observations: DataFrame, retirements: DataFrame) -> DataFrame:
    return observations.join(retirements.select(F.col("supersedes").alias("id")).distinct(), "id", "left_semi")


def sessions(observations: DataFrame) -> DataFrame:
    """Each session with its number of records and its first position in the log."""
    return observations.groupBy("session").agg(F.count("*").alias("n"), F.min("position").alias("first"))


def faults(records: DataFrame) -> DataFrame:
    """Rows (path, line, severity, message) of what is wrong across a log.

    ``records`` has (path, line, form, id, at, supersedes); the log's order is path, then line.
    """
    order = F.struct("path", "line")
    first = records.groupBy("id").agg(F.min(order).alias("first"), F.min_by("at", order).alias("first_at"))
    own = records.join(first, "id").withColumn("place", order)
    repeated = own.where(F.col("place") != F.col("first")).select("path", "line", F.lit("error").alias("severity"), F.concat(F.lit("identity written before: "), "id").alias("message"))
    retire = records.where("form = 'retire'").withColumn("place", order)
    itself = retire.where("id = supersedes").select("path", "line", F.lit("error").alias("severity"), F.lit("a retirement of itself").alias("message"))
    others = retire.where("id <> supersedes").join(first.select(F.col("id").alias("supersedes"), "first", "first_at"), "supersedes", "left")
    unknown = others.where("first is null").select("path", "line", F.lit("error").alias("severity"), F.concat(F.lit("no such record: "), "supersedes").alias("message"))
    later = others.where(F.col("first") > F.col("place")).select("path", "line", F.lit("error").alias("severity"), F.concat(F.lit("written later in the log: "), "supersedes").alias("message"))
    before = others.where((F.col("first") < F.col("place")) & (F.col("at") < F.col("first_at"))).select("path", "line", F.lit("warning").alias("severity"), F.concat(F.lit("retired before it was taken: "), "supersedes").alias("message"))
    again = retire.withColumn("n", F.row_number().over(Window.partitionBy("supersedes").orderBy("place"))).where("n > 1").select("path", "line", F.lit("error").alias("severity"), F.concat(F.lit("retired twice: "), "supersedes").alias("message"))
    out = repeated
    for part in (itself, unknown, later, before, again):
        out = out.unionAll(part)
    return out
