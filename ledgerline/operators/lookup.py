"""Registry and entity reads: listings, counts, nearest names, routing, nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_types(types: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every declared type with its number of instances."""
    return types.join(nodes.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("instances")), "name", "left").withColumn("instances", F.coalesce("instances", F.lit(0)))


def list_instances(nodes: DataFrame, type_: str | None = None, kind: str | None = None, frame: str | None = None, retired: bool = False) -> DataFrame:
    """Nodes that pass every filter given; retired ones are listed only on request."""
    for column, value in (("type", type_), ("kind", kind), ("frame", frame)):
        if value is not None:
            nodes = nodes.where(F.col(column) == value)
    return nodes if retired else nodes.where("retired is null")


def carrying(entities: DataFrame, claims: DataFrame, predicate: str | None = None) -> DataFrame:
    """Entities (id) with a live claim, under one predicate if given."""
    held = claims.where("live")
    if predicate is not None:
        held = held.where(F.col("predicate") == predicate)
    return entities.join(held.select(F.col("subject").alias("id")), "id", "left_semi")


def without(entities: DataFrame, claims: DataFrame, predicate: str) -> DataFrame:
    """Entities with no live claim under a predicate."""
    held = claims.where("live").where(F.col("predicate") == predicate)
    return entities.join(held.select(F.col("subject").alias("id")), "id", "left_anti")


def nested(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """Each entity with its claims as one array, ordered."""
    own = claims.groupBy(F.col("subject").alias("id")).agg(F.sort_array(F.collect_list(F.struct(*[c for c in claims.columns if c != "subject"]))).alias("claims"))
    return entities.join(own, "id", "left")


def nearest(names: DataFrame, wanted: str, column: str = "id", most: int = 1) -> DataFrame:
    """The names with the least edit distance to ``wanted``."""
    return names.select(column, F.levenshtein(F.col(column).cast("string"), F.lit(wanted)).alias("distance")).orderBy("distance", column).limit(most)


def routed(nodes: DataFrame, routes: DataFrame) -> DataFrame:
    """Each node (id, namespace, kind, type) with its file: exactly one rule must match, or ``file`` is null.

    A criterion that is null matches anything, so this is a join without an equality; the rules are a registry, and
    the planner sends the side that it knows to be small.
    """
    rule = routes.select(*[F.col(c).alias(f"r_{c}") for c in ("name", "namespace", "kind", "type", "file")])
    fits = F.lit(True)
    for c in ("namespace", "kind", "type"):
        fits = fits & (F.col(f"r_{c}").isNull() | (F.col(f"r_{c}") == F.col(c)))
    matched = nodes.join(rule, fits, "left").groupBy("id").agg(F.count("r_name").alias("rules"), F.min("r_file").alias("file"))
    return matched.select("id", "rules", F.when(F.col("rules") == 1, F.col("file")).alias("file"))


def summary(nodes: DataFrame) -> DataFrame:
    """Counts by kind, by type and of all, in one pass."""
    return nodes.groupingSets([["kind"], ["type"], []], "kind", "type").agg(F.count("*").alias("n"))


def undeclared(used: DataFrame, declared: DataFrame) -> DataFrame:
    """Names in use that no registry entry declares."""
    return used.select("name").distinct().join(declared.select("name"), "name", "left_anti")


def permits(kinds: Column, kind: Column) -> Column:
    return F.array_contains(kinds, kind)


# The kinds that may contain each kind.
PARENTS = {
    "Zone": [],
    "Site": [],
    "Building": ["Site"],
    "Storey": ["Building"],
    "Space": ["Storey", "Space"],
    "Element": ["Site", "Building", "Storey", "Space", "Element"],
    "Interface": ["Site", "Building", "Storey", "Space"],
}


def misplaced(nodes: DataFrame) -> DataFrame:
    """Nodes (id, kind, within) whose parent is of a kind that may not contain them."""
    parent = nodes.select(F.col("id").alias("within"), F.col("kind").alias("parent_kind"))
    allowed = F.lit(False)
    for kind, parents in PARENTS.items():
        if parents:
            allowed = allowed | ((F.col("kind") == kind) & F.col("parent_kind").isin(*parents))
    return nodes.where("within is not null").join(parent, "within").where(~allowed)
