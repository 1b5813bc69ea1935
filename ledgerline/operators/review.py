"""What changed between two revisions that needs an eye, and whether logs were only appended to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds of finding and their rulings, unless a policy says otherwise.
DEFAULT_POLICY = {
    "boundary-moved-without-claim": "failure",
    "claim-deprecated-without-replacement": "failure",
    "id-disappeared-without-supersession": "failure",
}
FINGERPRINT = ["subject", "predicate", "source", "method", "day"]


def moved(base: DataFrame, head: DataFrame) -> DataFrame:
    """Claims of one fingerprint whose value differs: (subject, predicate, ..., before, after)."""
    b = base.select(*FINGERPRINT, F.col("value").alias("before"))
    h = head.select(*FINGERPRINT, F.col("value").alias("after"))
    return b.join(h, FINGERPRINT).where(~F.col("before").eqNullSafe(F.col("after")))


def changes(base: DataFrame, head: DataFrame, key: list[str], value: str) -> DataFrame:
    """Full comparison of two snapshots by key: added, removed or changed."""
    b = base.select(*key, F.col(value).alias("before"), F.lit(1).alias("in_base"))
    h = head.select(*key, F.col(value).alias("after"), F.lit(1).alias("in_head"))
    state = F.when(F.col("in_base").isNull(), "added").when(F.col("in_head").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return b.join(h, key, "full_outer").withColumn("state", state).where("state is not null").select(*key, "state", "before", "after")


def rerouted(base_corners: DataFrame, head_corners: DataFrame, base_claims: DataFrame, head_claims: DataFrame) -> DataFrame:
    """Boundaries (node, corners) whose corner list changed while no corner of the new one has a claim that base lacks."""
    changed = base_corners.select("node", F.col("corners").alias("old")).join(head_corners, "node").where(F.col("old") != F.col("corners"))
    new = head_claims.join(base_claims, [*FINGERPRINT, "value"], "left_anti").select(F.col("subject").alias("corner")).distinct()
    evidenced = changed.select("node", F.explode("corners").alias("corner")).join(new, "corner", "left_semi").select("node").distinct()
    return changed.join(evidenced, "node", "left_anti").select(F.col("node").alias("subject"))


def deprecated(base: DataFrame, head: DataFrame) -> DataFrame:
    """Claims that head deprecates and base did not, without a live replacement that is held."""
    fresh = head.where("not live").join(base.where("live").select("id"), "id", "left_semi")
    held = head.where("live").select(F.col("id").alias("superseded_by"))
    return fresh.join(held, "superseded_by", "left_anti").select("subject", "id")


def disappeared(base_ids: DataFrame, head_ids: DataFrame, head_references: DataFrame | None = None) -> DataFrame:
    """Ids that base has and head lacks, with what still refers to them."""
    gone = base_ids.select("id").join(head_ids.select("id"), "id", "left_anti")
    if head_references is None:
        return gone
    refs = head_references.groupBy(F.col("target").alias("id")).agg(F.sort_array(F.collect_set("source")).alias("dangling"))
    return gone.join(refs, "id", "left")


def findings(parts: dict[str, DataFrame], policy: dict[str, str] | None = None) -> DataFrame:
    """All findings (kind, subject, ruling) that the policy does not ignore."""
    rulings = DEFAULT_POLICY | (policy or {})
    out = None
    for kind, rows in parts.items():
        if rulings[kind] != "ignored":
            named = rows.select(F.lit(kind).alias("kind"), F.col("subject").cast("string").alias("subject"), F.lit(rulings[kind]).alias("ruling"))
            out = named if out is None else out.unionAll(named)
    if out is None:
        raise ValueError("the policy ignores every kind")
    return out


def appended_only(base_lines: DataFrame, head_lines: DataFrame) -> DataFrame:
    """Lines (path, line, text) of the older revision that the newer one has not, unchanged, at their place."""
    h = head_lines.select("path", "line", F.col("text").alias("after"))
    joined = base_lines.join(h, ["path", "line"], "left")
    return joined.where(~F.col("text").eqNullSafe(F.col("after"))).select("path", "line", F.when(F.col("after").isNull(), "removed").otherwise("edited").alias("fault"))
