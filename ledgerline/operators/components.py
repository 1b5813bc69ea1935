"""Connected components over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.scratch import dropped, written


def components(edges: DataFrame, rounds: int = 200, hint: str | None = None) -> DataFrame:
    """Rows (id, component) of all ends of ``edges`` (a, b), of any ordered type: the smallest that each reaches.

    Alternating large-star and small-star steps (Kiveris and others 2014), whose number grows with the logarithm of
    the size and not with the diameter; every step ends in a written table, and only its size and 128 bits of
    digests, which say whether it changed, reach the driver. ``hint`` says how the joins are made, "merge" that none is broadcast.
    """
    hinted = lambda df: df if hint is None else df.hint(hint)
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = None
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(hinted(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(hinted(least), "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, now = now, written(small.select("e.u", "e.v").where("u <> v").distinct(), "stars")
        if before is not None:
            dropped(last)
        after = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "v", "u"))).first())
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ends = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(ends)
