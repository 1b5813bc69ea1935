"""Containment, membership, adjacency and references as relations.

Walks are frontier loops: every step is one join of the frontier with the edges and one
anti-join with what was seen, so a node is reached once, at its least depth, and cycles end. Steps are
written to the shared folder, and only whether a frontier is empty reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.components import components
from ledgerline.scratch import dropped, written


def walk(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """Rows (start, node, depth) of all nodes that ``edges`` (source, target) reach from ``starts`` (start), least depth first."""
    begin = starts.select("start").distinct()
    seen = [begin.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))]
    frontier, at = seen[0], 0
    while depth is None or at < depth:
        at += 1
        step = frontier.join(edges, frontier["node"] == edges["source"]).select("start", F.col("target").alias("node")).distinct()
        known = reduce(DataFrame.unionAll, seen).select("start", "node")
        frontier = written(step.join(known, ["start", "node"], "left_anti").withColumn("depth", F.lit(at)), "walk")
        if not frontier.head(1):
            break
        seen.append(frontier)
    return reduce(DataFrame.unionAll, seen).where("depth > 0")


def descendants(nodes: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """``nodes`` has (id, within)."""
    return walk(nodes.where("within is not null").select(F.col("within").alias("source"), F.col("id").alias("target")), starts, depth)


def ancestors(nodes: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """What holds each start, at any depth: chains double in each round, so rounds are the logarithm of the depth.

    Where a chain comes back to a node, which a containment may not, ``walk`` gives each node once.
    """
    edges = nodes.where("within is not null").select(F.col("id").alias("source"), F.col("within").alias("target"))
    if depth is not None:
        return walk(edges, starts, depth)
    begin = starts.select("start").distinct()
    parts = [begin.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))]
    jump, length = edges.select(F.col("source").alias("node"), F.col("target").alias("up")).distinct(), 1
    while True:
        held = reduce(DataFrame.unionAll, parts)
        more = written(held.join(jump, "node").select("start", F.col("up").alias("node"), (F.col("depth") + length).alias("depth")), "chains")
        if not more.head(1):
            break
        if more.join(held, ["start", "node"], "left_semi").head(1) or more.groupBy("start", "node").count().where("count > 1").head(1):
            return walk(edges, starts)
        parts.append(more)
        jump = written(jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("far")), "up").select("node", F.col("far").alias("up")), "jumps")
        length *= 2
    return reduce(DataFrame.unionAll, parts).where("depth > 0")


def closure(edges: DataFrame) -> DataFrame:
    """Rows (ancestor, node, depth) of a forest of (parent, child), at any depth; a cycle is an error.

    Paths double in each round: those of up to n steps, put behind jumps of exactly n, are those of up to 2 n.
    """
    jump = written(edges.where("parent is not null").select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct(), "closure")
    parts, length = [jump], 1
    while True:
        if parts[-1].where("node = ancestor").head(1):
            raise ValueError("the relation has a cycle")
        held = reduce(DataFrame.unionAll, parts).select(F.col("node").alias("middle"), "ancestor", "depth")
        first = jump.select("node", F.col("ancestor").alias("middle"))
        more = written(first.join(held, "middle").select("node", "ancestor", (F.col("depth") + length).alias("depth")).distinct(), "closure")
        if not more.head(1):
            break
        parts.append(more)
        length *= 2
        jump = more.where(F.col("depth") == length)
    return reduce(DataFrame.unionAll, parts).groupBy("ancestor", "node").agg(F.min("depth").alias("depth"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """The nodes (id) of (source, target) that can reach themselves: what is left when ends are peeled away."""
    now = edges.select("source", "target").distinct()
    while True:
        kept = now.join(now.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        kept = kept.join(now.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        kept = written(kept.select("source", "target"), "peeled")
        done = kept.count() == now.count()
        if len(now.inputFiles()) and "/ledgerline/peeled-" in now.inputFiles()[0]:
            dropped(now)
        now = kept
        if done:
            break
    reach = walk(now, now.select(F.col("source").alias("start")))
    direct = now.where("source = target").select(F.col("source").alias("id"))
    back = reach.join(now, (reach["node"] == now["source"]) & (now["target"] == reach["start"])).select(F.col("start").alias("id"))
    return direct.unionAll(back).distinct()


def rings(edges: DataFrame) -> DataFrame:
    """(id, names): one row for each ring of (source, target) in which a source has one target, by its least id, with all of its ids.

    Pointers double, as in ``chain``, so rounds are the logarithm of the depth; only what comes to no end is looked at closer.
    """
    ends = written(chain(edges.select(F.col("source").alias("id"), F.col("target").alias("superseded_by"))), "ends")
    stuck = ends.where("current is null").select(F.col("id").alias("source"))
    if not stuck.head(1):
        return stuck.select(F.col("source").alias("id"), F.lit("").alias("names"))
    held = edges.join(stuck, "source", "left_semi").select("source", "target")
    on = written(on_cycles(held), "rings")
    links = held.join(on.select(F.col("id").alias("source")), "source", "left_semi").join(on.select(F.col("id").alias("target")), "target", "left_semi")
    labels = components(links.select(F.col("source").alias("a"), F.col("target").alias("b")))
    named = on.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("ring"))
    return named.groupBy("ring").agg(F.array_join(F.sort_array(F.collect_set("id")), ", ").alias("names")).select(F.col("ring").alias("id"), "names")


def adjacent(sides: DataFrame) -> DataFrame:
    """Pairs (a, b, via) of nodes that share an edge, from rows (node, edge); ``via`` lists the shared edges.

    Pairs are never dealt out: each node gets its edges with the nodes of each, one list an edge, and the rows of a
    node, which come together, are turned into its pairs there, in slices of bounded size.
    """
    kinds = dict(sides.dtypes)
    one = sides.select("node", "edge").where("node is not null and edge is not null").distinct()
    lists = one.groupBy("edge").agg(F.sort_array(F.collect_list("node")).alias("others")).where("size(others) > 1")
    held = lists.select("edge", "others", F.explode("others").alias("a"))
    dealt = held.repartition("a").sortWithinPartitions("a", "edge").select("a", "edge", "others")
    schema = f"a {kinds['node']}, b {kinds['node']}, via array<{kinds['edge']}>"
    return dealt.mapInArrow(_paired, schema)


ROWS = 1_000_000  # pairs that are turned at a time; a node with more is held whole


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, via) of rows (a, edge, others) in the order of a and edge; the last node of a batch waits for the next."""
    waiting: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        waiting.append(batch)
        rows += len(batch.column(2).flatten())
        if rows < ROWS:
            continue
        table = pa.Table.from_batches(waiting).combine_chunks()
        last = int(pc.index(table["a"], table["a"][-1]).as_py())  # where the last node begins
        if last:
            yield from _turned(table.slice(0, last))
            table = table.slice(last)
        waiting = table.to_batches()
        rows = sum(len(b.column(2).flatten()) for b in waiting)
    if waiting:
        yield from _turned(pa.Table.from_batches(waiting))


def _turned(table: pa.Table) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    table = table.combine_chunks()
    one = lambda c: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    a, edge, others = (one(table[c]) for c in ("a", "edge", "others"))
    parent, b = others.value_parent_indices() if hasattr(others, "value_parent_indices") else pc.list_parent_indices(others), others.flatten()
    parent = np.asarray(parent)
    codes = lambda x: (lambda d: (d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary))(one(pc.dictionary_encode(x)))
    (ia, da), (ib, db) = codes(a), codes(b)
    key = ia[parent] * len(db) + ib
    order = np.argsort(key, kind="stable")  # edges stay in their order
    key = key[order]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    via = edge.take(pa.array(parent[order]))
    ends = np.append(begins, len(key)).astype(np.int32)
    firsts = pa.array(key[begins] // len(db)), pa.array(key[begins] % len(db))
    out = pa.RecordBatch.from_arrays([da.take(firsts[0]), db.take(firsts[1]), pa.ListArray.from_arrays(pa.array(ends), via)], ["a", "b", "via"])
    out = out.filter(pc.not_equal(out.column(0), out.column(1)))
    for k in range(0, len(out), 20_000):
        yield out.slice(k, 20_000)


def within_steps(pairs: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Breadth-first adjacency to ``depth``; the start itself is not a row.

    Before each step after the first, starts that have reached all of their component are done: where everything is
    next to everything, nothing is walked twice.
    """
    edges = written(pairs.select(F.col("a").alias("source"), F.col("b").alias("target")), "adjacency")
    begin = starts.select("start").distinct()
    first = walk(edges, begin, 1)
    if depth <= 1:
        return first.where("node <> start")
    first = written(first, "walk")
    label = written(components(edges.select(F.col("source").alias("a"), F.col("target").alias("b"))), "label")
    sizes = label.groupBy("component").agg(F.count("*").alias("members"))
    whole = label.join(sizes, "component").select(F.col("id").alias("start"), "members")
    seen, frontier = [first.where("node <> start")], first.where("node <> start")
    for at in range(2, depth + 1):
        known = reduce(DataFrame.unionAll, seen).select("start", "node")
        reached = known.groupBy("start").agg(F.count("*").alias("reached"))
        left = written(reached.join(whole, "start").where("reached + 1 < members").select("start"), "left")
        if not left.head(1):
            break
        step = frontier.join(left, "start", "left_semi").join(edges, F.col("node") == F.col("source")).select("start", F.col("target").alias("node")).where("node <> start").distinct()
        frontier = written(step.join(known, ["start", "node"], "left_anti").withColumn("depth", F.lit(at)), "walk")
        seen.append(frontier)
    return reduce(DataFrame.unionAll, seen)


def zones(memberships: DataFrame) -> DataFrame:
    """(node, zones) from (node, zone)."""
    return memberships.groupBy("node").agg(F.sort_array(F.collect_set("zone")).alias("zones"))


def members(memberships: DataFrame) -> DataFrame:
    return memberships.groupBy("zone").agg(F.sort_array(F.collect_set("node")).alias("members"))


def references(tables: dict[str, DataFrame], target: str) -> DataFrame:
    """Everything that names ``target``: ``tables`` has, for each relation, rows (source, target)."""
    parts = [t.where(F.col("target") == target).select("source", F.lit(name).alias("relation")) for name, t in tables.items()]
    return reduce(DataFrame.unionAll, parts)


def dangling(tables: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """References (source, target, relation) to ids that nothing declares."""
    parts = [t.select("source", "target", F.lit(name).alias("relation")) for name, t in tables.items()]
    return reduce(DataFrame.unionAll, parts).join(ids.select(F.col("id").alias("target")), "target", "left_anti")


def duplicates(tables: dict[str, DataFrame]) -> DataFrame:
    """Ids that are declared more than once in all families together: (id, n, families)."""
    parts = [t.select("id", F.lit(name).alias("family")) for name, t in tables.items()]
    return reduce(DataFrame.unionAll, parts).groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families")).where("n > 1")


def chain(claims: DataFrame) -> DataFrame:
    """Supersession: each claim (id, superseded_by) with the claim that is current for it, and the steps to it.

    Pointers jump over pointers, so rounds are the logarithm of the longest chain. A claim whose chain comes back
    to itself has no current claim.
    """
    now = claims.groupBy("id").agg(F.max("superseded_by").alias("by")).select("id", F.coalesce("by", "id").alias("at"), F.col("by").isNotNull().cast("long").alias("steps"))
    now = written(now, "pointers")
    goes_on = now.where("steps > 0").select(F.col("id").alias("at"), F.lit(True).alias("goes_on"))  # no end: a ring of 2, 4, 8 ... settles on its own members
    for _ in range(max(2, now.count().bit_length() + 1)):
        hop = now.select(F.col("id").alias("at"), F.col("at").alias("far"), F.col("steps").alias("more"))
        step = now.join(hop, "at", "left").select("id", F.coalesce("far", "at").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), (F.coalesce("far", "at") != F.col("at")).alias("moved"))
        moved = written(step, "pointers")
        now = moved.drop("moved")
        if not moved.where("moved").head(1):
            break
    ended = F.col("goes_on").isNull()
    return now.join(goes_on, "at", "left").select("id", F.when(ended, F.col("at")).alias("current"), F.when(ended, F.col("steps")).alias("steps"))


def replaced(claims: DataFrame) -> DataFrame:
    """(id, former): every claim that each claim has come to stand for, over all steps."""
    return chain(claims).where("steps > 0").select(F.col("current").alias("id"), F.col("id").alias("former"))
