"""The operators applied to the driver's tables, each with the DuckDB SQL that states the same.

``lineitem`` stands for claims (part, return flag), ``part`` for a registry, region to order for containment,
``events`` for observations. Sums of doubles are rounded on both sides, since they are added in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.catalogue import register
from ledgerline.functions import units
from ledgerline.operators import arcs, budget, frames, geometry, graph, lookup, regions, resolution, review, rules, surface
from ledgerline.scratch import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("subject"), F.col("l_returnflag").alias("predicate"), F.expr("nullif(l_tax, 0)").alias("sigma"),
        F.lit("m").alias("unit"), F.col("l_shipdate").alias("day"), (F.col("l_linestatus") == "O").alias("live"),
    )


_CLAIMS = "c AS (SELECT l_partkey AS subject, l_returnflag AS predicate, nullif(l_tax, 0) AS sigma, l_shipdate AS day FROM lineitem WHERE l_linestatus = 'O')"
_RESOLVED = f"""{_CLAIMS},
k AS (SELECT subject, predicate, count(*) AS n_live, count(sigma) AS n_rankable, min(sigma) AS m, max(day) AS any_day FROM c GROUP BY ALL),
b AS (SELECT subject, predicate, count(*) AS n_best, max(day) AS latest FROM c JOIN k USING (subject, predicate) WHERE sigma = m GROUP BY ALL),
l AS (SELECT subject, predicate, count(*) AS n_last FROM c JOIN k USING (subject, predicate) JOIN b USING (subject, predicate) WHERE sigma = m AND day = latest GROUP BY ALL),
r AS (SELECT subject, predicate, n_live, n_rankable, CASE WHEN n_rankable = 0 THEN n_live ELSE n_last END AS n_candidates, m, latest, any_day,
  CASE WHEN n_rankable = 0 AND n_live = 1 THEN 'unranked' WHEN n_rankable = 0 THEN 'ambiguous' WHEN n_last > 1 THEN 'ambiguous'
       WHEN n_live = 1 THEN 'only' WHEN n_best > 1 THEN 'recency' ELSE 'accuracy' END AS reason
  FROM k LEFT JOIN b USING (subject, predicate) LEFT JOIN l USING (subject, predicate)),
o AS (SELECT subject, predicate, reason, n_live, n_rankable, n_candidates, CASE WHEN reason IN ('only', 'recency', 'accuracy') THEN m END AS sigma,
  CASE WHEN reason IN ('only', 'recency', 'accuracy') THEN latest WHEN reason = 'unranked' THEN any_day END AS day FROM r)"""


@register("resolve_claims", f"WITH {_RESOLVED} SELECT * FROM o")
def resolve_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.resolve(_claims(spark, sf_dir)).select("subject", "predicate", "reason", "n_live", "n_rankable", F.col("n_candidates").cast("long"), "sigma", "day")


@register("resolve_asked", f"""WITH {_RESOLVED}, a AS (SELECT p_partkey AS subject, f AS predicate FROM part, (VALUES ('A'), ('N'), ('R')) t(f))
SELECT subject, predicate, coalesce(reason, 'unclaimed') AS reason, coalesce(n_live, 0) AS n_live FROM a LEFT JOIN o USING (subject, predicate)""")
def resolve_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("subject"), F.explode(F.array(*map(F.lit, "ANR"))).alias("predicate"))
    return resolution.resolve(_claims(spark, sf_dir), asked).select("subject", "predicate", "reason", F.col("n_live").cast("long"))


@register("resolve_status", f"WITH {_RESOLVED} SELECT reason, CASE WHEN reason = 'ambiguous' AND predicate = 'N' THEN 5 WHEN reason = 'ambiguous' THEN 4 ELSE 0 END AS status, count(*) AS n FROM o GROUP BY ALL")
def resolve_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicates = spark.createDataFrame([("N", True), ("R", False)], "name string, strict boolean")
    return resolution.strict(resolution.resolve(_claims(spark, sf_dir)), predicates).groupBy("reason", "status").agg(F.count("*").alias("n"))


@register("conflict_register", f"WITH {_RESOLVED} SELECT subject, predicate, reason, n_live FROM o WHERE n_live >= 2")
def conflict_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.conflicts(_claims(spark, sf_dir)).select("subject", "predicate", "reason", "n_live")


@register("conflicts_ambiguous", f"WITH {_RESOLVED} SELECT subject, predicate, n_candidates FROM o WHERE n_live >= 2 AND reason = 'ambiguous'")
def conflicts_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.conflicts(_claims(spark, sf_dir), ambiguous=True).select("subject", "predicate", F.col("n_candidates").cast("long"))


@register("claim_audit", f"""WITH {_RESOLVED} SELECT subject, predicate, c.sigma, c.day, CASE WHEN reason = 'unranked' THEN 'unranked'
  WHEN n_rankable = 0 THEN 'tied' WHEN c.sigma IS NULL THEN 'unranked' WHEN c.sigma = m AND c.day = latest AND n_candidates = 1 THEN 'current'
  WHEN c.sigma = m AND c.day = latest THEN 'tied' ELSE 'outranked' END AS status FROM c JOIN r USING (subject, predicate)
UNION ALL SELECT l_partkey, l_returnflag, nullif(l_tax, 0), l_shipdate, 'retracted' FROM lineitem WHERE l_linestatus <> 'O'""")
def claim_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.audit(_claims(spark, sf_dir)).select("subject", "predicate", "sigma", "day", "status")


@register("list_types", "SELECT p_type AS name, count(l_partkey) AS instances FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL")
def list_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    nodes = _table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_type").alias("type"))
    return lookup.list_types(part.select(F.col("p_type").alias("name")).distinct(), nodes)


@register("summary_rollup", "SELECT p_brand AS kind, p_type AS type, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())")
def summary_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.summary(_table(spark, sf_dir, "part").select(F.col("p_brand").alias("kind"), F.col("p_type").alias("type")))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    retired = F.when(F.col("p_size") > 45, F.lit("2026-01-01"))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"), F.col("p_type").alias("type"), F.substring("p_name", 1, 1).alias("frame"), retired.alias("retired"), "p_size")


@register("list_instances", "SELECT p_partkey AS id, p_type AS type FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND p_size <= 45")
def list_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return lookup.list_instances(parts, kind=parts.agg(F.min("kind")).first()[0]).select("id", "type")


@register("list_geometry", "SELECT p_partkey AS id FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'N' AND l_linestatus = 'O')")
def list_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.carrying(_parts(spark, sf_dir).select("id"), _claims(spark, sf_dir), "N")


@register("required_claim", "SELECT p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_linestatus = 'O')")
def required_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.without(_parts(spark, sf_dir).select("id"), _claims(spark, sf_dir), "R")


@register("get_nested", "SELECT o_orderkey AS id, count(l_orderkey) AS n_claims, string_agg(l_linenumber::VARCHAR || '/' || l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS claims FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def get_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    claims = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("subject"), "l_linenumber", "l_partkey")
    texts = F.transform("claims", lambda c: F.concat_ws("/", c["l_linenumber"].cast("string"), c["l_partkey"].cast("string")))
    return lookup.nested(entities, claims).select("id", F.coalesce(F.size("claims"), F.lit(0)).cast("long").alias("n_claims"), F.when(F.col("claims").isNotNull(), F.array_join(texts, ",")).alias("claims"))


@register("nearest_name", "SELECT p_name, levenshtein(p_name, 'part 12x')::INT AS distance FROM (SELECT DISTINCT p_name FROM part) ORDER BY 2, 1 LIMIT 5")
def nearest_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.nearest(_table(spark, sf_dir, "part").select("p_name").distinct(), "part 12x", "p_name", 5)


@register("undeclared_names", "SELECT DISTINCT event_type AS name FROM events WHERE event_type NOT IN ('click', 'view')")
def undeclared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = spark.createDataFrame([("click",), ("view",)], "name string")
    return lookup.undeclared(_table(spark, sf_dir, "events").select(F.col("event_type").alias("name")), declared)


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment of regions, nations, customers and orders, with prefixed ids."""

    def ids(name: str, key: str, kind: str, parent: str | None = None, up: str = "") -> DataFrame:
        within = F.concat(F.lit(up), F.col(parent).cast("string")) if parent else F.lit(None).cast("string")
        return _table(spark, sf_dir, name).select(F.concat(F.lit(kind + ":"), F.col(key).cast("string")).alias("id"), within.alias("within"))

    parts = ids("nation", "n_nationkey", "n", "n_regionkey", "r:"), ids("customer", "c_custkey", "c", "c_nationkey", "n:"), ids("orders", "o_orderkey", "o", "o_custkey", "c:")
    out = ids("region", "r_regionkey", "r")
    for p in parts:
        out = out.unionAll(p)
    return out


_DOWN = """d AS (SELECT 'n:' || n_nationkey AS node, 1 AS depth FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'c:' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1
UNION ALL SELECT 'o:' || o_orderkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1)"""


@register("descendants", f"WITH {_DOWN} SELECT node, depth FROM d")
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([("r:1",)], "start string")
    return graph.descendants(_nodes(spark, sf_dir), start).select("node", "depth")


@register("traverse_filtered", f"WITH {_DOWN} SELECT node, depth FROM d WHERE node LIKE 'c:%' AND depth <= 2")
def traverse_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([("r:1",)], "start string")
    return graph.descendants(_nodes(spark, sf_dir), start, 2).where("node LIKE 'c:%'").select("node", "depth")


@register("ancestors", """SELECT 'o:' || o_orderkey AS start, 'c:' || o_custkey AS node, 1 AS depth FROM orders
UNION ALL SELECT 'o:' || o_orderkey, 'n:' || c_nationkey, 2 FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'o:' || o_orderkey, 'r:' || n_regionkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    return graph.ancestors(nodes, nodes.where("id LIKE 'o:%'").select(F.col("id").alias("start")))


@register("containment_closure", """WITH up AS (SELECT 'r:' || n_regionkey AS ancestor, 'n:' || n_nationkey AS node, 1 AS depth FROM nation
UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 1 FROM customer
UNION ALL SELECT 'r:' || n_regionkey, 'c:' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT * FROM up UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey, 1 FROM orders
UNION ALL SELECT ancestor, 'o:' || o_orderkey, depth + 1 FROM orders JOIN up ON node = 'c:' || o_custkey""")
def containment_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir).where("within IS NOT NULL")
    return graph.closure(nodes.select(F.col("within").alias("parent"), F.col("id").alias("child")))


def _deep(spark: SparkSession, sf_dir: str, length: int) -> DataFrame:
    """Orders as containments that are ``length`` deep: each is within the one before it, but for the first of each run."""
    key = F.col("o_orderkey")
    orders = _table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy(key)))
    up = F.lag(key).over(Window.partitionBy("o_custkey").orderBy(key))
    return orders.select(key.alias("child"), F.when(F.col("n") % length != 1, up).alias("parent"), "n", "o_custkey")


_DEEP = "g AS (SELECT o_orderkey AS id, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)"


@register("closure_deep", f"WITH {_DEEP} SELECT a.id AS ancestor, b.id AS node, (b.n - a.n)::INT AS depth FROM g a JOIN g b ON a.c = b.c AND a.n < b.n AND (a.n - 1) // 40 = (b.n - 1) // 40")
def closure_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containments up to 40 deep, none of which may be lost."""
    return graph.closure(_deep(spark, sf_dir, 40))


@register("ancestors_deep", f"WITH {_DEEP} SELECT b.id AS start, a.id AS node, (b.n - a.n)::INT AS depth FROM g a JOIN g b ON a.c = b.c AND a.n < b.n AND (a.n - 1) // 40 = (b.n - 1) // 40 WHERE b.id % 3 = 0")
def ancestors_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _deep(spark, sf_dir, 40).select(F.col("child").alias("id"), F.col("parent").alias("within"))
    return graph.ancestors(nodes, nodes.where("id % 3 = 0").select(F.col("id").alias("start")))


@register("supersession_deep", f"WITH {_DEEP}, m AS (SELECT c, max(n) AS n FROM g GROUP BY c) SELECT g.id, l.id AS current, l.n - g.n AS steps FROM g JOIN m USING (c) JOIN g l ON l.c = g.c AND l.n = m.n")
def supersession_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order superseded by the customer's next, so chains are as long as a customer's orders."""
    later = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return graph.chain(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), later.alias("superseded_by")))


_SIDES = "s AS (SELECT DISTINCT l_suppkey AS node, l_partkey AS edge FROM lineitem), p AS (SELECT x.node AS a, y.node AS b, x.edge FROM s x JOIN s y ON x.edge = y.edge AND x.node <> y.node)"


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("edge"))


@register("adjacent", f"WITH {_SIDES} SELECT a, b, string_agg(edge::VARCHAR, ',' ORDER BY edge) AS via FROM p GROUP BY ALL")
def adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacent(_sides(spark, sf_dir)).select("a", "b", F.array_join(F.col("via").cast("array<string>"), ",").alias("via"))


@register("adjacent_bfs", f"""WITH {_SIDES}, q AS (SELECT DISTINCT a, b FROM p), two AS (SELECT DISTINCT x.a, y.b FROM q x JOIN q y ON x.b = y.a)
SELECT a AS start, b AS node, 1 AS depth FROM q UNION ALL SELECT a, b, 2 FROM two WHERE a <> b AND (a, b) NOT IN (SELECT (a, b) FROM q)""")
def adjacent_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = graph.adjacent(_sides(spark, sf_dir))
    return graph.within_steps(pairs, pairs.select(F.col("a").alias("start")), 2)


def _memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("node"), F.col("l_partkey").alias("zone"))


@register("zones", "SELECT o_custkey AS node, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS zones FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.zones(_memberships(spark, sf_dir)).select("node", F.array_join(F.array_sort(F.col("zones").cast("array<string>")), ",").alias("zones"))


@register("members", "SELECT l_partkey AS zone, count(DISTINCT o_custkey) AS n, min(o_custkey) AS first FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.members(_memberships(spark, sf_dir)).select("zone", F.size("members").cast("long").alias("n"), F.col("members")[0].alias("first"))


@register("references", "SELECT 'c:' || c_custkey AS source, 'within' AS relation FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 's:' || s_suppkey, 'member-of' FROM supplier WHERE s_nationkey = 3")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("source"), F.concat(F.lit("n:"), F.col("s_nationkey").cast("string")).alias("target"))
    within = _nodes(spark, sf_dir).select(F.col("id").alias("source"), F.col("within").alias("target"))
    return graph.references({"within": within, "member-of": suppliers}, "n:3")


@register("dangling_refs", "SELECT o_orderkey AS target, o_custkey AS source, 'lines' AS relation FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target"))
    return graph.dangling({"lines": refs}, _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")))


@register("id_uniqueness", """SELECT id, count(*) AS n, string_agg(DISTINCT f, ',' ORDER BY f) AS families FROM (
SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS id, 'line' AS f FROM lineitem UNION ALL SELECT o_orderkey::VARCHAR || '-1', 'order' FROM orders) GROUP BY id HAVING count(*) > 1""")
def id_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"))
    orders = _table(spark, sf_dir, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit("-1")).alias("id"))
    return graph.duplicates({"line": lines, "order": orders})


_RULES = [("a", None, "AUTOMOBILE", None, "auto.dfc"), ("b", "n1", "BUILDING", None, "build.dfc"), ("c", None, "BUILDING", "pos", "pos.dfc"), ("d", None, "FURNITURE", None, "furn.dfc")]


@register("routing", """SELECT c_custkey AS id, (c_mktsegment = 'AUTOMOBILE')::BIGINT + (c_mktsegment = 'BUILDING' AND c_nationkey = 1)::BIGINT + (c_mktsegment = 'BUILDING' AND c_acctbal > 0)::BIGINT + (c_mktsegment = 'FURNITURE')::BIGINT AS rules,
CASE WHEN rules = 1 THEN CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'auto.dfc' WHEN c_mktsegment = 'FURNITURE' THEN 'furn.dfc' WHEN c_nationkey = 1 THEN 'build.dfc' ELSE 'pos.dfc' END END AS file FROM customer""")
def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("namespace"), F.col("c_mktsegment").alias("kind"), F.when(F.col("c_acctbal") > 0, "pos").otherwise("neg").alias("type"))
    return lookup.routed(nodes, spark.createDataFrame(_RULES, "name string, namespace string, kind string, type string, file string"))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    claim = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_tax")])
    independent = lines.select(F.col("l_orderkey").alias("answer"), claim.alias("claim"), F.lit("independent").alias("kind"), F.col("l_tax").alias("magnitude"), F.lit("m").alias("unit"), F.lit(None).cast("string").alias("source"), F.lit(0).alias("ord"))
    systematic = lines.select(F.col("l_orderkey").alias("answer"), claim.alias("claim"), F.lit("systematic").alias("kind"), F.col("l_discount").alias("magnitude"), F.lit("m").alias("unit"), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("source"), F.lit(1).alias("ord"))
    return independent.unionAll(systematic)


_TERMS = """i AS (SELECT l_orderkey AS answer, 'independent' AS kind, l_linenumber::VARCHAR || '-' || l_partkey::VARCHAR || '-' || l_suppkey::VARCHAR || '-' || l_tax::VARCHAR || '#0' AS name, max(l_tax) AS magnitude FROM lineitem GROUP BY ALL),
y AS (SELECT l_orderkey AS answer, 'systematic' AS kind, 's:' || l_suppkey::VARCHAR AS name, max(l_discount) AS magnitude FROM lineitem GROUP BY ALL), t AS (SELECT * FROM i UNION ALL SELECT * FROM y)"""


@register("budget_terms", f"WITH {_TERMS} SELECT answer, kind, name, magnitude FROM t")
def budget_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.terms(_terms(spark, sf_dir)).select("answer", "kind", "name", "magnitude")


@register("budget_combined", f"""WITH {_TERMS}, u AS (SELECT DISTINCT l_orderkey AS answer FROM lineitem WHERE l_quantity = 1)
SELECT answer, CASE WHEN u.answer IS NULL THEN round(sqrt(sum(CASE kind WHEN 'independent' THEN magnitude * magnitude ELSE 0 END) + pow(sum(CASE kind WHEN 'systematic' THEN magnitude ELSE 0 END), 2)), 6) END AS sigma,
count(*) AS n_terms, CASE WHEN u.answer IS NULL THEN 'known' ELSE 'unknown' END AS status FROM t LEFT JOIN u USING (answer) GROUP BY answer, u.answer""")
def budget_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    unknown = _table(spark, sf_dir, "lineitem").where("l_quantity = 1").select(F.col("l_orderkey").alias("answer"))
    return budget.combined(budget.terms(_terms(spark, sf_dir)), unknown).select("answer", F.round("sigma", 6).alias("sigma"), F.col("n_terms").cast("long"), "status")


@register("budget_dominant", f"WITH {_TERMS}, r AS (SELECT *, row_number() OVER (PARTITION BY answer ORDER BY magnitude DESC, name) AS n FROM t) SELECT answer, name, magnitude FROM r WHERE n = 1")
def budget_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.dominant(budget.terms(_terms(spark, sf_dir))).select("answer", "name", "magnitude")


@register("contained_sum", """SELECT o_orderkey AS id, round(sum(l_extendedprice * (1 - l_discount)), 4) AS parts, o_totalprice AS whole, abs(round(sum(l_extendedprice * (1 - l_discount)), 4) - o_totalprice) <= 100000.0 AS holds
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice""")
def contained_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 4).alias("parts"))
    own = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("whole"))
    band = budget.banded(F.abs(F.col("parts") - F.col("whole")), F.lit(100000.0), F.lit(None).cast("double"))
    return own.join(lines, "id").withColumn("holds", band["holds"])


@register("frame_to_root", """SELECT c_custkey AS id, 'r' || n_regionkey AS root, round(10.0::DOUBLE * n_regionkey + 2.0::DOUBLE * (c_custkey % 100) * 0.3048::DOUBLE, 6) AS x, round(n_nationkey - 2.0::DOUBLE * ((c_custkey % 7) * 0.3048::DOUBLE), 6) AS y
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def frame_to_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    turned = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, -1, 0, 0, 0, 1)])
    transform = F.struct(F.array((F.col("n_regionkey") * 10).cast("double"), F.col("n_nationkey").cast("double"), F.lit(0.0)).alias("translation"), turned.alias("rotation"), F.lit(2.0).alias("scale"))
    steps = nation.select(name("n", "n_nationkey").alias("frame"), F.lit("ft").alias("unit"), name("r", "n_regionkey").alias("parent"), transform.alias("transform"), F.lit("m").alias("parent_unit"))
    points = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), name("n", "c_nationkey").alias("frame"), (F.col("c_custkey") % 100).cast("double").alias("x"), (F.col("c_custkey") % 7).cast("double").alias("y"), F.lit(0.0).alias("z"))
    return frames.at_root(points, steps).select("id", "root", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("ring"), F.col("event_id").alias("ord"), F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))


_RINGS = "g AS (SELECT user_id AS ring, event_id AS ord, value AS x, (event_id % 97)::DOUBLE AS y FROM events), s AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM g WINDOW w AS (PARTITION BY ring ORDER BY ord))"


@register("ring_measures", f"""WITH {_RINGS} SELECT ring, count(*) AS corners, round(sum(x * y2 - x2 * y) / 2, 3) AS area, round(sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))), 4) AS perimeter,
min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy FROM s GROUP BY ring""")
def ring_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.measures(_rings(spark, sf_dir)).select("ring", "corners", F.round("area", 3).alias("area"), F.round("perimeter", 4).alias("perimeter"), "minx", "maxx", "miny", "maxy")


@register("evenodd_area", f"WITH {_RINGS}, a AS (SELECT ring, sum(x * y2 - x2 * y) / 2 AS area FROM s GROUP BY ring) SELECT ring % 10 AS figure, round(sum(CASE WHEN ring % 3 = 0 THEN abs(area) ELSE -abs(area) END), 3) AS area FROM a GROUP BY ALL")
def evenodd_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = geometry.measures(_rings(spark, sf_dir)).select((F.col("ring") % 10).alias("figure"), F.when(F.col("ring") % 3 == 0, 0).otherwise(1).alias("depth"), "area", "cx", "cy")
    return geometry.even_odd(rings).select("figure", F.round("area", 3).alias("area"))


@register("edge_lengths", "SELECT a.event_id AS edge, round(sqrt(pow(a.value - b.value, 2) + pow(a.user_id - b.user_id, 2)), 6) AS length FROM events a JOIN events b ON b.event_id = a.event_id + 1")
def edge_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    edges = events.select(F.col("event_id").alias("edge"), F.col("event_id").alias("start"), (F.col("event_id") + 1).alias("end"))
    positions = events.select(F.col("event_id").alias("vertex"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), F.lit(0.0).alias("z"))
    return geometry.lengths(edges, positions).select("edge", F.round("length", 6).alias("length"))


_SQUARES = [(k, 10.0 * k, 5.0 * k, 40.0, 30.0) for k in range(8)]


def _figures(spark: SparkSession) -> DataFrame:
    rows = [(k, 0, n, x + dx * w, y + dy * h) for k, x, y, w, h in _SQUARES for n, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]
    return spark.createDataFrame(rows, "figure int, ring int, ord int, x double, y double")


_BOXES = "f(figure, x0, y0, x1, y1) AS (VALUES " + ", ".join(f"({k}, {x}, {y}, {x + w}, {y + h})" for k, x, y, w, h in _SQUARES) + ")"
_SHOTS = "q AS (SELECT event_id AS point, value AS x, (event_id % 97)::DOUBLE AS y, (user_id % 5) / 2.0 AS h, CASE WHEN user_id % 11 > 0 THEN (user_id % 3) * 0.25 END AS sigma FROM events)"


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigma = F.when(F.col("user_id") % 11 > 0, (F.col("user_id") % 3) * 0.25)
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("point"), F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"), ((F.col("user_id") % 5) / 2.0).alias("h"), sigma.alias("sigma"))


_CLEAR = """d AS (SELECT point, figure, h, sigma, CASE WHEN x >= x0 AND x <= x1 AND y >= y0 AND y <= y1 THEN least(x - x0, x1 - x, y - y0, y1 - y)
  ELSE -sqrt(pow(greatest(x0 - x, 0, x - x1), 2) + pow(greatest(y0 - y, 0, y - y1), 2)) END AS clearance FROM q, f)"""


@register("point_in_region", f"WITH {_BOXES}, {_SHOTS}, {_CLEAR} SELECT point, figure, round(clearance, 6) AS clearance FROM d WHERE clearance > 1e-9")
def point_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geometry.placed(_shots(spark, sf_dir).select("point", "x", "y"), _figures(spark), 0.0, 25.0)
    return found.where("clearance > 1e-9").select("point", "figure", F.round("clearance", 6).alias("clearance"))


@register("membership_band", f"""WITH {_BOXES}, {_SHOTS}, {_CLEAR}, e AS (SELECT *, 0.5 + sqrt(h * h + coalesce(sigma, 0) * coalesce(sigma, 0)) AS doubt FROM d),
r AS (SELECT point, figure, CASE WHEN sigma IS NULL THEN 'ambiguous' WHEN abs(clearance) <= doubt THEN 'ambiguous' WHEN clearance > 0 THEN 'inside' END AS state FROM e) SELECT * FROM r WHERE state IS NOT NULL""")
def membership_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.membership(_shots(spark, sf_dir), _figures(spark), 0.5, 25.0).select("point", "figure", "state")


_GRID = [(k, 20.0 * k + 1.5, 9.0 * k + 0.25) for k in range(6)]
_NEAR = "q(query, x, y) AS (VALUES " + ", ".join(map(str, _GRID)) + """), d AS (SELECT query, event_id AS shot, user_id::DOUBLE AS z, sqrt(pow(value - x, 2) + pow((event_id % 97) - y, 2)) AS distance FROM q, events),
n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, shot) AS n FROM d QUALIFY n <= 4)"""


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = _table(spark, sf_dir, "events").select(F.col("event_id").alias("shot"), F.col("value").alias("sx"), (F.col("event_id") % 97).cast("double").alias("sy"), F.col("user_id").cast("double").alias("z"))
    return geometry.nearest(spark.createDataFrame(_GRID, "query int, x double, y double"), shots, 4)


@register("nearest_shot", f"WITH {_NEAR} SELECT query, n::INT AS n, shot, round(distance, 6) AS distance FROM n")
def nearest_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("query", "n", "shot", F.round("distance", 6).alias("distance"))


_IDW = f"WITH {_NEAR}, w AS (SELECT query, CASE WHEN min(distance) OVER (PARTITION BY query) = 0 THEN (n = 1)::INT::DOUBLE ELSE 1 / (distance * distance) END AS raw, z FROM n), e AS (SELECT query, sum(raw * z) / sum(raw) AS z FROM w GROUP BY query)"


@register("idw_elevation", f"{_IDW} SELECT query, round(z, 5) AS z FROM e")
def idw_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.inverse_distance(_nearest(spark, sf_dir)).select("query", F.round("z", 5).alias("z"))


@register("fall", f"{_IDW} SELECT a.query AS pair, round(a.z - b.z, 5) AS fall, round(sqrt(20.0 * 20.0 + 9.0 * 9.0), 5) AS run, round((a.z - b.z) / sqrt(20.0 * 20.0 + 9.0 * 9.0), 5) AS gradient FROM e a JOIN e b ON b.query = a.query + 1")
def fall(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = geometry.inverse_distance(_nearest(spark, sf_dir)).select("query", "x", "y", "z")
    one, two = z.select(F.col("query").alias("pair"), *[F.col(c).alias(f"{c}1") for c in "xyz"]), z.select((F.col("query") - 1).alias("pair"), *[F.col(c).alias(f"{c}2") for c in "xyz"])
    return geometry.fall(one.join(two, "pair")).select("pair", *[F.round(c, 5).alias(c) for c in ("fall", "run", "gradient")])


@register("coincident_merge", """WITH RECURSIVE p AS (SELECT event_id AS id, event_type AS k, value AS x, (event_id % 97)::DOUBLE AS y, (user_id % 5)::DOUBLE AS sigma FROM events),
l AS (SELECT a.id, b.id AS other FROM p a JOIN p b ON a.k = b.k AND a.id <> b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.5),
r AS (SELECT id, id AS node FROM p UNION SELECT r.id, l.other FROM r JOIN l ON l.id = r.node), c AS (SELECT id, min(node) AS label FROM r GROUP BY id),
b AS (SELECT k, label, count(*) AS n, arg_min(p.id, (sigma, p.id)) AS id, min(sigma) AS sigma FROM p JOIN c USING (id) GROUP BY ALL) SELECT k, id, sigma, n FROM b""")
def coincident_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("k"), F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"), (F.col("user_id") % 5).cast("double").alias("sigma"))
    return geometry.coincident(points, 0.5, ["k"]).select("k", "id", "sigma", F.size("members").cast("long").alias("n"))


_RETIRED = "r AS (SELECT DISTINCT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'error' AND CAST(json_extract(props, '$.k') AS BIGINT) < event_id)"


@register("current_observations", f"WITH {_RETIRED} SELECT event_id, user_id, value FROM events WHERE event_type <> 'error' AND event_id NOT IN (SELECT k FROM r)")
def current_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.operators.observe import current

    events = _table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    retire = events.where("event_type = 'error' AND k < event_id").select(F.col("k").alias("supersedes"))
    return current(events.where("event_type <> 'error'").withColumn("id", F.col("event_id")), retire).select("event_id", "user_id", "value")


@register("sessions", "SELECT user_id AS session, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.operators.observe import sessions as distinct

    return distinct(_table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("position")))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    return orders.where("id % 10 <> 3"), orders.where("id % 10 <> 7").withColumn("value", F.when(F.col("id") % 10 == 5, F.col("value") + 1).otherwise(F.col("value")))


@register("review_changes", "SELECT o_orderkey AS id, CASE o_orderkey % 10 WHEN 3 THEN 'added' WHEN 7 THEN 'removed' ELSE 'changed' END AS state FROM orders WHERE o_orderkey % 10 IN (3, 5, 7)")
def review_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.changes(*_snapshots(spark, sf_dir), ["id"], "value").select("id", "state")


@register("review_disappeared", "SELECT o_orderkey AS id, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS dangling FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 10 = 7 GROUP BY ALL")
def review_disappeared(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, head = _snapshots(spark, sf_dir)
    refs = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("target"), F.col("l_partkey").cast("string").alias("source"))
    return review.disappeared(base, head, refs).select("id", F.array_join("dangling", ",").alias("dangling"))


@register("review_moved", "SELECT o_custkey AS subject, o_orderkey AS method, o_totalprice AS before, o_totalprice + 1 AS after FROM orders WHERE o_orderkey % 10 = 5")
def review_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("predicate"), F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("method"), F.col("o_orderdate").alias("day"), F.col("o_totalprice").alias("value"))
    head = orders.withColumn("value", F.when(F.col("method") % 10 == 5, F.col("value") + 1).otherwise(F.col("value")))
    return review.moved(orders, head).select("subject", "method", "before", "after")


@register("append_only", "SELECT event_type AS path, event_id AS line, CASE WHEN event_id % 11 = 0 THEN 'removed' ELSE 'edited' END AS fault FROM events WHERE event_id % 11 = 0 OR event_id % 13 = 0")
def append_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _table(spark, sf_dir, "events").select(F.col("event_type").alias("path"), F.col("event_id").alias("line"), F.col("props").alias("text"))
    head = base.where("line % 11 <> 0").withColumn("text", F.when(F.col("line") % 13 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    return review.appended_only(base, head)


@register("json_props", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@register("date_parse", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy/M/d")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), units.full_date(text).cast("string").alias("day"))


@register("unit_conversion", "SELECT p_partkey AS id, round(p_size * CASE p_partkey % 4 WHEN 0 THEN 0.3048 WHEN 1 THEN 1200.0::DOUBLE / 3937.0::DOUBLE WHEN 2 THEN 0.001 END, 9) AS metres FROM part")
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("ft", "usft", "mm", "acre"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(F.col("p_size") * units.metres(unit), 9).alias("metres"))


@register("id_parts", "SELECT 'n' || c_nationkey || ':' || c_name AS id, 'n' || c_nationkey AS namespace, c_name AS local FROM customer")
def id_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(":"), F.col("c_name"))
    return _table(spark, sf_dir, "customer").select(id_.alias("id"), units.namespace(id_).alias("namespace"), units.local(id_).alias("local"))


@register("supersession", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey + 2 <= m THEN o_orderkey + 2 WHEN o_orderkey % 3 = 1 AND o_orderkey + 1 <= m THEN o_orderkey + 1 WHEN o_orderkey % 3 = 0 AND o_orderkey + 1 <= m THEN o_orderkey + 1 ELSE o_orderkey END AS current FROM orders, (SELECT max(o_orderkey) AS m FROM orders)")
def supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderkey")).first()[0]
    claims = orders.select(F.col("o_orderkey").alias("id"), F.when((F.col("o_orderkey") % 3 < 2) & (F.col("o_orderkey") < F.lit(last)), F.col("o_orderkey") + 1).alias("superseded_by"))
    return graph.chain(claims).select("id", "current")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle for each supplier, from its key and balance."""
    s = _table(spark, sf_dir, "supplier")
    x, y = (F.col("s_suppkey") % 17).cast("double") * 3, (F.col("s_suppkey") % 11).cast("double") * 4
    w, h = (F.col("s_suppkey") % 5 + 2).cast("double"), (F.col("s_nationkey") % 4 + 1).cast("double") * 1.5
    corners = F.array(*[F.struct(F.lit(k).alias("ord"), (x + dx * w).alias("x"), (y + dy * h).alias("y")) for k, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])
    return s.select(F.col("s_suppkey").alias("figure"), F.lit(0).alias("ring"), F.explode(corners).alias("c")).select("figure", "ring", "c.ord", "c.x", "c.y")


_SUPPLIER_BOXES = "f AS (SELECT s_suppkey AS k, (s_suppkey % 17) * 3.0::DOUBLE AS x0, (s_suppkey % 11) * 4.0::DOUBLE AS y0, x0 + (s_suppkey % 5 + 2) AS x1, y0 + (s_nationkey % 4 + 1) * 1.5::DOUBLE AS y1 FROM supplier)"
_MEETING = f"{_SUPPLIER_BOXES}, p AS (SELECT a.k AS a, b.k AS b, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h, (a.x1 - a.x0) * (a.y1 - a.y0) AS area_a, (b.x1 - b.x0) * (b.y1 - b.y0) AS area_b FROM f a JOIN f b ON a.k < b.k WHERE w >= 0 AND h >= 0)"


@register("region_overlay", f"WITH {_MEETING} SELECT a, b, round(w * h, 4) AS common, round(area_a + area_b - w * h, 4) AS together FROM p WHERE w * h > 0")
def region_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two figures have in common comes from one overlay; what they cover together is the rest of both and that."""
    figs = written(regions.figures(_boxes(spark, sf_dir), 1e-6), "figures")
    common = regions.overlay(regions.meeting(figs, figs, 10.0).where("a < b"), "intersection", 1e-6).where("area > 0").withColumnRenamed("area", "common")
    own = lambda side: figs.select(F.col("figure").alias(side), F.col("area").alias(f"area_{side}"))
    both = common.join(own("a"), "a").join(own("b"), "b")
    return both.select("a", "b", F.round("common", 4).alias("common"), F.round(F.col("area_a") + F.col("area_b") - F.col("common"), 4).alias("together"))


@register("region_containment", f"WITH {_MEETING} SELECT a, b, CASE WHEN w * h = 0 THEN 'touching' WHEN w * h = area_a AND w * h = area_b THEN 'coincident' WHEN w * h = area_b THEN 'inside' WHEN w * h = area_a THEN 'surrounds' ELSE 'overlapping' END AS state FROM p")
def region_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    figs = written(regions.figures(_boxes(spark, sf_dir), 1e-6), "figures")
    return regions.containment_of_all(figs, 1e-6, 10.0)


@register("region_figures", f"WITH {_SUPPLIER_BOXES} SELECT k AS figure, round((x1 - x0) * (y1 - y0), 4) AS area, round(2 * (x1 - x0 + y1 - y0), 4) AS perimeter FROM f")
def region_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.figures(_boxes(spark, sf_dir), 1e-6).select("figure", F.round("area", 4).alias("area"), F.round("perimeter", 4).alias("perimeter"))


@register("buildable", f"WITH {_SUPPLIER_BOXES} SELECT k AS figure, CASE WHEN k % 7 = 0 THEN 'refused' WHEN least(x1 - x0, y1 - y0) <= 2 THEN 'consumed' ELSE 'region' END AS status, CASE WHEN k % 7 > 0 AND least(x1 - x0, y1 - y0) > 2 THEN round((x1 - x0 - 2) * (y1 - y0 - 2), 1) END AS area FROM f")
def buildable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = _boxes(spark, sf_dir)
    figs = regions.figures(rings, 1e-6)
    edges = geometry.sides(rings.select(F.col("figure").alias("ring"), "ord", "x", "y")).select(F.col("ring").alias("figure"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x2").alias("bx"), F.col("y2").alias("by"), F.when((F.col("ring") % 7 > 0) | (F.col("ord") > 0), 1.0).alias("setback"))
    left = regions.buildable(figs, edges, 1e-3)
    return left.select("figure", "status", F.when(F.col("status") == "region", F.round("area", 1)).alias("area"))


_SPOTS = [(k, 25.0 + 6.0 * k, 34.0 + 7.0 * k) for k in range(5)]
_GROUND = "2.0 * {x} - 3.0 * {y} + 5.0"


def _surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a shot of sloped ground; the shots of a kind and day are one survey, and equal places one shot."""
    x, y = F.col("value"), (F.col("event_id") % 97).cast("double")
    region = F.concat_ws("/", "event_type", F.date_format("ts", "yyyy-MM-dd"))
    shots = _table(spark, sf_dir, "events").select(region.alias("region"), F.col("event_id").alias("shot"), x.alias("x"), y.alias("y"))
    one = shots.groupBy("region", "x", "y").agg(F.min("shot").alias("shot"))
    return one.select("region", "shot", "x", "y", (2.0 * F.col("x") - 3.0 * F.col("y") + 5.0).alias("z"), F.lit(0.02).alias("sigma"))


@register("surface_elevation", f"""WITH q(query, x, y) AS (VALUES {", ".join(map(str, _SPOTS))}), r AS (SELECT DISTINCT event_type || '/' || strftime(ts, '%Y-%m-%d') AS region FROM events)
SELECT query, region, round({_GROUND.format(x="x", y="y")}, 5)::DOUBLE AS z FROM q, r""")
def surface_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevations on the triangulated surface of each survey; the ground is a plane, so any triangulation must give it back."""
    shots = written(_surveys(spark, sf_dir), "shots")
    facets = written(surface.facets(shots), "facets")  # a join that splits its tasks would make them once for each split
    spots = spark.createDataFrame(_SPOTS, "query int, x double, y double").crossJoin(shots.select("region").distinct())
    return surface.elevations(spots, facets).select("query", "region", F.round("z", 5).alias("z"))


@register("surface_falls", f"""WITH r AS (SELECT DISTINCT event_type || '/' || strftime(ts, '%Y-%m-%d') AS region FROM events)
SELECT region AS pair, 9.0::DOUBLE AS fall, round(sqrt(85.0::DOUBLE), 5) AS run, true AS decides FROM r""")
def surface_falls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fall between two places of each survey, and whether it decides a demand of 1."""
    shots = written(_surveys(spark, sf_dir), "shots")
    facets = written(surface.facets(shots), "facets")
    regions_ = shots.select("region").distinct()
    spots = spark.createDataFrame(_SPOTS[:2], "query int, x double, y double").crossJoin(regions_)
    found = written(surface.elevations(spots, facets).withColumn("query", F.concat_ws("#", "region", F.col("query").cast("string"))), "elevations")
    pairs = regions_.select(F.col("region").alias("pair"), F.concat("region", F.lit("#0")).alias("start"), F.concat("region", F.lit("#1")).alias("end"))
    return surface.falls(pairs, found, shots, 1.0).select("pair", F.round("fall", 5).alias("fall"), F.round("run", 5).alias("run"), "decides")


@register("bound_rules", "SELECT 'required-claim' AS rule, count(*) AS rules, 0::BIGINT AS ran, 0::BIGINT AS failed, count(*) AS unimplemented FROM part UNION ALL SELECT 'contained-areas-sum', count(*), count(*), count_if(p_size > 40), 0 FROM part WHERE p_size > 25")
def bound_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    params = F.create_map(F.lit("predicate"), F.array(F.lit("width")))
    rule = lambda name: F.struct(F.lit(name).alias("check"), params.alias("params"))
    types = part.select(F.col("p_type").alias("name")).distinct().withColumn("invariants", F.array(rule("required-claim")))
    nodes = part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"))
    asserted = part.where("p_size > 25").select(F.col("p_partkey").alias("subject"), F.lit("contained-areas-sum").alias("check"), params.alias("params"))
    failed = part.where("p_size > 40").select(F.lit("contained-areas-sum").alias("check"), F.col("p_partkey").cast("string").alias("subject"), F.lit("").alias("message"))
    return rules.tallies(rules.bound(types, nodes, asserted), failed).select(F.col("check").alias("rule"), "rules", "ran", F.coalesce("failed", F.lit(0)).cast("long").alias("failed"), "unimplemented")


@register("session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id AS session, count(*) AS n FROM s GROUP BY user_id, s.n""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("at"))
    return events.groupBy("session", F.session_window("at", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("session", "n")


@register("arc_measures", """WITH a AS (SELECT p_partkey AS id, (p_size + 1)::DOUBLE AS r, (p_partkey % 360) * pi() / 180 AS a, (p_partkey % 7 + 1) * pi() / 9 AS s FROM part)
SELECT id, round(r, 6) AS radius, round(CASE WHEN id % 2 = 0 THEN s ELSE s - 2 * pi() END, 6) AS sweep, round(r * abs(CASE WHEN id % 2 = 0 THEN s ELSE s - 2 * pi() END), 6) AS length FROM a""")
def arc_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, a, s = (F.col("p_size") + 1).cast("double"), F.radians((F.col("p_partkey") % 360).cast("double")), F.radians((F.col("p_partkey") % 7 + 1) * 20.0)
    middle = F.when(F.col("p_partkey") % 2 == 0, a + s / 2).otherwise(a + s / 2 + F.lit(3.141592653589793))
    at = lambda t: (F.cos(t) * r, F.sin(t) * r)
    points = {"1": at(a), "2": at(a + s), "t": at(middle), "c": (F.lit(0.0), F.lit(0.0))}
    columns = [c.alias(n) for k, (x, y) in points.items() for n, c in ((f"x{k}", x), (f"y{k}", y)) if k in "12"]
    columns += [c.alias(n) for k in "tc" for n, c in ((f"{k}x", points[k][0]), (f"{k}y", points[k][1]))]
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *columns)
    return arcs.measured(rows).select("id", *[F.round(c, 6).alias(c) for c in ("radius", "sweep", "length")])
