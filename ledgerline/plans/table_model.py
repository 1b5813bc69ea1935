"""A model written from the driver's tables, and the questions about it as queries with their DuckDB SQL.

Regions become sites, nations buildings with one storey, suppliers rooms with a boundary of four edges, a desk
inside each, and some with a second. The text files are written by the executors, read back by the loader,
and everything else is asked of what was loaded. Which rooms are wrong, and how, follows from their keys.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.catalogue import register
from ledgerline.operators import graph, resolution, rules
from ledgerline.plans import model_queries as q
from ledgerline.scratch import shared_dir, written
from ledgerline.sources import entity

_BY = '(source "survey") (method m:gnss) (date "2026-01-01")'
_POSITION = "(tolerance close) (position position)"
_HEADER = "\n".join([
    '(project (label "Tables") (globalid-namespace "https://example.org/tables"))',
    *(f'(namespace {n} (description "{n}"))' for n in ("site", "g", "m", "frame", "fit")),
    f'(type Room (kind Space) (geometry area) (description "A room") (invariant boundary-loops-close {_POSITION}) (invariant claim-agrees-with-geometry (predicate area) (discrepancy area) {_POSITION}))',
    '(type Desk (kind Space) (geometry area) (description "A desk"))',
    '(type Floor (kind Storey) (geometry absent) (description "A floor"))(type House (kind Building) (geometry absent) (description "A house"))',
    '(type Plot (kind Site) (geometry absent) (description "A plot"))(type Wall (kind Element) (geometry absent) (description "A wall"))(type Fire (kind Zone) (geometry absent) (description "A zone"))',
    "(predicate position (unit m) (shape coordinate) (dimension 2)) (predicate area (unit m2) (shape scalar)) (predicate furnished (unit m2) (shape scalar)) (predicate fit (shape transform))",
    "(predicate crs (shape text) (claim-bearing #f)) (predicate factor (shape text) (claim-bearing #f))",
    "(tolerance close (value 0.01 m)) (tolerance area (value 0.6 m2)) (tolerance limit (value 0.04 m))",
    '(frame frame:g (unit m) (crs "EPSG:1"))',
    *(f"(node site:z-{k} (kind Zone) (type Fire))" for k in range(4)),
])


def _text(template: str, **columns: Column) -> Column:
    """A template with columns in its places ``{name}``."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), columns[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def _box(prefix: str, x: Column, y: Column, w: Column, h: Column, key: Column, backing: Column, last: Column) -> Column:
    """Corners, edges and a loop of a rectangle; the loop lacks its last edge where ``last`` says so."""
    key = F.concat(F.lit(prefix), key.cast("string"))
    corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    out = [_text(f"(vertex g:v{{k}}-{n} (frame frame:g) (position (value ({{x}} {{y}}) m) {_BY} (accuracy (independent 0.01 m))))\n", k=key, x=a.cast("double"), y=b.cast("double")) for n, (a, b) in enumerate(corners)]
    out += [_text(f"(edge g:e{{k}}-{n} (frame frame:g) (vertices g:v{{k}}-{n} g:v{{k}}-{(n + 1) % 4}){{b}})\n", k=key, b=backing if n == 0 else F.lit("")) for n in range(4)]
    edges = F.concat(*[F.concat(F.lit(" g:e"), key, F.lit(f"-{n}")) for n in range(3)], F.when(last, F.concat(F.lit(" g:e"), key, F.lit("-3"))).otherwise(F.lit("")))
    return F.concat(*out, _text("(loop g:l{k} (frame frame:g) (edges{e}))\n", k=key, e=edges))


def _lines(spark: SparkSession, sf_dir: str, changed: bool) -> DataFrame:
    """The text of every entity; with ``changed``, a later revision in which some corners moved and some desks are gone."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    r, n, s = F.col("r_regionkey"), F.col("n_nationkey"), F.col("s_suppkey")
    accuracy = lambda size: F.concat(F.lit("(accuracy (independent "), size.cast("string"), F.lit(" m) (systematic 0.01 m site:cp))"))
    fit = "(fit (id fit:{i}) (value (transform (translation {t} 2.0 0.0) (rotation 1.0 0.0 0.0 0.0 1.0 0.0 0.0 0.0 1.0) (scale 1.0))) " + _BY + " {a})"
    regions_ = read("region").select(F.concat(
        _text("(node site:r-{r} (kind Site) (type Plot) ", r=r), _text(fit, i=F.concat(F.lit("r-"), r.cast("string")), t=(r * 10).cast("double"), a=accuracy(F.lit(0.02))), F.lit(")\n"),
        _text("(frame frame:r-{r} (unit m) (parent frame:g) (transform fit:r-{r}){f})\n", r=r, f=F.when(r % 2 == 0, ' (factor "1.0002")').otherwise("")),
    ).alias("value"))
    nations = read("nation").select(F.concat(
        _text("(frame frame:n-{n} (unit m) (parent frame:r-{r}) (transform fit:n-{n}))\n", n=n, r=F.col("n_regionkey")),
        _text("(node site:n-{n} (kind Building) (type House) (frame frame:n-{n}) (within site:r-{r}) (assert cross-frame-budget-holds (frame frame:g) (limit limit)) (assert ground-to-grid-stated (crs crs) (ground-to-grid factor) (position position)) ", n=n, r=F.col("n_regionkey")),
        _text(fit, i=F.concat(F.lit("n-"), n.cast("string")), t=n.cast("double"), a=accuracy(((n % 5) + 1) / 100.0)), F.lit(")\n"), _text("(node site:f-{n} (kind Storey) (type Floor) (within site:n-{n}))\n", n=n),
    ).alias("value"))
    x, y, w, h = s * 20, F.col("s_nationkey") * 40, s % 5 + 2, F.col("s_nationkey") % 4 + 1
    moved = F.when(s % 10 == 4, 0.25).otherwise(0.0) if changed else F.lit(0.0)
    area = (w * h + F.when(s % 7 == 3, 5).otherwise(0)).cast("double")
    claim = lambda name, value: _text(f" ({name} (value {{v}} m2) {_BY} (accuracy (independent 0.1 m2)))", v=value)
    asserts = f"(assert contained-areas-do-not-overlap {_POSITION}) (assert contained-areas-sum (area-tolerance area) (predicate furnished) (kind Space) {_POSITION})"
    room = F.concat(
        _box("-", x + moved, y, w, h, s, F.when(s % 3 == 0, F.concat(F.lit(" (backed-by site:w-"), s.cast("string"), F.lit(") (assert edge-backing-resolves)"))).otherwise(""), s % 11 != 5),
        _text("(node site:s-{s} (kind Space) (type Room) (geometry area) (frame frame:g) (within site:f-{n}) (boundary g:l-{s}) (member-of site:z-{z}) " + asserts + "{a}{f})\n", s=s, n=F.col("s_nationkey"), z=s % 4, a=claim("area", area), f=claim("furnished", F.when(s % 4 == 1, 1.5).otherwise(0.5))),
        F.when(s % 3 == 0, _text("(node site:w-{s} (kind {k}) (type {t}){w})\n", s=s, k=F.when(s % 6 == 0, "Element").otherwise("Zone"), t=F.when(s % 6 == 0, "Wall").otherwise("Fire"), w=F.when(s % 6 == 0, F.concat(F.lit(" (within site:f-"), F.col("s_nationkey").cast("string"), F.lit(")"))).otherwise(""))).otherwise(""),
    )
    desk = F.concat(
        _box("-d", x + F.when(s % 5 == 2, w - 0.5).otherwise(0.5), y + 0.25, F.lit(1.0), F.lit(0.5), s, F.lit(""), F.lit(True)),
        _text("(node site:d-{s} (kind Space) (type Desk) (geometry area) (frame frame:g) (within site:s-{s}) (boundary g:l-d{s}) (assert sits-inside (container site:s-{s}) " + _POSITION + ") (assert stays-clear-of-zone (zone site:s-{z}) " + _POSITION + "))\n", s=s, z=s + s % 2),
    )
    second = F.concat(
        _box("-k", x + 1.0, y + 0.25, F.lit(0.5), F.lit(0.5), s, F.lit(""), F.lit(True)),
        _text("(node site:k-{s} (kind Space) (type Desk) (geometry area) (frame frame:g) (within site:s-{s}) (boundary g:l-k{s}))\n", s=s),
    )
    gone = (s % 10 == 6) if changed else F.lit(False)
    suppliers = read("supplier").select("s_suppkey", "s_nationkey")
    rooms = suppliers.repartition(1 + suppliers.count() // 500).select(F.concat(room, desk, F.when((s % 3 == 1) & ~gone, second).otherwise("")).alias("value"))
    return spark.createDataFrame([(_HEADER,)], "value string").unionAll(regions_).unionAll(nations).unionAll(rooms)


def _write(spark: SparkSession, sf_dir: str, changed: bool, root: str) -> None:
    """The model's files, of at most 100 rooms: a file is parsed and printed as a whole, so it keeps its size whatever the tables'."""
    _lines(spark, sf_dir, changed).write.option("maxRecordsPerFile", 100).text(root)


_MODELS: dict[tuple[str, str, bool], entity.Model] = {}


def model_of(spark: SparkSession, sf_dir: str, changed: bool = False) -> entity.Model:
    """The loaded model of a folder of tables; parsed once a session, since every query asks it."""
    key = spark.sparkContext.applicationId, sf_dir, changed
    if key not in _MODELS:
        root = f"{shared_dir(spark)}/ledgerline/model-{uuid.uuid4().hex}"
        _write(spark, sf_dir, changed, root)
        _MODELS[key] = entity.load_model(spark, root, keep=True, extension="txt")
    return _MODELS[key]


_S = """s AS (SELECT s_suppkey AS s, s_nationkey AS n, (s_suppkey % 5 + 2)::DOUBLE AS w, (s_nationkey % 4 + 1)::DOUBLE AS h, s_suppkey % 3 = 1 AS two, s_suppkey % 11 <> 5 AS closed FROM supplier)"""


@register("model_nodes", f"""WITH {_S} SELECT 'site:r-' || r_regionkey AS id, 'Site' AS kind, NULL AS within FROM region
UNION ALL SELECT 'site:n-' || n_nationkey, 'Building', 'site:r-' || n_regionkey FROM nation UNION ALL SELECT 'site:f-' || n_nationkey, 'Storey', 'site:n-' || n_nationkey FROM nation
UNION ALL SELECT 'site:s-' || s, 'Space', 'site:f-' || n FROM s UNION ALL SELECT 'site:d-' || s, 'Space', 'site:s-' || s FROM s UNION ALL SELECT 'site:k-' || s, 'Space', 'site:s-' || s FROM s WHERE two
UNION ALL SELECT 'site:w-' || s, CASE WHEN s % 6 = 0 THEN 'Element' ELSE 'Zone' END, CASE WHEN s % 6 = 0 THEN 'site:f-' || n END FROM s WHERE s % 3 = 0 UNION ALL SELECT 'site:z-' || k, 'Zone', NULL FROM range(4) t(k)""")
def model_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_of(spark, sf_dir).nodes.select("id", "kind", "within")


_BOXED = "b AS (SELECT '-' || s AS k, closed FROM s UNION ALL SELECT '-d' || s, true FROM s UNION ALL SELECT '-k' || s, true FROM s WHERE two)"


@register("model_edges", f"WITH {_S}, {_BOXED} SELECT 'g:e' || k || '-' || i AS id, 'g:v' || k || '-' || i AS start, 'g:v' || k || '-' || ((i + 1) % 4) AS \"end\", CASE WHEN i = 0 AND k NOT LIKE '-d%' AND k NOT LIKE '-k%' AND substr(k, 2)::INT % 3 = 0 THEN 1 ELSE 0 END AS backed FROM b, range(4) t(i)")
def model_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_of(spark, sf_dir).edges.select("id", "start", "end", F.size("backed_by").alias("backed"))


@register("model_loops", f"WITH {_S}, {_BOXED} SELECT 'g:l' || k AS id, CASE WHEN closed THEN 4 ELSE 3 END AS n, 'g:e' || k || '-0' AS first FROM b")
def model_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_of(spark, sf_dir).loops.select("id", F.size("edges").alias("n"), F.col("edges")[0].alias("first"))


@register("model_claims", f"""WITH {_S} SELECT 'site:s-' || s AS subject, 'area' AS predicate, w * h + CASE WHEN s % 7 = 3 THEN 5 ELSE 0 END AS value, 0.1::DOUBLE AS sigma FROM s
UNION ALL SELECT 'site:s-' || s, 'furnished', CASE WHEN s % 4 = 1 THEN 1.5 ELSE 0.5 END, 0.1 FROM s""")
def model_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_of(spark, sf_dir).live_claims.where("value.scalar is not null").select("subject", "predicate", F.col("value.scalar").alias("value"), F.round("sigma", 9).alias("sigma"))


@register("model_positions", f"""WITH {_S} SELECT 'g:v-' || s || '-' || i AS vertex, s * 20 + CASE WHEN i IN (1, 2) THEN w ELSE 0 END AS x, n * 40 + CASE WHEN i > 1 THEN h ELSE 0 END AS y FROM s, range(4) t(i)""")
def model_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.positions(model_of(spark, sf_dir), "position").where("vertex rlike 'v-[0-9]'").select("vertex", "x", "y")


@register("model_faults", "SELECT 'none' AS kind, 0::BIGINT AS n WHERE false")
def model_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sound model has no fault of any kind: references, repeated ids, predicates, types, places and cycles."""
    return model_of(spark, sf_dir).faults().groupBy(F.col("message").alias("kind")).agg(F.count("*").alias("n"))


@register("model_boundaries", f"WITH {_S}, {_BOXED} SELECT 'site:' || CASE WHEN k LIKE '-d%' OR k LIKE '-k%' THEN substr(k, 2, 1) || '-' || substr(k, 3) ELSE 's' || k END AS node, 'g:l' || k AS loop, 'g:e' || k || '-' || i AS edge, i::INT AS edge_ord FROM b, range(4) t(i) WHERE closed OR i < 3")
def model_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.boundary_edges(model_of(spark, sf_dir)).select("node", "loop", "edge", "edge_ord")


@register("model_assembly", f"WITH {_S}, {_BOXED} SELECT 'g:l' || k AS loop, CASE WHEN NOT closed THEN 'the ring does not close' END AS fault FROM b")
def model_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.assembled(model_of(spark, sf_dir)).select("loop", "fault")


@register("model_classification", f"WITH {_S}, {_BOXED} SELECT 'g:e' || k || '-' || i AS edge, CASE WHEN i = 0 AND k NOT LIKE '-d%' AND k NOT LIKE '-k%' AND substr(k, 2)::INT % 6 = 0 THEN 'physical' ELSE 'virtual' END AS boundary FROM b, range(4) t(i)")
def model_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.classification(model_of(spark, sf_dir))


@register("model_measures", f"WITH {_S} SELECT 'site:s-' || s AS id, 'region' AS form, round(2 * (w + h), 6) AS length, round(w * h, 6) AS area FROM s WHERE closed UNION ALL SELECT 'g:e-' || s || '-' || i, 'edge', CASE WHEN i % 2 = 0 THEN w ELSE h END, NULL FROM s, range(4) t(i)")
def model_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = q.measure(model_of(spark, sf_dir), "position", 1e-3).where("id rlike '^site:s-|^g:e-[0-9]' and area is not null or form = 'edge' and id rlike '^g:e-[0-9]'")
    return found.select("id", "form", F.round("length", 6).alias("length"), F.round("area", 6).alias("area"))


@register("model_get", f"WITH {_S} SELECT 'site:s-' || s AS id, 'area,furnished' AS claims FROM s WHERE s = 7")
def model_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.get(model_of(spark, sf_dir), "site:s-7").select("id", F.array_join(F.array_sort(F.transform("claims", lambda c: c["predicate"])), ",").alias("claims"))


@register("model_audit", f"WITH {_S}, {_BOXED} SELECT 'position' AS predicate, 'current' AS status, 4 * count(*) AS n FROM b UNION ALL SELECT 'area', 'current', count(*) FROM s UNION ALL SELECT 'furnished', 'current', count(*) FROM s UNION ALL SELECT 'fit', 'current', count(*) + (SELECT count(*) FROM region) FROM nation")
def model_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.audit(model_of(spark, sf_dir).live_claims).groupBy("predicate", "status").agg(F.count("*").alias("n"))


@register("model_members", f"WITH {_S} SELECT 'site:s-' || s AS node, 1 AS depth FROM s WHERE s % 4 = 2")
def model_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.traverse(model_of(spark, sf_dir), "site:z-2", "members-of").select("node", "depth")


@register("model_plan", f"WITH {_S} SELECT 'site:s-' || s AS id, CASE WHEN NOT closed THEN 'unreadable-boundary' END AS undrawn FROM s WHERE n = 3 UNION ALL SELECT 'site:d-' || s, NULL FROM s WHERE n = 3 UNION ALL SELECT 'site:k-' || s, NULL FROM s WHERE n = 3 AND two UNION ALL SELECT 'site:w-' || s, 'no-boundary' FROM s WHERE n = 3 AND s % 6 = 0")
def model_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.plan_of(model_of(spark, sf_dir), "site:f-3", "position", 1e-3).select("id", "undrawn")


@register("model_references", f"WITH {_S} SELECT 'site:d-' || s AS source, 'within' AS relation FROM s WHERE s = 7 UNION ALL SELECT 'site:k-' || s, 'within' FROM s WHERE s = 7 AND two")
def model_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.references(model_of(spark, sf_dir).references(), "site:s-7")


_SPREAD = "sqrt(pow((n_nationkey % 5 + 1) / 100.0::DOUBLE, 2) + 0.0004::DOUBLE + 0.0001::DOUBLE)"


@register("model_frame_budget", f"SELECT 'frame:n-' || n_nationkey AS a, round({_SPREAD}, 9) AS sigma FROM nation")
def model_frame_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The systematic term that both transforms share counts once."""
    model = model_of(spark, sf_dir)
    pairs = model.frames.where("frame like 'frame:n-%'").select(F.col("frame").alias("a"), F.lit("frame:g").alias("b"))
    return q.transform_budget(model, pairs).select("a", F.round("sigma", 9).alias("sigma"))


@register("frame_routes", """SELECT c_custkey AS id, round(c_custkey % 100 + a.n_nationkey + 10 * a.n_regionkey - b.n_nationkey - 10 * b.n_regionkey, 6)::DOUBLE AS x
FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON b.n_nationkey = (c_custkey % 25)""")
def frame_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of customers carried from the frame of their nation to that of another, up to the root and down again."""
    from ledgerline.operators import frames

    model = model_of(spark, sf_dir)
    name = lambda c: F.concat(F.lit("frame:n-"), c.cast("string"))
    points = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), name(F.col("c_nationkey")).alias("frame"), name(F.col("c_custkey") % 25).alias("target"), (F.col("c_custkey") % 100).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return frames.carried(points, frames.resolved(model.frames, model.claims)).select("id", F.round("x", 6).alias("x"))


def _violations(name: str, where: str, subject: str = "site:s-", source: str = "s") -> None:
    """Register the query of one check; its SQL says which subjects fail it."""
    sql = f"WITH {_S} SELECT '{subject}' || {'s' if source == 's' else 'n_nationkey'} AS subject FROM {source} WHERE {where}"
    if subject == "g:e-":
        sql = sql.replace(" AS subject", " || '-0' AS subject")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = model_of(spark, sf_dir)
        bound = written(rules.bound(model.types, model.nodes, model.assertions), "rules")
        return rules.run(bound, q.check_tables(model, "position", 1e-3, bound), [name]).select("subject").distinct()

    register("check_" + name.replace("-", "_"), sql)(run)


_violations("boundary-loops-close", "NOT closed")
_violations("claim-agrees-with-geometry", "closed AND s % 7 = 3")
_violations("contained-areas-do-not-overlap", "two AND (s % 5 <> 2 OR w - 0.5 < 1.5)")
_violations("contained-areas-sum", "abs(CASE WHEN two THEN 0.75 ELSE 0.5 END - CASE WHEN s % 4 = 1 THEN 1.5 ELSE 0.5 END) > 0.6")
_violations("edge-backing-resolves", "s % 6 = 3", "g:e-")
_violations("cross-frame-budget-holds", f"{_SPREAD} > 0.04", "site:n-", "nation")
_violations("ground-to-grid-stated", "n_regionkey % 2 = 1", "site:n-", "nation")
_violations("sits-inside", "NOT closed OR s % 5 = 2", "site:d-")
_violations("stays-clear-of-zone", "CASE WHEN s % 2 = 0 THEN true ELSE (s + 1) NOT IN (SELECT s FROM s WHERE closed) END", "site:d-")


@register("check_tallies", f"""WITH {_S}, v AS (SELECT 'boundary-loops-close' AS rule, count(*) AS rules, count_if(NOT closed) AS failed FROM s UNION ALL SELECT 'claim-agrees-with-geometry', count(*), count_if(closed AND s % 7 = 3) FROM s
UNION ALL SELECT 'cross-frame-budget-holds', count(*), count_if({_SPREAD} > 0.04) FROM nation UNION ALL SELECT 'ground-to-grid-stated', count(*), count_if(n_regionkey % 2 = 1) FROM nation) SELECT rule, rules, failed, rules - failed AS passed FROM v""")
def check_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["boundary-loops-close", "claim-agrees-with-geometry", "cross-frame-budget-holds", "ground-to-grid-stated"]
    _, tallies = q.check(model_of(spark, sf_dir), "position", 1e-3, names)
    return tallies.where(F.col("check").isin(names)).select(F.col("check").alias("rule"), "rules", F.col("failed").cast("long").alias("failed"), F.col("passed").cast("long").alias("passed"))


@register("rules_complete", "SELECT 'none' AS rule WHERE false")
def rules_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that name unknown checks or parameters, or lack required ones: the model has none."""
    model = model_of(spark, sf_dir)
    bound = written(rules.bound(model.types, model.nodes, model.assertions), "rules")
    return rules.invalid(bound).select(F.col("check").alias("rule")).unionAll(rules.incomplete(bound).select(F.col("check").alias("rule")))


@register("review_findings", f"""WITH {_S} SELECT 'boundary-moved-without-claim' AS kind, 'g:v-' || s || '-' || i AS subject FROM s, range(4) t(i) WHERE s % 10 = 4 AND (closed OR i < 4)
UNION ALL SELECT 'id-disappeared-without-supersession', x FROM (SELECT unnest(['site:k-' || s, 'g:l-k' || s, 'g:v-k' || s || '-0', 'g:v-k' || s || '-1', 'g:v-k' || s || '-2', 'g:v-k' || s || '-3', 'g:e-k' || s || '-0', 'g:e-k' || s || '-1', 'g:e-k' || s || '-2', 'g:e-k' || s || '-3']) AS x FROM s WHERE two AND s % 10 = 6)""")
def review_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two revisions: rooms whose corners moved under unchanged claims, and desks that are gone."""
    return q.compare(model_of(spark, sf_dir), model_of(spark, sf_dir, changed=True)).select("kind", "subject")


@register("export_features", f"WITH {_S} SELECT 'site:s-' || s AS id, 'gml:Polygon' AS form FROM s WHERE closed UNION ALL SELECT 'site:d-' || s, 'gml:Polygon' FROM s UNION ALL SELECT 'site:k-' || s, 'gml:Polygon' FROM s WHERE two")
def export_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.sources import exports

    model = model_of(spark, sf_dir)
    drawn = model.nodes.select("id", "label", "kind", "type", "within", "frame").join(q.figures(model, "position", 1e-3).select(F.col("figure").alias("id"), "rings"), "id").where("rings is not null")
    found = exports.features(drawn, "model", "EPSG:1", ["label", "kind", "type", "within", "frame"])
    return found.select("id", F.regexp_extract("xml", "gml:Polygon", 0).alias("form"))


@register("canonical_print", "SELECT true AS stable, true AS same")
def canonical_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every file's canonical printing prints as itself, and states the same rows as the file."""
    import pandas as pd

    from ledgerline.sources import sexpr

    model_of(spark, sf_dir)
    root = f"{shared_dir(spark)}/ledgerline/model-{uuid.uuid4().hex}"
    _write(spark, sf_dir, False, root)

    def run(batches):
        for frame in batches:
            rows = []
            for text in frame["text"]:
                once = sexpr.formatted(text)
                plain = lambda t: sorted(json.dumps([k, {c: v for c, v in r.items() if c not in ("path", "line", "col")}], sort_keys=True) for k, r in entity.rows_of("x", t))
                rows.append((sexpr.formatted(once) == once, plain(text) == plain(once)))
            yield pd.DataFrame(rows, columns=["stable", "same"])

    found = entity.read_files(spark, root, "txt").mapInPandas(run, "stable boolean, same boolean")
    return found.agg(F.min("stable").alias("stable"), F.min("same").alias("same"))


# Authoring: the batch is built from the nations, which are as many as a person might write.


def _authored(spark: SparkSession, sf_dir: str) -> list[tuple[str, dict]]:
    """The rows of the files that a batch of every operation leaves, parsed from their printed text."""
    from ledgerline.sources import author

    claim = lambda value, unit, **more: {"value": value, "unit": unit, "source": "survey", "method": "m:gnss", "date": "2026-02-02", "accuracy": ["independent 0.1 m"], **more}
    ops: list[dict] = [{"op": "add-node", "id": "site:p", "kind": "Site", "type": "Plot", "file": "n.dfc"}, {"op": "classify-type", "type": "House", "system": "IFC4", "code": "IfcBuilding"}]
    keys = sorted(r.n_nationkey for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").collect())
    for k in keys:
        ops.append({"op": "add-node", "id": f"site:b-{k}", "kind": "Building", "type": "House", "label": f"B{k}", "file": "n.dfc"})
        ops.append({"op": "relate", "id": f"site:b-{k}", "within": "site:p", "memberOf": [f"site:z-{k % 4}"]})
        ops.append({"op": "add-claim", "subject": f"site:b-{k}", "predicate": "area", "claim": claim(f"{k}.5", "m2", id=f"fit:a-{k}")})
        if k % 2:
            ops.append({"op": "set-label", "id": f"site:b-{k}", "label": f"L{k}"})
        if k % 3 == 0:
            ops.append({"op": "supersede", "subject": f"site:b-{k}", "predicate": "area", "claim": claim(f"{k}.75", "m2", id=f"fit:s-{k}")})
        if k % 3 == 1:
            ops.append({"op": "add-claim", "subject": f"site:b-{k}", "predicate": "area", "claim": claim(f"{k}.25", "m2", id=f"fit:c-{k}")})
            ops.append({"op": "deprecate-claim", "claim": f"fit:a-{k}", "supersededBy": f"fit:c-{k}"})
        if k % 5 == 4:
            ops.append({"op": "retire", "id": f"site:b-{k}", "reason": "rebuilt", "date": "2026-03-03"})
        ops += [{"op": "add-vertex", "id": f"g:a{k}-{n}", "frame": "frame:g", "predicate": "position", "claim": claim(f"{k}.0 {n}.0", "m"), "file": "g.dfc"} for n in range(3)]
        ops += [{"op": "add-edge", "id": f"g:b{k}-{n}", "frame": "frame:g", "start": f"g:a{k}-{n}", "end": f"g:a{k}-{(n + 1) % 3}", "file": "g.dfc"} for n in range(3)]
        ops.append({"op": "add-loop", "id": f"g:c{k}", "frame": "frame:g", "edges": [f"g:b{k}-{n}" for n in range(3)], "file": "g.dfc"})
        x = 1000 + 100 * k  # away from the corners above, to which it would snap
        corners = [f"{x}.0 0.0", f"{x + 4}.0 0.0", f"{x + 4}.0 3.0", f"{x}.0 3.0", f"{x}.0 0.0"]
        ops.append({"op": "scaffold-loop", "namespace": "g", "frame": "frame:g", "predicate": "position", "tolerance": "close", "corners": corners, "claim": {"source": "survey", "method": "m:gnss", "accuracy": ["independent 0.1 m"], "date": "2026-02-02"}, "file": "g.dfc"})
    work = author.Workspace.of({"m.dfc": _HEADER}, "2026-02-02")
    for op in author.read_batch(json.dumps({"operations": ops})):
        work.apply(op)
    return [row for path, text in sorted(work.texts().items()) for row in entity.rows_of(path, text)]


@register("author_nodes", "SELECT 'site:b-' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 1 THEN 'L' ELSE 'B' END || n_nationkey AS label, 'site:p' AS within, 'site:z-' || (n_nationkey % 4) AS zone, n_nationkey % 5 = 4 AS retired FROM nation")
def author_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r["id"], r["label"], r["within"], r["member_of"][0], r["retired"] is not None) for t, r in _authored(spark, sf_dir) if t == "nodes" and r["id"].startswith("site:b-")]
    return spark.createDataFrame(rows, "id string, label string, within string, zone string, retired boolean")


@register("author_claims", """SELECT 'fit:a-' || n_nationkey AS id, n_nationkey + 0.5::DOUBLE AS value, CASE n_nationkey % 3 WHEN 0 THEN 'fit:s-' || n_nationkey WHEN 1 THEN 'fit:c-' || n_nationkey END AS superseded_by, CASE WHEN n_nationkey % 3 < 2 THEN 'deprecated' ELSE 'normal' END AS rank FROM nation
UNION ALL SELECT 'fit:s-' || n_nationkey, n_nationkey + 0.75, NULL, 'normal' FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'fit:c-' || n_nationkey, n_nationkey + 0.25, NULL, 'normal' FROM nation WHERE n_nationkey % 3 = 1""")
def author_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r["id"], r["value"]["scalar"], r["superseded_by"], r["rank"]) for t, r in _authored(spark, sf_dir) if t == "claims" and r["predicate"] == "area"]
    return spark.createDataFrame(rows, "id string, value double, superseded_by string, rank string")


@register("author_topology", """SELECT 'vertices' AS family, 7 * count(*) AS n FROM nation UNION ALL SELECT 'edges', 7 * count(*) FROM nation UNION ALL SELECT 'loops', 2 * count(*) FROM nation UNION ALL SELECT 'loop_edges', 7 * count(*) FROM nation""")
def author_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _authored(spark, sf_dir)
    rows = [(family, sum(t == family for t, _ in found)) for family in ("vertices", "edges", "loops")]
    rows.append(("loop_edges", sum(len(r["edges"]) for t, r in found if t == "loops")))
    return spark.createDataFrame(rows, "family string, n long")


@register("author_classification", "SELECT 'House' AS name, 'IFC4' AS system, 'IfcBuilding' AS code")
def author_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r["name"], c["system"], c["code"]) for t, r in _authored(spark, sf_dir) if t == "types" for c in r["classifications"]]
    return spark.createDataFrame(rows, "name string, system string, code string")


@register("model_siting", f"""WITH {_S}, c AS (SELECT s, CASE WHEN s % 5 = 2 THEN -0.5 ELSE least(0.5, 0.25, w - 1.5, h - 0.75) END AS clearance FROM s WHERE closed)
SELECT 'site:d-' || s AS footprint, round(clearance, 6)::DOUBLE AS clearance, CASE WHEN clearance > 0.24 THEN 'might-fit' WHEN clearance > 0.2 THEN 'fits' ELSE 'does-not-fit' END AS verdict FROM c""")
def model_siting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every desk in its room, against a margin of 0.24: the uncertainty of both sides' corners decides the rest."""
    from ledgerline.operators import regions

    model = model_of(spark, sf_dir)
    figs = written(q.figures(model, "position", 1e-3), "figures")
    key = F.regexp_extract("figure", "^site:.-(.*)$", 1)
    desks = figs.where("figure like 'site:d-%'").select("figure", F.concat(F.lit("site:s-"), key).alias("plot"), "rings", F.col("corner_sigma").alias("sigma"))
    rooms = figs.where("figure like 'site:s-%' and rings is not null").select("figure", "rings", F.col("corner_sigma").alias("sigma"))
    return regions.siting(desks, rooms, 1e-3, 0.24).select("footprint", F.round("clearance", 6).alias("clearance"), "verdict")


@register("arc_chords", """WITH a AS (SELECT p_partkey AS id, (p_size + 1)::DOUBLE AS r, (p_partkey % 7 + 1) * pi() / 9 AS s FROM part), w AS (SELECT id, r, CASE WHEN id % 2 = 0 THEN s ELSE 2 * pi() - s END AS sweep FROM a)
SELECT id, ceil(round(sweep / (2 * acos(1 - 0.01 / r)), 9))::INT AS n FROM w""")
def arc_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chords that stay within 0.01 of each arc, and no more than it takes."""
    from ledgerline.operators import arcs

    size, a, s = (F.col("p_size") + 1).cast("double"), F.radians((F.col("p_partkey") % 360).cast("double")), F.radians((F.col("p_partkey") % 7 + 1) * 20.0)
    middle = F.when(F.col("p_partkey") % 2 == 0, a + s / 2).otherwise(a + s / 2 + F.pi())
    at = {"1": a, "2": a + s, "t": middle}
    columns = [c.alias(n) for k in "12" for n, c in ((f"x{k}", F.cos(at[k]) * size), (f"y{k}", F.sin(at[k]) * size))]
    columns += [(F.cos(middle) * size).alias("tx"), (F.sin(middle) * size).alias("ty"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy")]
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), *columns)
    return arcs.tessellated(rows, 0.01).select("id", F.col("n_chords").alias("n"))
