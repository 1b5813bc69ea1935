"""Models from entity files: every file is parsed where it is read, into typed rows of the model's tables."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import graph, lookup
from ledgerline.scratch import shared_dir
from ledgerline.sources import sexpr
from ledgerline.sources.sexpr import Atom, List

_TRANSFORM = "struct<translation:array<double>,rotation:array<double>,scale:double>"
VALUE = f"struct<shape:string,unit:string,scalar:double,coord:array<double>,transform:{_TRANSFORM},text:string>"
_RULE = "array<struct<check:string,params:map<string,array<string>>>>"
_WHERE = "path string, line int, col int"
SLICE = 5000  # rows that a worker holds of what it parses

#: The model's tables and their columns.
SCHEMAS = {
    "project": "label string, globalid_namespace string, description string",
    "namespaces": "name string, description string",
    "types": f"name string, kinds array<string>, geometries array<string>, description string, classifications array<struct<system:string,code:string>>, invariants {_RULE}",
    "predicates": "name string, unit string, shape string, dimension int, claim_bearing boolean, strict boolean, description string",
    "tolerances": "name string, value double, unit string, description string",
    "frames": "frame string, label string, unit string, parent string, transform_claim string",
    "routes": "name string, namespace string, kind string, type string, file string, description string",
    "nodes": "id string, label string, kind string, type string, geometry string, frame string, within string, retired struct<date:string,reason:string,superseded_by:string>, member_of array<string>, boundary array<string>, observed_in array<string>",
    "vertices": "id string, label string, frame string, observed_in array<string>",
    "edges": "id string, label string, frame string, start string, end string, backed_by array<string>, observed_in array<string>",
    "loops": "id string, label string, frame string, edges array<string>, observed_in array<string>",
    "claims": f"id string, subject string, predicate string, value {VALUE}, source string, method string, accuracy array<struct<kind:string,magnitude:double,unit:string,source:string>>, day string, rank string, superseded_by string",
    "plain_values": f"subject string, predicate string, value {VALUE}",
    "assertions": "subject string, form string, check string, params map<string,array<string>>",
    "diagnostics": "severity string, message string",
}


def _text(c: List | None):
    return c.items[1].value if c is not None and len(c.items) > 1 and isinstance(c.items[1], Atom) else None


def _value(items: list) -> dict | None:
    """A value from the data after its tag."""
    if not items:
        return None
    first, unit = items[0], items[1].value if len(items) > 1 and isinstance(items[1], Atom) else None
    if isinstance(first, List):
        if first.tag == "transform":
            part = {c.tag: [a.value for a in c.items[1:]] for c in first.items[1:] if isinstance(c, List)}
            return {"shape": "transform", "transform": {"translation": part.get("translation"), "rotation": part.get("rotation"), "scale": (part.get("scale") or [None])[0]}}
        return {"shape": "coordinate", "coord": [a.value for a in first.items if isinstance(a, Atom) and a.kind == "real"], "unit": unit}
    if first.kind == "string":
        return {"shape": "text", "text": first.value}
    return {"shape": "scalar", "scalar": float(first.value) if first.kind in ("real", "integer") else None, "unit": unit}


def _params(items: list) -> dict[str, list[str]]:
    out = {}
    for c in items:
        if isinstance(c, List):
            flat = [a for x in c.items[1:] for a in (x.items if isinstance(x, List) else [x])]
            out[c.tag] = [a.value if a.kind == "string" else sexpr.atom_text(a) for a in flat if isinstance(a, Atom)]
    return out


def _claim(subject: str, c: List) -> dict | None:
    parts = {x.tag: x for x in c.items[1:] if isinstance(x, List)}
    if "value" not in parts:
        return None
    terms = []
    for t in parts["accuracy"].items[1:] if "accuracy" in parts else []:
        if isinstance(t, List) and len(t.items) >= 3:
            terms.append({"kind": t.tag, "magnitude": t.items[1].value, "unit": t.items[2].value, "source": t.items[3].value if len(t.items) > 3 else None})
    get = lambda n: _text(parts.get(n))
    return {"id": get("id"), "subject": subject, "predicate": c.tag, "value": _value(parts["value"].items[1:]), "source": get("source"), "method": get("method"), "accuracy": terms or None, "day": get("date"), "rank": get("rank") or "normal", "superseded_by": get("superseded-by")}


def rows_of(path: str, text: str, made: Callable[[dict], object] = dict) -> Iterator[tuple[str, object]]:
    """(table, row) of everything that a file states, and of what is wrong with it, each row as ``made`` makes it.

    One form is held at a time; what is kept until the file's end, as a file that can not be read states nothing, is made rows.
    """
    found: list[tuple[str, object]] = []
    try:
        for form in sexpr.each(text):
            at = [{"severity": "error", "message": message, "path": path, "line": line, "col": column} for line, column, message in sexpr.validate([form])]
            found += [("diagnostics", made(row)) for row in at]
            found += [(table, made(row)) for table, row in _stated(path, form)]
    except sexpr.SyntaxFault as e:
        found = [("diagnostics", made({"severity": "error", "message": e.message, "path": path, "line": e.line, "col": e.column}))]
    yield from found


def _stated(path: str, form: List) -> Iterator[tuple[str, dict]]:
    """(table, row) of what one form states."""
    where = {"path": path, "line": form.line, "col": form.column}
    tag, name = form.tag, _text(form) if len(form.items) > 1 else None
    children = [c for c in form.items[1:] if isinstance(c, List)]
    one = {c.tag: c for c in reversed(children)}
    every = lambda t: [_text(c) for c in children if c.tag == t]
    get = lambda t: _text(one.get(t))
    if tag == "project":
        yield "project", {"label": get("label"), "globalid_namespace": get("globalid-namespace"), "description": get("description")} | where
    elif tag == "namespace":
        yield "namespaces", {"name": name, "description": get("description")} | where
    elif tag == "type":
        rules = [{"check": c.items[1].value, "params": _params(c.items[2:])} for c in children if c.tag == "invariant" and len(c.items) > 1]
        codes = [{"system": c.items[1].value, "code": c.items[2].value} for c in children if c.tag == "classification" and len(c.items) > 2]
        yield "types", {"name": name, "kinds": every("kind"), "geometries": every("geometry"), "description": get("description"), "classifications": codes, "invariants": rules} | where
    elif tag == "predicate":
        bearing, strict = get("claim-bearing"), get("strict")
        yield "predicates", {"name": name, "unit": get("unit"), "shape": get("shape"), "dimension": get("dimension"), "claim_bearing": bearing is not False, "strict": strict is True, "description": get("description")} | where
    elif tag == "tolerance":
        v = one["value"].items if "value" in one else []
        yield "tolerances", {"name": name, "value": v[1].value if len(v) > 1 else None, "unit": v[2].value if len(v) > 2 else None, "description": get("description")} | where
    elif tag == "route":
        yield "routes", {"name": name, **{k: get(k) for k in ("namespace", "kind", "type", "file", "description")}} | where
    elif tag == "frame":
        yield "frames", {"frame": name, "label": get("label"), "unit": get("unit"), "parent": get("parent"), "transform_claim": get("transform")} | where
    elif tag == "node":
        gone = one.get("retired")
        inner = {c.tag: _text(c) for c in gone.items[1:] if isinstance(c, List)} if gone else None
        retired = {"date": inner.get("date"), "reason": inner.get("reason"), "superseded_by": inner.get("superseded-by")} if inner else None
        yield "nodes", {"id": name, **{k: get(k) for k in ("label", "kind", "type", "geometry", "frame", "within")}, "retired": retired, "member_of": every("member-of"), "boundary": every("boundary"), "observed_in": every("observed-in")} | where
    elif tag == "vertex":
        yield "vertices", {"id": name, "label": get("label"), "frame": get("frame"), "observed_in": every("observed-in")} | where
    elif tag == "edge":
        ends = [a.value for a in one["vertices"].items[1:]] if "vertices" in one else []
        yield "edges", {"id": name, "label": get("label"), "frame": get("frame"), "start": ends[0] if ends else None, "end": ends[1] if len(ends) > 1 else None, "backed_by": every("backed-by"), "observed_in": every("observed-in")} | where
    elif tag == "loop":
        yield "loops", {"id": name, "label": get("label"), "frame": get("frame"), "edges": [a.value for a in one["edges"].items[1:]] if "edges" in one else [], "observed_in": every("observed-in")} | where
    if tag in sexpr.CLAIM_HOLDERS and name is not None:
        for c in children:
            at = {"path": path, "line": c.line, "col": c.column}
            if c.tag == "assert" and len(c.items) > 1:
                yield "assertions", {"subject": name, "form": tag, "check": c.items[1].value, "params": _params(c.items[2:])} | at
            elif c.tag not in sexpr.CHILDREN[tag]:
                claim = _claim(name, c)
                if claim is not None:
                    yield "claims", claim | at
                else:
                    yield "plain_values", {"subject": name, "predicate": c.tag, "value": _value(c.items[1:])} | at


@dataclass
class Model:
    """The named tables of one model, all lazy."""

    tables: dict[str, DataFrame]

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    @property
    def live_claims(self) -> DataFrame:
        """Claims as ``resolution`` reads them: sigma of the terms, null if there are none or their units differ."""
        terms = F.coalesce("accuracy", F.array())
        part = lambda kind: F.filter(terms, lambda t: t["kind"] == kind)
        square = F.aggregate(part("independent"), F.lit(0.0), lambda a, t: a + t["magnitude"] * t["magnitude"])
        by_source = F.array_distinct(F.transform(part("systematic"), lambda t: t["source"]))
        largest = F.transform(by_source, lambda s: F.array_max(F.transform(F.filter(part("systematic"), lambda t: t["source"] == s), lambda t: F.abs(t["magnitude"]))))
        linear = F.aggregate(largest, F.lit(0.0), lambda a, m: a + m)
        units = F.array_distinct(F.transform(terms, lambda t: t["unit"]))
        known = F.size(units) == 1
        return self.claims.withColumns({"sigma": F.when(known, F.sqrt(square + linear * linear)), "day": F.to_date("day"), "live": F.col("rank") != "deprecated"}).withColumn("unit", F.when(known, units[0]))

    def ids(self) -> DataFrame:
        parts = [self.nodes.select("id"), self.vertices.select("id"), self.edges.select("id"), self.loops.select("id"), self.frames.select(F.col("frame").alias("id")), self.claims.where("id is not null").select("id")]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out

    def references(self) -> dict[str, DataFrame]:
        """All references by relation, as (source, target)."""
        pair = lambda t, s, c: t.where(F.col(c).isNotNull()).select(F.col(s).alias("source"), F.col(c).alias("target"))
        many = lambda t, s, c: t.select(F.col(s).alias("source"), F.explode(c).alias("target"))
        return {
            "within": pair(self.nodes, "id", "within"), "member-of": many(self.nodes, "id", "member_of"), "boundary": many(self.nodes, "id", "boundary"),
            "vertices": pair(self.edges, "id", "start").unionAll(pair(self.edges, "id", "end")), "edges": many(self.loops, "id", "edges"), "backed-by": many(self.edges, "id", "backed_by"),
            "parent": pair(self.frames, "frame", "parent"), "transform": pair(self.frames, "frame", "transform_claim"), "superseded-by": pair(self.claims, "subject", "superseded_by"),
            "frame": pair(self.nodes, "id", "frame").unionAll(pair(self.vertices, "id", "frame")).unionAll(pair(self.edges, "id", "frame")).unionAll(pair(self.loops, "id", "frame")),
        }

    def faults(self) -> DataFrame:
        """Everything that is wrong: (severity, subject, message)."""
        fault = lambda df, subject, message: df.select(F.lit("error").alias("severity"), F.col(subject).alias("subject"), message.alias("message"))
        parts = [self.diagnostics.select("severity", F.concat_ws(":", "path", "line").alias("subject"), "message")]
        parts.append(fault(graph.dangling(self.references(), self.ids()), "source", F.concat(F.col("relation"), F.lit(" names nothing: "), F.col("target"))))
        families = {"node": self.nodes, "vertex": self.vertices, "edge": self.edges, "loop": self.loops, "frame": self.frames.withColumnRenamed("frame", "id"), "claim": self.claims.where("id is not null")}
        parts.append(fault(graph.duplicates({k: t.select("id") for k, t in families.items()}), "id", F.concat(F.lit("declared more than once: "), F.col("families"))))
        declared = self.predicates.select(F.col("name").alias("predicate"), "shape", F.col("unit").alias("declared_unit"), "dimension", "claim_bearing")
        claims = self.claims.join(declared, "predicate", "left")
        parts.append(fault(claims.where("shape is null"), "subject", F.concat(F.lit("undeclared predicate "), F.col("predicate"))))
        parts.append(fault(claims.where("shape is not null and value.shape <> shape"), "subject", F.concat(F.col("predicate"), F.lit(" takes a "), F.col("shape"))))
        parts.append(fault(claims.where("rank = 'deprecated' and superseded_by is null"), "subject", F.concat(F.lit("deprecated without a replacement: "), F.col("predicate"))))
        sized = claims.where("shape = value.shape and shape in ('scalar', 'coordinate')")
        parts.append(fault(sized.where("not value.unit <=> declared_unit"), "subject", F.concat(F.col("predicate"), F.lit(" is written in "), F.coalesce("declared_unit", F.lit("no unit")))))
        parts.append(fault(sized.where("size(value.coord) <> dimension"), "subject", F.concat(F.col("predicate"), F.lit(" has components: "), F.col("dimension").cast("string"))))
        plain = self.plain_values.join(declared, "predicate", "left")
        parts.append(fault(plain.where("claim_bearing is null or claim_bearing"), "subject", F.concat(F.lit("a bare value where a claim belongs: "), F.col("predicate"))))
        types = self.types.select(F.col("name").alias("type"), "kinds", "geometries")
        typed = self.nodes.join(types, "type", "left")
        parts.append(fault(typed.where("kinds is null"), "id", F.concat(F.lit("undeclared type "), F.col("type"))))
        parts.append(fault(typed.where("not array_contains(kinds, kind) or not array_contains(geometries, coalesce(geometry, 'absent'))"), "id", F.concat(F.lit("kind or geometry not permitted by "), F.col("type"))))
        parts.append(fault(lookup.misplaced(self.nodes.select("id", "kind", "within")), "id", F.concat(F.lit("may not be within a "), F.col("parent_kind"))))
        parts.append(fault(self.edges.where("start = end"), "id", F.lit("an edge from a vertex to itself")))
        framed = lambda t, c: t.select(F.col("id").alias(c), F.col("frame").alias("other")).dropDuplicates([c])
        ends = self.edges.select("id", "frame", F.explode(F.array("start", "end")).alias("vertex")).join(framed(self.vertices, "vertex"), "vertex")
        sides = self.loops.select("id", "frame", F.explode("edges").alias("edge")).join(framed(self.edges, "edge"), "edge")
        for shape, part in ((ends, "vertex"), (sides, "edge")):
            parts.append(fault(shape.where("frame <> other"), "id", F.concat(F.lit("in another frame: "), F.col(part))))
        arrows = {"containment": (self.nodes, "id", "within"), "frames": (self.frames, "frame", "parent"), "supersession": (self.claims, "id", "superseded_by")}
        for name, (table, source, target) in arrows.items():
            pairs = table.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.col(source).alias("source"), F.col(target).alias("target"))
            parts.append(fault(graph.rings(pairs), "id", F.concat(F.lit(f"a cycle of {name}: "), F.col("names"))))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out


def read_files(spark: SparkSession, root: str, extension: str = "dfc") -> DataFrame:
    """(path, text) of all files of a tree."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", True).load(root)
    return found.select("path", F.decode("content", "UTF-8").alias("text"))


def load_model(spark: SparkSession, root: str, keep: bool = True, extension: str = "dfc") -> Model:
    """The model of all ``.dfc`` files below a folder; with ``keep`` the parsed rows are written, by table, as every table reads them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = (row for path, text in zip(frame["path"], frame["text"], strict=True) for row in rows_of(path, text, json.dumps))
            while part := list(islice(rows, SLICE)):
                yield pd.DataFrame(part, columns=["table", "row"])

    forms = read_files(spark, root, extension).mapInPandas(run, "table string, row string")
    if keep:
        path = f"{shared_dir(spark)}/ledgerline/forms-{uuid.uuid4().hex}"
        forms.write.option("compression", "zstd").partitionBy("table").parquet(path)
        forms = spark.read.schema("row string, table string").parquet(path)
    return Model({name: forms.where(F.col("table") == name).select(F.from_json("row", f"{schema}, {_WHERE}").alias("r")).select("r.*") for name, schema in SCHEMAS.items()})


def formatted(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, canonical, fault) of all files: their one canonical printing, and whether they are it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                try:
                    rows.append((path, text, sexpr.formatted(text), None))
                except sexpr.SyntaxFault as e:
                    rows.append((path, text, None, f"{e.line}:{e.column}: {e.message}"))
            yield pd.DataFrame(rows, columns=["path", "text", "canonical", "fault"])

    return read_files(spark, root).mapInPandas(run, "path string, text string, canonical string, fault string")


def is_id(text: str) -> bool:
    return re.fullmatch(r"[A-Za-z][A-Za-z0-9_-]*:[^\s\"();']+", text) is not None
