"""Exports: GML 3.2 feature collections, IFC4 STEP files, JSON envelopes and a content-addressed cache.

Features are rendered where they are, one row a feature; a document is written from them in id order, row by
row, so the driver never holds it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.units import global_id
from ledgerline.kernels import plane

# GML.


def number(value: float) -> str:
    if not math.isfinite(value):
        raise ValueError("a coordinate that is no number")
    text = repr(float(value))
    return text[:-2] if text.endswith(".0") else text


def xml_name(id_: str) -> str:
    """An id as an XML name: its colons become dots."""
    name = "".join(c if c.isalnum() or c in "-_." else "_" if c != ":" else "." for c in id_)
    return name if name[:1].isalpha() or name[:1] == "_" else "_" + name


def _ring(ring: plane.Ring, pad: str) -> list[str]:
    closed = [*ring, ring[0]]
    text = " ".join(number(c) for p in closed for c in p)
    return [f"{pad}<gml:LinearRing>", f"{pad}  <gml:posList>{text}</gml:posList>", f"{pad}</gml:LinearRing>"]


def feature(prefix: str, id_: str, properties: dict[str, str | None], figure: plane.Figure, srs: str) -> str:
    """One feature member with its pieces as polygons."""
    if "geometry" in properties:
        raise ValueError("a property may not be named geometry")
    name = xml_name(id_)
    out = ["  <gml:featureMember>", f'    <{prefix}:region gml:id="{name}">', f"      <{prefix}:id>{escape(id_)}</{prefix}:id>"]
    out += [f"      <{prefix}:{k}>{escape(v)}</{prefix}:{k}>" for k, v in properties.items() if v is not None]
    out += [f"      <{prefix}:geometry>", f'        <gml:MultiSurface gml:id="{name}.geometry" srsName="{escape(srs)}" srsDimension="2">']
    for n, (outer, holes) in enumerate(plane.pieces(figure), 1):
        out += ["          <gml:surfaceMember>", f'            <gml:Polygon gml:id="{name}.surface.{n}">', "              <gml:exterior>", *_ring(outer, " " * 16), "              </gml:exterior>"]
        for hole in holes:
            out += ["              <gml:interior>", *_ring(hole, " " * 16), "              </gml:interior>"]
        out += ["            </gml:Polygon>", "          </gml:surfaceMember>"]
    out += ["        </gml:MultiSurface>", f"      </{prefix}:geometry>", f"    </{prefix}:region>", "  </gml:featureMember>"]
    return "\n".join(out)


def features(drawn: DataFrame, prefix: str, srs: str, properties: list[str]) -> DataFrame:
    """(id, xml, minx, miny, maxx, maxy) of rows (id, rings, properties...) that have rings."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                figure = [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]]
                xs, ys = zip(*(p for ring in figure for p in ring), strict=True)
                rows.append((r["id"], feature(prefix, r["id"], {k: r[k] for k in properties}, figure, srs), min(xs), min(ys), max(xs), max(ys)))
            yield pd.DataFrame(rows, columns=["id", "xml", "minx", "miny", "maxx", "maxy"])

    return drawn.where("rings is not null").select("id", "rings", *properties).mapInPandas(run, "id string, xml string, minx double, miny double, maxx double, maxy double")


def gml(found: DataFrame, prefix: str, namespace: str, srs: str) -> Iterator[str]:
    """The lines of a feature collection, in id order."""
    e = found.agg(*[f(c).alias(c) for c, f in (("minx", F.min), ("miny", F.min), ("maxx", F.max), ("maxy", F.max))]).first()
    yield '<?xml version="1.0" encoding="UTF-8"?>'
    yield f'<{prefix}:FeatureCollection xmlns:{prefix}="{escape(namespace)}" xmlns:gml="http://www.opengis.net/gml/3.2" gml:id="{prefix}">'
    if e.minx is not None:
        yield f'  <gml:boundedBy>\n    <gml:Envelope srsName="{escape(srs)}" srsDimension="2">'
        yield f"      <gml:lowerCorner>{number(e.minx)} {number(e.miny)}</gml:lowerCorner>\n      <gml:upperCorner>{number(e.maxx)} {number(e.maxy)}</gml:upperCorner>"
        yield "    </gml:Envelope>\n  </gml:boundedBy>"
    for r in found.select("id", "xml").orderBy("id").toLocalIterator():
        yield r.xml
    yield f"</{prefix}:FeatureCollection>"


# IFC.

# The entity of each kind, and the number of attributes after the eighth.
SPATIAL = {"Site": ("IFCSITE", 6), "Building": ("IFCBUILDING", 4), "Storey": ("IFCBUILDINGSTOREY", 2), "Space": ("IFCSPACE", 3)}
ELEMENTS = {"IfcWall": 1, "IfcDoor": 5, "IfcWindow": 5, "IfcSlab": 1, "IfcColumn": 1, "IfcBeam": 1, "IfcRailing": 1, "IfcRoof": 1, "IfcStair": 1, "IfcCovering": 1, "IfcFurnishingElement": 0, "IfcBuildingElementProxy": 1}


def step_string(text: str | None) -> str:
    """A string of a STEP file: quotes doubled, what is not ASCII as UTF-16 code units."""
    if text is None:
        return "$"
    out, wide = [], ""
    for c in text:
        if 32 <= ord(c) < 127:
            if wide:
                out.append(f"\\X2\\{wide}\\X0\\")
                wide = ""
            out.append({"'": "''", "\\": "\\\\"}.get(c, c))
        else:
            wide += c.encode("utf-16-be").hex().upper()
    return "'" + "".join(out) + (f"\\X2\\{wide}\\X0\\" if wide else "") + "'"


def step_real(value: float) -> str:
    if not math.isfinite(value):
        raise ValueError("a number that is none")
    text = repr(float(value)).upper()
    return text.replace(".0E", ".E") if "E" in text and "." in text else text.replace("E", ".E") if "E" in text else text[:-1] if text.endswith(".0") else text


@dataclass
class Ifc:
    """A STEP file under construction; instances are numbered as they are written."""

    url: str
    lines: list[str] = field(default_factory=list)
    unsupported: list[str] = field(default_factory=list)

    def add(self, entity: str, *attributes: str) -> str:
        self.lines.append(f"#{len(self.lines) + 1}={entity}({','.join(attributes)});")
        return f"#{len(self.lines)}"

    def gid(self, id_: str) -> str:
        return f"'{global_id(self.url, id_)}'"

    def point(self, *p: float) -> str:
        return self.add("IFCCARTESIANPOINT", "(" + ",".join(map(step_real, p)) + ")")

    def polyline(self, ring: plane.Ring) -> str:
        points = [self.point(*p) for p in ring]
        return self.add("IFCPOLYLINE", f"({','.join([*points, points[0]])})")

    def placement(self, parent: str | None, z: float) -> str:
        return self.add("IFCLOCALPLACEMENT", parent or "$", self.add("IFCAXIS2PLACEMENT3D", self.point(0, 0, z), "$", "$"))

    def shape(self, figure: plane.Figure, height: float | None, plan: str, body: str) -> str:
        """A footprint, and where a height is known the body swept from it."""
        rings = [(self.polyline(outer), [self.polyline(h) for h in holes]) for outer, holes in plane.pieces(figure)]
        parts = [self.add("IFCSHAPEREPRESENTATION", plan, "'FootPrint'", "'Curve2D'", "(" + ",".join(c for outer, holes in rings for c in [outer, *holes]) + ")")]
        if height:
            up, solids = self.add("IFCDIRECTION", "(0.,0.,1.)"), []
            for outer, holes in rings:
                profile = self.add("IFCARBITRARYPROFILEDEFWITHVOIDS", ".AREA.", "$", outer, f"({','.join(holes)})") if holes else self.add("IFCARBITRARYCLOSEDPROFILEDEF", ".AREA.", "$", outer)
                solids.append(self.add("IFCEXTRUDEDAREASOLID", profile, self.add("IFCAXIS2PLACEMENT3D", self.point(0, 0, 0), "$", "$"), up, step_real(height)))
            parts.append(self.add("IFCSHAPEREPRESENTATION", body, "'Body'", "'SweptSolid'", f"({','.join(solids)})"))
        return self.add("IFCPRODUCTDEFINITIONSHAPE", "$", "$", f"({','.join(parts)})")


def ifc(nodes: list[dict], project: str, url: str, zones: list[tuple[str, str]] = (), name: str = "model.ifc") -> tuple[str, list[str]]:
    """An IFC4 file of nodes (id, label, kind, type, within, rings, height, datum, ifc, claims) in id order.

    ``ifc`` is the entity that the type's classification names: one that is not known here becomes a proxy and
    is reported. ``claims`` are (predicate, value, source) texts; ``zones`` are (zone, member).
    """
    out = Ifc(url)
    units = [out.add("IFCSIUNIT", "*", f".{k}.", "$", f".{u}.") for k, u in (("LENGTHUNIT", "METRE"), ("AREAUNIT", "SQUARE_METRE"), ("VOLUMEUNIT", "CUBIC_METRE"), ("PLANEANGLEUNIT", "RADIAN"))]
    assigned = out.add("IFCUNITASSIGNMENT", f"({','.join(units)})")
    axis = out.add("IFCAXIS2PLACEMENT3D", out.point(0, 0, 0), "$", "$")
    context = out.add("IFCGEOMETRICREPRESENTATIONCONTEXT", "$", "'Model'", "3", "0.00001", axis, "$")
    body, plan = (out.add("IFCGEOMETRICREPRESENTATIONSUBCONTEXT", f"'{n}'", "'Model'", "*", "*", "*", "*", context, "$", f".{v}_VIEW.") for n, v in (("Body", "MODEL"), ("FootPrint", "PLAN")))
    root = out.add("IFCPROJECT", out.gid(url), "$", step_string(project), "$", "$", step_string(project), "$", f"({context})", assigned)
    by, refs, places = {n["id"]: n for n in nodes}, {}, {}

    def ancestor(n: dict) -> dict | None:
        """The nearest spatial node that contains a node."""
        seen = set()
        while n.get("within") in by and n["within"] not in seen:
            seen.add(n["within"])
            n = by[n["within"]]
            if n["kind"] in SPATIAL:
                return n
        return None

    def write(n: dict) -> None:
        if n["id"] in refs or n["kind"] == "Zone":
            return
        up = ancestor(n)
        if up is not None:
            write(up)
        datum = (n.get("datum") or 0.0) - ((up or {}).get("datum") or 0.0) if n.get("datum") is not None else 0.0
        places[n["id"]] = out.placement(places.get(up["id"]) if up else None, datum)
        shape = out.shape(n["rings"], n.get("height"), plan, body) if n.get("rings") else "$"
        common = [out.gid(n["id"]), "$", step_string(n["id"]), "$", step_string(n.get("type")), places[n["id"]], shape, step_string(n.get("label"))]
        if n["kind"] in SPATIAL:
            entity, more = SPATIAL[n["kind"]]
            refs[n["id"]] = out.add(entity, *common, ".ELEMENT.", *["$"] * (more - 1))
        else:
            wanted = n.get("ifc")
            if wanted is not None and wanted not in ELEMENTS:
                out.unsupported.append(f"{n['id']}: {wanted}")
            entity = wanted if wanted in ELEMENTS else "IfcBuildingElementProxy"
            refs[n["id"]] = out.add(entity.upper(), *common[:7], step_string(n.get("label")), *["$"] * ELEMENTS[entity])
        if n.get("claims"):
            held = [out.add("IFCPROPERTYSINGLEVALUE", step_string(p), step_string(source), f"IFCTEXT({step_string(v)})", "$") for p, v, source in n["claims"]]
            made = out.add("IFCPROPERTYSET", out.gid(n["id"] + "#claims"), "$", "'Claims'", "$", f"({','.join(held)})")
            out.add("IFCRELDEFINESBYPROPERTIES", out.gid(n["id"] + "#defines"), "$", "$", "$", f"({refs[n['id']]})", made)

    for n in sorted(nodes, key=lambda n: n["id"]):
        write(n)
    nested: dict[str | None, list[str]] = {}
    held: dict[str | None, list[str]] = {}
    for n in sorted(nodes, key=lambda n: n["id"]):
        if n["id"] in refs:
            up = ancestor(n)
            (nested if n["kind"] in SPATIAL else held).setdefault(up["id"] if up else None, []).append(refs[n["id"]])
    for up, parts in nested.items():
        out.add("IFCRELAGGREGATES", out.gid(f"{up}#parts"), "$", "$", "$", refs.get(up, root), f"({','.join(parts)})")
    for up, parts in held.items():
        if up is not None:
            out.add("IFCRELCONTAINEDINSPATIALSTRUCTURE", out.gid(f"{up}#contents"), "$", "$", "$", f"({','.join(parts)})", refs[up])
    groups: dict[str, list[str]] = {}
    for zone, member in sorted(zones):
        if member in refs:
            groups.setdefault(zone, []).append(refs[member])
    for zone, members in groups.items():
        made = out.add("IFCZONE", out.gid(zone), "$", step_string(zone), "$", "$", step_string((by.get(zone) or {}).get("label")))
        out.add("IFCRELASSIGNSTOGROUP", out.gid(zone + "#members"), "$", "$", "$", f"({','.join(members)})", "$", made)
    head = ["ISO-10303-21;", "HEADER;", "FILE_DESCRIPTION(('ViewDefinition [CoordinationView]'),'2;1');", f"FILE_NAME({step_string(name)},'1970-01-01T00:00:00',(''),(''),'ledgerline','ledgerline','');", "FILE_SCHEMA(('IFC4'));", "ENDSEC;", "DATA;"]
    return "\n".join([*head, *out.lines, "ENDSEC;", "END-ISO-10303-21;"]) + "\n", out.unsupported


# Envelopes and caches.


def envelope(kind: str, result: object, version: int = 1) -> str:
    """One JSON object, the same for the same answer."""
    return json.dumps({"version": version, "kind": kind, "result": result}, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


class Cache:
    """Derived tables by the digest of what they derive from; only complete ones are found."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str, digest: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" + (f"/digest={digest}" if digest else ""))

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def lookup(self, name: str, digest: str) -> DataFrame | None:
        path = self._path(name, digest)
        done = self.spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
        return self.spark.read.parquet(path.toString()) if self._fs().exists(done) else None

    def store(self, name: str, digest: str, rows: DataFrame) -> DataFrame:
        path = self._path(name, digest).toString()
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def prune(self, name: str, digest: str) -> int:
        """Drop every generation but one; returns how many went."""
        fs, gone = self._fs(), 0
        if fs.exists(self._path(name)):
            for status in fs.listStatus(self._path(name)):
                if status.getPath().getName() != f"digest={digest}":
                    fs.delete(status.getPath(), True)
                    gone += 1
        return gone


def annotations(findings: DataFrame) -> str:
    """Findings as a Markdown list, most serious first."""
    rows = sorted(findings.select("kind", "subject", "ruling").collect(), key=lambda r: (r.ruling != "failure", r.kind, r.subject))
    return "\n".join(["## Review", "", *(f"- **{r.ruling}** {r.kind}: `{r.subject}`" for r in rows)]) + "\n" if rows else "## Review\n\nNothing found.\n"
