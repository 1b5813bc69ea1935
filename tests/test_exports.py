"""GML, IFC, envelopes and the cache."""

import re
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import regions
from ledgerline.sources import exports

PLATE = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(3.0, 3.0), (3.0, 7.0), (7.0, 7.0), (7.0, 3.0)]]


def test_gml(spark, tmp_path):
    corners = spark.createDataFrame([("site:P 1", r, k, x, y) for r, ring in enumerate(PLATE) for k, (x, y) in enumerate(ring)], "figure string, ring int, ord int, x double, y double")
    drawn = regions.figures(corners, 1e-6).withColumnRenamed("figure", "id").withColumn("label", F.lit('the "yard" & <shed>')).withColumn("kind", F.lit(None).cast("string"))
    text = "\n".join(exports.gml(exports.features(drawn, "yard", "EPSG:1", ["label", "kind"]), "yard", "https://example.org/y", "EPSG:1"))
    tree = ET.fromstring(text)
    g = "{http://www.opengis.net/gml/3.2}"
    rings = [r.text for r in tree.iter(f"{g}posList")]
    assert rings == ["0 0 10 0 10 10 0 10 0 0", "3 3 3 7 7 7 7 3 3 3"] and len(list(tree.iter(f"{g}interior"))) == 1
    assert tree.find(f".//{g}upperCorner").text == "10 10" and 'gml:id="site.P_1"' in text
    assert "the &quot;" not in text and "&amp; &lt;shed&gt;" in text and "kind" not in text
    with pytest.raises(ValueError, match="geometry"):
        exports.feature("y", "a:b", {"geometry": "x"}, PLATE, "EPSG:1")


def test_ifc():
    nodes = [
        {"id": "s:S", "kind": "Site", "label": "Plot 'one'", "type": "Plot", "within": None, "rings": PLATE, "datum": 0.0},
        {"id": "s:B", "kind": "Building", "type": "Block", "within": "s:S", "label": "Bâtiment"},
        {"id": "s:L", "kind": "Storey", "type": "Floor", "within": "s:B", "datum": 3.0},
        {"id": "s:R", "kind": "Space", "type": "Room", "within": "s:L", "rings": PLATE[:1], "height": 2.5, "datum": 3.0, "claims": [("width", "3.5 m", "tape")]},
        {"id": "s:W", "kind": "Element", "type": "Partition", "within": "s:R", "ifc": "IfcWall"},
        {"id": "s:X", "kind": "Element", "type": "Thing", "within": "s:R", "ifc": "IfcUnheardOf"},
        {"id": "s:Z", "kind": "Zone", "type": "Fire", "label": "Zone"},
    ]
    text, odd = exports.ifc(nodes, "Yard", "https://example.org/y", [("s:Z", "s:R")])
    assert odd == ["s:X: IfcUnheardOf"] and text == exports.ifc(nodes[::-1], "Yard", "https://example.org/y", [("s:Z", "s:R")])[0]
    lines = dict(re.match(r"(#\d+)=(.*);", x).groups() for x in text.split("\n") if x.startswith("#"))
    assert all(set(re.findall(r"#\d+", v)) <= set(lines) for v in lines.values())
    kinds = [v.split("(")[0] for v in lines.values()]
    assert kinds.count("IFCRELAGGREGATES") == 4 and kinds.count("IFCRELCONTAINEDINSPATIALSTRUCTURE") == 1 and kinds.count("IFCEXTRUDEDAREASOLID") == 1
    assert kinds.count("IFCBUILDINGELEMENTPROXY") == kinds.count("IFCWALL") == kinds.count("IFCZONE") == kinds.count("IFCPROPERTYSET") == 1
    assert "'Plot ''one'''" in text and "'B\\X2\\00E2\\X0\\timent'" in text and "(0.,0.,3.)" in text
    wall = next(v for v in lines.values() if v.startswith("IFCWALL("))
    assert wall.count(",") == 8
    assert exports.step_real(1e-7) == "1.E-07" and exports.step_real(2.0) == "2." and exports.step_real(0.25) == "0.25"


def test_envelopes_and_cache(spark, tmp_path):
    assert exports.envelope("a", {"b": 1, "a": None}) == '{"kind":"a","result":{"a":null,"b":1},"version":1}'
    cache = exports.Cache(spark, f"file://{tmp_path}")
    assert cache.lookup("footprints", "d1") is None
    cache.store("footprints", "d1", spark.range(3))
    cache.store("footprints", "d2", spark.range(4))
    assert cache.lookup("footprints", "d1").count() == 3 and cache.prune("footprints", "d2") == 1
    assert cache.lookup("footprints", "d1") is None and cache.lookup("footprints", "d2").count() == 4
    found = spark.createDataFrame([("id-disappeared", "a", "warning"), ("claim", "b", "failure")], "kind string, subject string, ruling string")
    assert exports.annotations(found).split("\n")[2:4] == ["- **failure** claim: `b`", "- **warning** id-disappeared: `a`"]
