"""The text format: positions, faults, canonical printing, and models as tables."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.operators import resolution
from ledgerline.sources import entity, sexpr

REGISTRY = """
(project (globalid-namespace "https://example.org/m") (label "Yard"))
(namespace site (description "Nodes")) (namespace m (description "Methods"))
(type Room (kind Space) (geometry area) (description "A room") (invariant boundary-loops-close (tolerance close)))
(type Floor (kind Storey) (geometry absent) (geometry area) (description "A floor"))
(predicate width (unit m) (shape scalar) (claim-bearing #t))
(predicate colour (shape text) (claim-bearing #f))
(tolerance close (value 0.50 m))
(frame site:grid (unit m))
"""
NODES = """
; the room above the yard
(node site:R1 (type Room) (kind Space) (geometry area) (within site:F1) (frame site:grid) (colour "slate")
  (width (value 3.60 m) (date "2026-03-02") (source "Drawing 1") (method m:tape) (accuracy (independent 0.01 m)))
  (width (value 3.62 m) (source "Drawing 2") (method m:tape) (date "2026-04-02") (accuracy (systematic 0.003 m site:cp) (independent 0.004 m))))
(node site:F1 (kind Storey) (type Floor))
"""


def test_parse_positions_and_comments():
    forms, trailing = sexpr.parse('; first\n(a "x\\n\\u00e9" 1.5 -2 #t\n  (b c)) ; end\n')
    assert forms[0].comments == ["; first"] and trailing == ["; end"]
    assert [(i.line, i.column) for i in forms[0].items] == [(2, 2), (2, 4), (2, 16), (2, 20), (2, 23), (3, 3)]
    assert [i.value for i in forms[0].items[1:5]] == ["x\né", 1.5, -2, True]


@pytest.mark.parametrize(
    ("text", "line", "message"),
    [("(a\n (b", 2, "never closed"), ("()", 1, "empty"), ("(a . b)", 1, "dotted"), ("(a 'b)", 1, "quotation"), ("(a nil)", 1, "nil"), ("(a 12abc)", 1, "number"), ("(a 2026-03-14)", 1, "number"), ('(a "x', 1, "never closed"), ('(a "\\q")', 1, "escape"), ("(a))", 1, "nothing opened"), ("a", 1, "forms only"), ("(a #| x", 1, "comment")],
)
def test_faults_have_positions(text, line, message):
    with pytest.raises(sexpr.SyntaxFault, match=message) as e:
        sexpr.parse(text)
    assert e.value.line == line


def test_shape_faults_and_suggestions():
    forms, _ = sexpr.parse('(nod site:a) (node site:b (kind Space) (kind Space)) (namespace n (descripton "x"))')
    messages = [m for _, _, m in sexpr.validate(forms)]
    assert messages == ["unknown form nod, did you mean node?", "kind is written twice in node, first in line 1", "node lacks type", "unknown child descripton of namespace, did you mean description?", "namespace lacks description"]


def test_canonical_text():
    text = sexpr.formatted(REGISTRY + NODES)
    assert sexpr.formatted(text) == text and text.endswith(")\n")
    assert text.index("(namespace m") < text.index("(namespace site") < text.index("(tolerance ") < text.index("(frame site:grid") < text.index("(node site:F1 (kind Storey)") < text.index("(node\n  site:R1\n")
    assert "claim-bearing #t" not in text and "(value 0.5 m)" in text and "; the room above the yard\n(node\n" in text
    assert "(accuracy (independent 0.004 m) (systematic 0.003 m site:cp))" in text
    assert all(len(line) <= 80 for line in text.split("\n"))
    assert sexpr.formatted("") == "" and sexpr.formatted("; only\n") == "; only\n"


atoms = st.one_of(st.sampled_from(["a", "b-c", "x:y", "+", "é"]).map(lambda s: sexpr.Atom("symbol", s)), st.floats(allow_nan=False, allow_infinity=False).map(lambda f: sexpr.Atom("real", f)), st.integers(-99, 99).map(lambda i: sexpr.Atom("integer", i)), st.text(max_size=12).filter(lambda s: all(not 0xD800 <= ord(c) < 0xE000 for c in s)).map(lambda s: sexpr.Atom("string", s)), st.booleans().map(lambda b: sexpr.Atom("boolean", b)))
data = st.recursive(atoms, lambda inner: st.lists(inner, min_size=0, max_size=5).map(lambda xs: sexpr.List([sexpr.Atom("symbol", "t"), *xs])), max_leaves=25)


@settings(max_examples=200, deadline=None)
@given(st.lists(data.filter(lambda d: isinstance(d, sexpr.List)), max_size=4))
def test_printing_is_a_fixed_point(forms):
    text = sexpr.printed(forms)
    assert sexpr.formatted(text) == text


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("model")
    (root / "registry").mkdir()
    (root / "registry" / "r.dfc").write_text(REGISTRY)
    (root / "nodes.dfc").write_text(NODES)
    (root / "notes.txt").write_text("(not read")
    return entity.load_model(spark, f"file://{root}")


def test_a_model_is_tables(model):
    assert {r.id: (r.kind, r.within) for r in model.nodes.collect()} == {"site:R1": ("Space", "site:F1"), "site:F1": ("Storey", None)}
    assert model.plain_values.first().value.text == "slate"
    assert model.tolerances.first().value == 0.5
    assert [r.check for r in model.types.where("name = 'Room'").first().invariants] == ["boundary-loops-close"]
    assert model.faults().count() == 0
    row = resolution.resolve(model.live_claims).first()
    assert (row.subject, row.reason, row.n_live) == ("site:R1", "accuracy", 2) and row.sigma == pytest.approx(0.005)


def test_faults_of_a_model(spark, tmp_path):
    (tmp_path / "a.dfc").write_text(REGISTRY + '(node site:R1 (kind Space) (type Room) (geometry line) (within site:R9) (width 8.5) (height (value "x") (source "s") (method m:t) (date "2026-01-01")))\n(node site:R1 (kind Storey) (type Hall))\n(edge site:E (frame site:grid) (vertices site:V site:V))')
    (tmp_path / "b.dfc").write_text("(node site:x")
    found = {(r.subject, r.message) for r in entity.load_model(spark, f"file://{tmp_path}").faults().collect()}
    messages = {m for _, m in found}
    assert {"a bare value where a claim belongs: width", "undeclared predicate height", "within names nothing: site:R9", "vertices names nothing: site:V", "undeclared type Hall", "kind or geometry not permitted by Room", "declared more than once: node", "an edge from a vertex to itself", "a list that is never closed"} <= messages


def test_cycles_units_dimensions_and_frames_are_faults(spark, tmp_path):
    """Rings of containment, of frames and of supersession, wrong units and dimensions, and shapes in two frames."""
    by = '(source "s") (method m:t) (date "2026-01-01")'
    (tmp_path / "a.dfc").write_text("\n".join([
        REGISTRY, '(predicate at (unit m) (shape coordinate) (dimension 2)) (predicate high (unit m) (shape scalar))',
        '(frame frame:a (unit m) (parent frame:b)) (frame frame:b (unit m) (parent frame:a)) (frame frame:c (unit m) (parent frame:b))',
        *(f"(node site:{a} (kind Element) (type Room) (within site:{b}))" for a, b in ("XY", "YZ", "ZX", "TX", "SS")),
        f"(node site:Q (kind Space) (type Room) (high (value 1.0 ft) {by} (id c:1) (rank deprecated) (superseded-by c:2)) (high (value 1.0 m) {by} (id c:2) (rank deprecated) (superseded-by c:1)))",
        f"(vertex g:1 (frame frame:a) (at (value (1.0 2.0 3.0) m) {by}))(vertex g:2 (frame frame:c))(edge g:3 (frame frame:a) (vertices g:1 g:2))(loop g:4 (frame frame:b) (edges g:3))",
    ]))
    found = {(r.subject, r.message) for r in entity.load_model(spark, f"file://{tmp_path}").faults().collect()}
    assert {
        ("site:X", "a cycle of containment: site:X, site:Y, site:Z"), ("site:S", "a cycle of containment: site:S"), ("frame:a", "a cycle of frames: frame:a, frame:b"),
        ("c:1", "a cycle of supersession: c:1, c:2"), ("site:Q", "high is written in m"), ("g:1", "at has components: 2"), ("g:3", "in another frame: g:2"), ("g:4", "in another frame: g:3"),
    } <= found
    assert sum("cycle" in m for _, m in found) == 4


def test_a_file_is_parsed_form_by_form():
    """What is read of a file is held one form at a time; a file that can not be read to its end states nothing."""
    forms = sexpr.each("(node site:a) (node site:b) (node")
    assert next(forms).items[1].value == "site:a" and next(forms).items[1].value == "site:b"
    with pytest.raises(sexpr.SyntaxFault):
        next(forms)
    assert [(t, r["message"]) for t, r in entity.rows_of("x", "(node site:a (kind Space) (type T)) (node")] == [("diagnostics", "a list that is never closed")]


def test_files_of_the_table_model_keep_their_size(spark, tmp_path):
    """A file is parsed and printed whole, so ten times the suppliers are more files and not larger ones."""
    from ledgerline.plans import table_model

    for name in ("region", "nation"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.range(1000).selectExpr("id as s_suppkey", "id % 25 as s_nationkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    table_model._write(spark, str(tmp_path), False, f"file://{tmp_path}/model")
    sizes = [p.stat().st_size for p in (tmp_path / "model").glob("*.txt")]
    assert len(sizes) >= 10 and max(sizes) < 1_000_000


def test_formatting_a_tree(spark, tmp_path):
    (tmp_path / "a.dfc").write_text(sexpr.formatted(REGISTRY))
    (tmp_path / "b.dfc").write_text(REGISTRY)
    (tmp_path / "c.dfc").write_text("(")
    found = {r.path[-5:]: (r.text == r.canonical, r.fault) for r in entity.formatted(spark, f"file://{tmp_path}").collect()}
    assert found["a.dfc"] == (True, None) and found["b.dfc"] == (False, None) and found["c.dfc"][1] == "1:1: a list that is never closed"


def test_order_of_forms_does_not_matter():
    forms, _ = sexpr.parse(REGISTRY + NODES)
    want = sexpr.printed(forms)
    random.Random(1).shuffle(forms)
    assert sexpr.printed(forms) == want
