"""Commands over a model folder: one JSON object on stdout, the exit code says how it went.

0 answered, 1 nothing found, 2 not used as meant, 3 refused, 4 ambiguous, 5 ambiguous where that is an error.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import __version__
from ledgerline.operators import lookup, resolution
from ledgerline.plans import model_queries as q
from ledgerline.sources import author, entity, exports

COMMANDS = {
    "version": [], "fmt": ["--check"], "list-types": [], "list-instances": ["type?", "--kind", "--frame", "--retired"], "list-geometry": ["--predicate", "--family"], "get": ["id"],
    "resolve": ["id", "predicate"], "traverse": ["id", "relation", "--depth", "--kind", "--type"], "claims": ["id", "predicate?"], "conflicts": ["--predicate", "--ambiguous"], "route": ["id"],
    "measure": ["id"], "tessellate": ["points"], "buildable": ["--setback"], "site": ["id", "plot"], "plan": ["id"], "export": [], "export-map": ["--srs"], "check": ["--only"], "review": ["base", "--annotate"], "apply": ["batch", "--dry-run"],
}
_SWITCHES = {"--check", "--retired", "--ambiguous", "--annotate", "--dry-run"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ledgerline", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, arguments in [*COMMANDS.items(), *((op, ["members"]) for op in author.OPERATIONS)]:
        p = sub.add_parser(name)
        p.add_argument("--root", default=".")
        p.add_argument("--position", default="position")
        p.add_argument("--tolerance", type=float, default=1e-3)
        for a in arguments:
            if a in _SWITCHES:
                p.add_argument(a, action="store_true")
            elif a.endswith("?"):
                p.add_argument(a[:-1], nargs="?")
            else:
                p.add_argument(a)
    return top


def _rows(df: DataFrame, *order: str) -> list[dict]:
    return [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).collect()]


def run(spark: SparkSession, argv: list[str]) -> tuple[int, str]:
    """Exit code and output of a command."""
    a = parser().parse_args(argv)
    name = a.command
    if name == "version":
        return 0, exports.envelope(name, {"version": __version__})
    if name in ("apply", *author.OPERATIONS):
        batch = open(a.batch, encoding="utf-8").read() if name == "apply" else json.dumps({"operations": [{"op": name} | json.loads(a.members)]})
        try:
            changed, notices = author.apply(spark, a.root, batch, dry_run=getattr(a, "dry_run", False))
        except author.Refused as e:
            return 3, exports.envelope(name, {"refused": str(e)})
        return 0, exports.envelope(name, {"files": sorted(changed), "notices": notices})
    if name == "fmt":
        found = entity.formatted(spark, a.root).where("fault is not null or text <> canonical").select("path", "fault").orderBy("path")
        rows = _rows(found)
        return (3 if rows and a.check else 0), exports.envelope(name, rows)
    if name == "tessellate":
        start, end, centre, through = json.loads(a.points)
        return 0, exports.envelope(name, q.tessellate(start, end, centre, through, a.tolerance))
    model = entity.load_model(spark, a.root)
    faults = _rows(model.faults().where("severity = 'error'"), "subject", "message")
    if faults:
        return 3, exports.envelope("faults", faults)
    if name == "list-types":
        out = _rows(lookup.list_types(model.types.select("name", "description"), model.nodes), "name")
    elif name == "list-instances":
        out = _rows(lookup.list_instances(model.nodes.select("id", "label", "kind", "type", "frame", "retired"), a.type, a.kind, a.frame, a.retired).drop("retired"), "id")
    elif name == "list-geometry":
        held = lookup.carrying(q.entities(model), model.live_claims, a.predicate)
        out = _rows(held if a.family is None else held.where(F.col("family") == a.family), "id")
    elif name == "get":
        out = _rows(q.get(model, a.id))
    elif name == "resolve":
        asked = spark.createDataFrame([(a.id, a.predicate)], "subject string, predicate string")
        row = resolution.strict(resolution.resolve(model.live_claims, asked), model.predicates).first()
        answer = _rows(q.resolved(model, a.predicate).where(F.col("subject") == a.id))
        return row.status, exports.envelope(name, {"reason": row.reason, "candidates": row.n_candidates, "answer": answer[0] if answer else None})
    elif name == "traverse":
        out = _rows(q.traverse(model, a.id, a.relation, int(a.depth) if a.depth not in (None, "all") else None, a.kind, a.type))
    elif name == "claims":
        own = resolution.audit(model.live_claims).where(F.col("subject") == a.id)
        out = _rows(own if a.predicate is None else own.where(F.col("predicate") == a.predicate), "predicate", "path", "line")
    elif name == "conflicts":
        found = resolution.conflicts(model.live_claims, True if a.ambiguous else None)
        out = _rows(found if a.predicate is None else found.where(F.col("predicate") == a.predicate), "subject", "predicate")
    elif name == "route":
        nodes = model.nodes.where(F.col("id") == a.id).select("id", F.substring_index("id", ":", 1).alias("namespace"), "kind", "type")
        out = _rows(lookup.routed(nodes, model.routes))
    elif name == "measure":
        out = _rows(q.measure(model, a.position, a.tolerance).where(F.col("id") == a.id))
    elif name == "buildable":
        out = _rows(q.buildable_of(model, a.position, a.setback, a.tolerance), "figure")
    elif name == "site":
        from ledgerline.operators import regions

        figs = q.figures(model, a.position, a.tolerance)
        shape = figs.where(F.col("figure") == a.id).select("figure", F.lit(a.plot).alias("plot"), "rings", F.col("corner_sigma").alias("sigma"))
        out = _rows(regions.siting(shape, figs.where(F.col("figure") == a.plot), a.tolerance, 0.0))
    elif name == "plan":
        out = _rows(q.plan_of(model, a.id, a.position, a.tolerance))
    elif name == "export":
        drawn = model.nodes.join(q.figures(model, a.position, a.tolerance).select(F.col("figure").alias("id"), "rings"), "id", "left")
        nodes = [r.asDict(recursive=True) | {"rings": [[(p.x, p.y) for p in ring] for ring in r.rings] if r.rings else None} for r in drawn.select("id", "label", "kind", "type", "within", "rings").orderBy("id").toLocalIterator()]
        zones = [(r.zone, r.id) for r in model.nodes.select("id", F.explode("member_of").alias("zone")).collect()]
        project = model.project.first()
        text, odd = exports.ifc(nodes, project.label or "", project.globalid_namespace, zones)
        return 0, exports.envelope(name, {"ifc": text, "unsupported": odd})
    elif name == "export-map":
        drawn = model.nodes.select("id", "label", "kind", "type", "within", "frame").join(q.figures(model, a.position, a.tolerance).select(F.col("figure").alias("id"), "rings"), "id")
        found = exports.features(drawn, "model", a.srs or "", ["label", "kind", "type", "within", "frame"])
        return 0, exports.envelope(name, "\n".join(exports.gml(found, "model", model.project.first().globalid_namespace, a.srs or "")))
    elif name == "check":
        violations, tallies = q.check(model, a.position, a.tolerance, a.only.split(",") if a.only else None)
        bad = _rows(violations, "check", "subject")
        return (3 if bad else 0), exports.envelope(name, {"violations": bad, "tallies": _rows(tallies, "check")})
    else:
        found = q.compare(entity.load_model(spark, a.base), model)
        if a.annotate:
            return 0, exports.annotations(found)
        rows = _rows(found)
        return (3 if any(r["ruling"] == "failure" for r in rows) else 0), exports.envelope(name, rows)
    return (0 if out else 1), exports.envelope(name, out)


def main() -> None:
    spark = SparkSession.builder.appName("ledgerline").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    code, text = run(spark, sys.argv[1:])
    print(text)
    sys.exit(code)


if __name__ == "__main__":
    main()
