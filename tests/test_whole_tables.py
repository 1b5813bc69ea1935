"""Queries over whole tables against brute force on a small fixture that the slices of the other queries would empty."""

from collections import defaultdict

from ledgerline.plans import driver_queries as q


def test_operators_read_every_row(spark, tmp_path):
    lines = [(k % 13, k, k % 7, k % 5, float(k % 40)) for k in range(90)]
    orders = [(k, k % 4, "5-LOW") for k in range(14)]
    parts = [(k, f"t{k % 3}") for k in range(8)]
    for name, rows, schema in (
        ("lineitem", lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"),
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderpriority string"), ("part", parts, "p_partkey long, p_type string"),
        ("region", [(0,)], "r_regionkey long"), ("nation", [(0, 0), (1, 0)], "n_nationkey long, n_regionkey long"), ("customer", [(k, k % 2) for k in range(4)], "c_custkey long, c_nationkey long"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = lambda f: sorted(map(tuple, f(spark, str(tmp_path)).collect()))
    types, near, zones, members = defaultdict(int), defaultdict(set), defaultdict(set), defaultdict(set)
    for _, _, part, _, _ in lines:
        types[parts[part][1]] += 1
    for order, _, part, a, _ in lines:
        zones[orders[order][1]].add(part)
        members[part].add(orders[order][1])
        for _, _, other, b, _ in lines:
            if part == other and a != b:
                near[a, b].add(part)
    nested = [(o, sorted(x[1:3] for x in lines if x[0] == o)) for o, _, _ in orders]
    assert rows(q.list_types) == sorted(types.items())
    assert rows(q.get_nested) == [(o, len(own), ",".join(f"{n}/{p}" for n, p in own) if own else None) for o, own in nested]
    assert rows(q.adjacent) == sorted((a, b, ",".join(map(str, sorted(v)))) for (a, b), v in near.items())
    assert rows(q.zones) == sorted((k, ",".join(sorted(map(str, v)))) for k, v in zones.items())
    assert rows(q.members) == sorted((k, len(v), min(v)) for k, v in members.items())
    assert len(rows(q.containment_closure)) == 2 + 2 * 4 + 3 * 14
