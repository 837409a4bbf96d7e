from pyspark.sql import functions as F

from tallyweave.operators import nested

RAW = "record_id long, body string, tx string, e int"


def raw(spark, bodies):
    return spark.createDataFrame([(i, b, "clash", 0) for i, b in enumerate(bodies)], RAW)


def places(spark, bodies, side):
    return sorted((r.record_id, r.tx_pos, r.item_pos) for r in nested.raw_children(raw(spark, bodies)).where(f"side = '{side}'").collect())


def test_wrappings(spark):
    one = '{"vin": [null, {"a": 1}], "out": {"addr": "x"}}'
    bodies = [one, f"[{one}, null, {one}]", f'{{"txs": [{one}]}}', f'{{"tx": {one}}}', f'{{"data": {{"items": [{{"tx": {one}}}, {{}}, {{"tx": {one}}}]}}}}', '{"txs": null}', '{"inputs": 5, "outputs": []}', '{"tx": "id", "vin": {}}']
    assert places(spark, bodies, "in") == [(0, 0, 1), (1, 0, 1), (1, 2, 1), (2, 0, 1), (3, 0, 1), (4, 0, 1), (4, 2, 1), (7, 0, 0)]
    assert places(spark, bodies, "out") == [(0, 0, 0), (1, 0, 0), (1, 2, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0), (4, 2, 0)]


def test_broken_bodies_give_nothing(spark):
    assert places(spark, [None, "", "  ", '{"vin": [{}', '{"vin": [{}]} x', "null", "3", '"vin"', "{'vin': [{}]}"], "in") == []


def test_merged_schema_tables(spark):
    df = raw(spark, ['{"id": 1, "in": {"v": "12", "w": [1, null, "a"]}}', '{"id": "2", "in": [{"v": 3, "deep": {"_key": true, "xs": [[1], [2, 3]]}}, null]}', '{"x": 1.5}', "[1]"])
    tables = nested.flatten_json(df.select("record_id", nested.parsed(df.body).alias("b")), "record_id", "b", "t")
    child = {(r._parent, r._ord): r.asDict() for r in tables["t.list.in"].collect()} if "t.list.in" in tables else {}
    assert {k[1] for k in child} <= {0, 1}
    names = set(tables)
    assert any(n.endswith(".w") for n in names) and any(n.endswith("deep__xs") for n in names)
    for name, t in tables.items():
        rows = t.collect()
        assert len({r._key for r in rows}) == len(rows), name
    parents = {r._key for r in tables["t.list"].collect()} if "t.list" in tables else {r._key for r in tables["t"].collect()}
    assert {k[0] for k in child} <= parents


def test_typed_tables(spark):
    df = spark.createDataFrame(
        [(1, [(7, [1, None, 3]), None]), (2, None), (3, [])], "id long, items array<struct<_key: long, tags: array<int>>>"
    )
    t = nested.flatten_typed(df, "id")
    assert [(r._parent, r._ord, r["_key_"]) for r in t["root.items"].collect()] == [("1", 0, 7)]
    assert sorted((r._parent, r._ord, r.value) for r in t["root.items.tags"].collect()) == [("1/items.0", 0, 1), ("1/items.0", 2, 3)]
    assert t["root"].count() == 3


def test_long_body_and_empty_table(spark):
    body = '{"vin": [' + ",".join(['{"address": "' + "a" * 50 + '"}'] * 20000) + "]}"
    assert len(places(spark, [body], "in")) == 20000
    assert places(spark, [], "in") == []


def tables_of(spark, bodies, synonyms=None):
    df = raw(spark, bodies)
    with nested._setting(spark, "spark.sql.variant.allowDuplicateKeys", "true"):
        parsed = df.select("record_id", nested.parsed(df.body).alias("b"))
    return nested.flatten_json(parsed, "record_id", "b", "t", synonyms=synonyms)


def test_a_scalar_where_others_have_a_list(spark):
    t = tables_of(spark, ['{"a": ["x", null]}', '{"a": "y"}', '{"a": null}', '{"a": 3}'])
    assert sorted((r._parent, r._ord, r.value) for r in t["t.a"].collect()) == [("0", 0, "x"), ("1", 0, "y"), ("3", 0, "3")]


def test_types_hold_every_value(spark):
    t = tables_of(spark, ['{"w": 1, "r": "2.5", "s": 1, "b": true, "n": null, "big": 12345678901234567890}', '{"w": "22", "r": 1, "s": "x1", "b": false, "big": 1}'])["t"]
    assert dict(t.dtypes) == {"_key": "string", "w": "bigint", "r": "double", "s": "string", "b": "boolean", "big": "double"}
    assert sorted((r.w, r.r, r.s) for r in t.collect()) == [(1, 2.5, "1"), (22, 1.0, "x1")]


def test_odd_names_and_mixed_lists(spark):
    body = '{"we ird.k`e,y>": {"OBJECT": [1, {"<z>": [[true], "s"]}]}, "": 5, "a": 1, "a": 2}'
    t = tables_of(spark, [body, "[3]", "7"])
    flat = [r.asDict() for name in t for r in t[name].collect()]
    assert any(r.get("a") == 2 for r in flat) and any(r.get("value") == 3 for r in flat) and any(r.get("value") == 7 for r in flat)
    assert any("<z>" in name for name in t) and spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"
    assert nested.infer_schema(raw(spark, ["{}"]).select(nested.parsed(F.col("body")).alias("v")), "v").kinds == {"object"}


def test_synonyms_are_one_list(spark):
    t = tables_of(spark, ['{"vin": [{"v": 1}], "inputs": [{"v": 9}]}', '{"inputs": {"v": 2, "w": 1}}', '{"vin": 5, "x": 1}'], {"in": ("vin", "inputs", "absent")})
    assert sorted((r._parent, r._ord, r.v) for r in t["t.in"].collect()) == [("0", 0, 1), ("1", 0, 2)]
    assert set(t) == {"t", "t.in"} and "x" in t["t"].columns


def test_flat_rows(spark, data):
    from tallyweave.plans import data_queries

    rows = data_queries.p3_flat_rows(spark, data)
    keys = {(r.table_name, r.row_key) for r in rows.select("table_name", "row_key").collect()}
    assert len(keys) == rows.count() > 100
    for r in rows.select("table_name", "parent_key").where("parent_key is not null").distinct().collect():
        assert (r.table_name.rsplit(".", 1)[0], r.parent_key) in keys
