import json

from pyspark.sql import functions as F

from driftlens.operators import catalog, evolution
from driftlens.sources import introspection, sinks


def test_introspection(spark, tmp_path):
    ref = {"kind": "NON_NULL", "name": None, "ofType": {"kind": "LIST", "name": None, "ofType": {"kind": "OBJECT", "name": "B"}}}
    body = {
        "__schema": {
            "queryType": {"name": "Start"}, "mutationType": None,
            "types": [
                {"kind": "OBJECT", "name": "Start", "fields": [
                    {"name": "b", "isDeprecated": True, "deprecationReason": "old", "type": ref,
                     "args": [{"name": "id", "defaultValue": None, "type": {"kind": "NON_NULL", "ofType": {"kind": "SCALAR", "name": "ID"}}},
                              {"name": "n", "defaultValue": "1", "type": {"kind": "SCALAR", "name": "Int"}}]}]},
                {"kind": "INPUT_OBJECT", "name": "I", "fields": None, "inputFields": [{"name": "x", "type": {"kind": "SCALAR", "name": "Int"}, "isDeprecated": True}]},
                {"kind": "SCALAR", "name": "ID", "fields": None},
            ],
        }
    }
    rows = [
        {"schema": "Admin", "version": "2024-04", "data": body},
        {"schema": "Storefront", "version": "2024-04", **body},
        {"schema": "Admin", "version": "bad", "errors": ["no"]},
    ]
    path = tmp_path / "docs.json"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    docs = introspection.read_schemas(spark, str(path))
    fields = introspection.schema_fields(docs)
    assert sorted(tuple(r) for r in fields.collect()) == [
        (s, "2024-04", "Start", "b", True, "old", "B", 0) for s in ("Admin", "Storefront")]
    assert {(r.arg_name, r.is_required, r.named_type) for r in introspection.schema_args(docs).collect()} == {("id", True, "ID"), ("n", False, "Int")}
    assert {r.field_name for r in introspection.input_fields(docs).collect()} == {"x"}
    assert introspection.rejected(docs).collect()[0].version == "bad"
    assert evolution.type_counts(introspection.schema_types(docs)).filter("n_types = 3").count() == 2
    roots = catalog.roots(introspection.schema_types(docs), introspection.root_types(docs))
    assert {(r.operation, r.type_name) for r in roots.collect()} == {("query", "Start")}


def test_versions(spark):
    rows = [("2024-04", True), ("2030-10", True), ("2031-01", False), ("2024-02", False), ("2024-0|", False), ("2019-10", False), ("2024-4", False), (None, False), ("2024-04\n", False)]
    df = spark.createDataFrame(rows, "v string, want boolean")
    assert all(r[0] == r[1] for r in df.select(catalog.valid_version(F.col("v")), "want").collect())
    df = spark.createDataFrame([("2024-07", "token"), ("2024-10", "proxy")], "v string, want string")
    assert all(r[0] == r[1] for r in df.select(catalog.version_route(F.col("v")), "want").collect())


def test_lines(spark, tmp_path):
    df = spark.createDataFrame([(None, None, 3, "info", None), ("f", 1, None, "error", "m")], "file string, line int, column int, level string, message string")
    assert sorted(r[0] for r in df.select(sinks.issue_line()).collect()) == ["?:?:3: info: ", "f:1:?: error: m"]


def test_report_is_written_as_it_is_made(spark, tmp_path):
    kinds = [("Admin", v, t, "OBJECT") for v, t in (("1", "A"), ("1", "B"), ("2", "B"), ("2", "C"))]
    types = spark.createDataFrame(kinds, "schema string, version string, type_name string, kind string")
    rows = [("Admin", "1", "B", "x", False, None), ("Admin", "1", "B", "y", True, None), ("Admin", "2", "B", "y", False, None), ("Admin", "2", "B", "z", False, None)]
    fields = spark.createDataFrame(rows, "schema string, version string, type_name string, field_name string, is_deprecated boolean, deprecation_reason string")
    lines = evolution.report_lines(types, fields, "1", "2")
    sinks.write_report(lines.coalesce(1), str(tmp_path / "report"))
    got = [r.value for r in spark.read.text(str(tmp_path / "report")).coalesce(1).collect()]
    assert got == [
        "", "🏢 Admin Schema Analysis", "-" * 30, "", "❌ Removed types in Admin:", "  - A", "", "✅ Added types in Admin:", "  - C",
        "", "❌ Removed fields in Admin:", "  B:", "    - x", "", "✅ Added fields in Admin:", "  B:", "    - z",
        "", "⚠️  Deprecated fields in Admin:", "  B:", "    - y: Deprecated", "", "📈 Admin Summary:", "  - Removed fields: 1",
        "  - Added fields: 1", "  - Deprecated fields: 1", "  - Removed types: 1", "  - Added types: 1",
    ]


def test_plain_answers_and_deep_types(spark, tmp_path):
    ref = {"kind": "OBJECT", "name": "B"}
    for _ in range(9):
        ref = {"kind": "LIST", "name": None, "ofType": ref}
    deep = ref
    for _ in range(4):
        deep = {"kind": "LIST", "name": None, "ofType": deep}
    for name, kind in (("Admin_2024-04.json", ref), ("Shop_2025-01.json", deep)):
        body = {"data": {"__schema": {"types": [{"kind": "OBJECT", "name": "T", "fields": [{"name": "f", "type": kind, "args": []}]}]}}}
        (tmp_path / name).write_text(json.dumps(body))
    docs = introspection.read_schemas(spark, str(tmp_path), multiline=True)
    assert [tuple(r) for r in introspection.schema_fields(docs).select("schema", "version", "named_type").collect()] == [("Admin", "2024-04", "B")]
    assert [r.schema for r in introspection.rejected(docs).collect()] == ["Shop"]
    assert {r.schema for r in introspection.schema_types(introspection.read_schemas(spark, str(tmp_path / "Admin_2024-04.json"), True, "X", "1")).collect()} == {"X"}


def test_documents_are_written_once_and_small(spark, tmp_path):
    from pyspark.sql import functions as F

    from driftlens.plans import queries

    items = [(o, p, "R" if p % 2 else "N") for o in range(1, 400) for p in range(9)]
    day = F.lit("1998-06-01").cast("timestamp").alias("l_shipdate")
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_returnflag string").select("*", day).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o,) for o in range(1, 400)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    read = queries._documents(spark, str(tmp_path))
    files = [file.rpartition("/")[2] for file in read.inputFiles()]
    assert files and all(file.endswith(".gz") for file in files)
    assert sorted(r.version for r in queries.s8(spark, str(tmp_path)).collect()) == sorted(f"v{o}" for o in range(50, 400, 50))
    got = {(r.schema, r.version, r.type_name, r.field_name) for r in queries.s7(spark, str(tmp_path)).collect()}
    wanted = queries.schema(spark, str(tmp_path))[1].select("schema", "version", "type_name", "field_name").collect()
    assert got == set(map(tuple, wanted)) and len(got) == len(wanted)
