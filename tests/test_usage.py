import pytest

from driftlens.operators import catalog, evolution, surface, usage
from driftlens.plans import jobs
from driftlens.session import stage

OLD, NEW = "2024-04", "2025-04"
FIELDS = """
Admin o QueryRoot user User
Admin o QueryRoot gone User
Admin o User Name String dep
Admin o User friend User flag
Admin o User pet Animal
Admin o Animal age Int
Admin n QueryRoot user User
Admin n QueryRoot fresh New
Admin n User Name String
Admin n User extra String
Admin n New deep New
Admin n Animal age Int
Admin n Animal weight Int
Storefront o QueryRoot shop Shop
Storefront o Shop title String
Storefront o Mutation act Shop
Storefront n QueryRoot shop Shop
Storefront n Shop label String
"""


@pytest.fixture(scope="module")
def schema(spark):
    rows = []
    for i, line in enumerate(FIELDS.split("\n")):
        if line:
            name, version, kind, field, named, *note = line.split()
            note = note[0] if note else ""
            rows.append((name, OLD if version == "o" else NEW, kind, field, note == "flag", "use x" if note == "dep" else None, named, i))
    fields = spark.createDataFrame(
        rows, "schema string, version string, type_name string, field_name string, is_deprecated boolean, "
        "deprecation_reason string, named_type string, ord int")
    fields = stage(fields, "test-fields")
    types = fields.selectExpr("schema", "version", "type_name", "'OBJECT' AS kind").distinct()
    return types, fields


def block(kind, name, raw, start=10, seq=0, condition=None, file="f", error=None):
    return (file, kind, name, condition, raw, start, 1, seq, 0, error)


def blocks_of(spark, rows):
    return spark.createDataFrame(
        rows, "file string, type string, name string, type_condition string, raw string, start_line int, strategy int, "
        "seq int, def_no int, error string")


def drift(spark, schema, rows, **options):
    found = usage.usage_drift(blocks_of(spark, rows), *schema, OLD, NEW, **options).collect()
    return sorted((r.line, r.column, r.kind, r.type_name, r.field_name, r.client) for r in found)


def test_statuses_and_places(spark, schema):
    raw = "query Q {\n  user { name friend { friend { name } } extra }\n}"
    assert drift(spark, schema, [block("query", "Q", raw)]) == [
        (12, 11, "DEPRECATED", "User", "name", "Admin"),
        (12, 16, "DEPRECATED", "User", "friend", "Admin"),
        (12, 16, "REMOVED", "User", "friend", "Admin"),
        (12, 25, "DEPRECATED", "User", "friend", "Admin"),
        (12, 25, "REMOVED", "User", "friend", "Admin"),
        (12, 34, "DEPRECATED", "User", "name", "Admin"),
        (12, 43, "ADDED", "User", "extra", "Admin"),
    ]


def test_messages(spark, schema):
    # Without a keyword the client cannot be told: both schemas are tried.
    anonymous, named = ([block("query", None, text)] for text in ("{ user { name friend } }", "query Q { user { name friend } }"))
    assert len(drift(spark, schema, anonymous)) == 3
    rows = usage.usage_drift(blocks_of(spark, named), *schema, OLD, NEW).collect()
    assert sorted(r.message for r in rows) == [
        "[DEPRECATED] Field 'friend' in type 'User' is deprecated in old schema: None (Admin)",
        "[DEPRECATED] Field 'name' in type 'User' is deprecated in old schema: use x (Admin)",
        "[REMOVED] Field 'friend' in type 'User' was removed in new schema (Admin)",
    ]


def test_new_types_count_as_old_unless_strict(spark, schema):
    raw = "query Q { fresh { deep { nope } } }"
    loose = drift(spark, schema, [block("query", "Q", raw)])
    assert [(k, f) for _, _, k, _, f, _ in loose] == [("ADDED", "fresh")]
    strict = drift(spark, schema, [block("query", "Q", raw)], strict_added=True)
    assert [(k, f) for _, _, k, _, f, _ in strict] == [("ADDED", "fresh"), ("ADDED", "deep")]


def test_fragments(spark, schema):
    rows = [
        block("fragment", "F", "fragment F on User { friend }", 1, 0, "User"),
        block("fragment", "F", "fragment F on User { extra ...G }", 5, 1, "User"),
        block("fragment", "G", "fragment G on User { name ...F }", 9, 2, "User"),
        block("query", "Q", "query Q { user { ...F ...Missing ... { name } ... on Animal { weight ... on Gone { x } } } }", 20, 3),
    ]
    got = drift(spark, schema, rows)
    assert [(k, f) for line, _, k, _, f, _ in got if line == 2] == [("DEPRECATED", "friend"), ("REMOVED", "friend")]
    at_query = sorted((k, t, f) for line, _, k, t, f, _ in got if line == 21)
    # The last F counts; F and G spread each other, which ends where a path enters one again and repeats nothing.
    assert at_query == [("ADDED", "Animal", "weight"), ("ADDED", "User", "extra"), ("DEPRECATED", "User", "name")]


def test_spread_fields_have_no_depth_limit(spark, schema):
    chain = "user { " + "friend { " * 8
    raw = "query Q { " + chain + "...F" + " }" * 10
    rows = [block("fragment", "F", "fragment F on User { friend { extra } }", 1, 0, "User"), block("query", "Q", raw, 50, 1)]
    got = drift(spark, schema, rows)
    assert sum(1 for line, _, k, _, f, _ in got if line == 51 and k == "REMOVED") == 9
    assert [k for line, _, k, _, f, _ in got if line == 51 and f == "extra"] == ["ADDED"]


def test_doubling_spreads_cost_what_their_text_does(spark, schema):
    fragments = [f"fragment F{i} on User {{ friend {{ ...F{i + 1} ...F{i + 1} }} }}" for i in range(24)]
    rows = [block("fragment", f"F{i}", text, 10 * i + 10, i, "User") for i, text in enumerate(fragments)]
    rows.append(block("fragment", "F24", "fragment F24 on User { extra ...F0 }", 250, 24, "User"))
    rows.append(block("query", "Q", "query Q { user { ...F0 nope { ...F3 } } }", 500, 25))
    types, fields = schema
    rooted = stage(usage.rooted_blocks(blocks_of(spark, rows), types, fields, OLD), "rooted")
    found = stage(usage.block_selections(rooted), "selections")
    lookup = stage(catalog.drift_lookup(types, fields, OLD, NEW), "lookup")
    uses = usage.expand_spreads(found, lookup).filter("start_line = 500 AND path LIKE ':%'").collect()
    assert sorted((r.path, r.name) for r in uses) == [(":User", "extra")] + [(":User", "friend")] * 24
    got = drift(spark, schema, rows)
    # The fragments' texts are one line each, so their fields share a line, in the columns their names leave.
    places = [(c, k, f) for line, c, k, _, f, _ in got if line == 501]
    assert len(places) == 5 and {(k, f) for _, k, f in places} == {("ADDED", "extra"), ("DEPRECATED", "friend"), ("REMOVED", "friend")}


def test_a_spread_below_an_unknown_field_is_not_entered(spark, schema):
    rows = [block("fragment", "F", "fragment F on User { extra }", 1, 0, "User"), block("query", "Q", "query Q { user { nope { ...F } } }", 50, 1)]
    assert not [f for line, _, _, _, f, _ in drift(spark, schema, rows) if line == 51]


def test_deep_paths_are_walked(spark, schema):
    raw = "query Q { user { " + "friend { " * 40 + "extra" + " }" * 42
    got = drift(spark, schema, [block("query", "Q", raw)])
    assert sum(k == "REMOVED" for _, _, k, _, _, _ in got) == 40 and [f for _, _, k, _, f, _ in got if k == "ADDED"] == ["extra"]


def test_clients(spark, schema):
    types, fields = schema
    rows = [
        block("query", "A", "query A { user { x } }"),
        block("query", "B", "query B { shop { title } }", seq=1),
        block("query", "C", "query C { nowhere }", seq=2),
        block("mutation", "D", "mutation D { act { title } }", seq=3),
        block("fragment", "E", "fragment E on Shop { title }", seq=4, condition="Shop"),
        block("fragment", "G", "fragment G on Nope { a }", seq=5, condition="Nope"),
    ]
    rooted = usage.rooted_blocks(blocks_of(spark, rows), types, fields, OLD).collect()
    got = {r.name: (r.client, sorted(map(tuple, r.roots))) for r in rooted}
    assert got == {
        "A": ("Admin", [("Admin", "QueryRoot")]),
        "B": ("Storefront", [("Storefront", "QueryRoot")]),
        "C": ("Unknown", [("Admin", "QueryRoot"), ("Storefront", "QueryRoot")]),
        "D": ("Storefront", [("Storefront", "Mutation")]),
        "E": ("Storefront", [("Storefront", "Shop")]),
        "G": ("Unknown", []),
    }


def test_surface_job(spark, schema):
    types, fields = schema
    args = spark.createDataFrame(
        [("Admin", OLD, "QueryRoot", "user", "id", True, "ID"), ("Admin", OLD, "QueryRoot", "user", "q", False, "Int")],
        "schema string, version string, type_name string, field_name string, arg_name string, is_required boolean, named_type string")
    raw = "query Q { user(bad: 1) { Name nope ... on Animal { age size } ... on Gone { x ... on Lost { y } } } }"
    rows = [block("query", "Q", raw), block("unknown", None, "query {", 3, 1, error="broken")]
    models = spark.createDataFrame([], "file string, model_name string, raw string, start_line int")
    got = jobs.surface_check(blocks_of(spark, rows), models, types, fields, args, OLD, NEW).collect()
    said = sorted(r.message for r in got)
    assert said == sorted([
        "[DEPRECATED] Field 'Name' in type 'User' is deprecated in old schema: use x (Admin)",
        "[GRAPHQL_VALIDATION] Cannot query field 'nope' on type 'User'.",
        "[GRAPHQL_VALIDATION] Cannot query field 'size' on type 'Animal'.",
        "[EXTRA_FIELD] Unknown argument 'bad' on field 'QueryRoot.user'.",
        "[MISSING_REQUIRED_ARG] Field 'user' argument 'id' of type 'ID!' is required, but it was not provided.",
        "[INVALID_FIELD_SELECTION] Field 'size' does not exist on type 'Animal'",
        "[INVALID_FRAGMENT] Type 'Gone' does not exist in schema",
        "[GRAPHQL_PARSE] broken",
        "[GRAPHQL_INVALID_FRAGMENT] inline fragment on type 'Animal' may not be compatible",
        "[GRAPHQL_INVALID_FRAGMENT] inline fragment on type 'Gone' may not be compatible",
        "[GRAPHQL_INVALID_FRAGMENT] inline fragment on type 'Lost' may not be compatible",
        *["[GRAPHQL_INVALID_FRAGMENT] fragment spread 'on' likely does not exist"] * 3,
    ])


def test_evolution(spark, schema):
    types, fields = schema
    counts = {r.schema: tuple(r)[1:] for r in evolution.evolution_counts(types, fields, OLD, NEW).collect()}
    assert counts == {"Admin": (0, 1, 2 + 1, 3, 2), "Storefront": (1, 0, 1, 1, 0)}
    assert {(r.schema, r.difference) for r in evolution.field_counts(fields, OLD, NEW).collect()} == {("Admin", "+1"), ("Storefront", "-1")}


def test_error_kinds(spark):
    rows = spark.createDataFrame([("Operation is unnamed",), ("type cannot be Int",), ("x",)], "message string")
    assert sorted(tuple(r) for r in surface.classified(rows).collect()) == [
        ("GRAPHQL_VALIDATION", "warning", "[GRAPHQL_VALIDATION] x"),
        ("INVALID_OPERATION", "error", "[INVALID_OPERATION] Operation is unnamed"),
        ("TYPE_MISMATCH", "error", "[TYPE_MISMATCH] type cannot be Int"),
    ]


def test_roots_prefer_the_named_type(spark):
    types = spark.createDataFrame(
        [("A", OLD, "Query"), ("A", OLD, "QueryRoot"), ("B", OLD, "Query")], "schema string, version string, type_name string")
    named = spark.createDataFrame([("B", OLD, "query", "Start")], "schema string, version string, operation string, type_name string")
    assert {(r.schema, r.type_name) for r in catalog.roots(types, named).collect()} == {("A", "QueryRoot"), ("B", "Start")}


def test_spread_places_keep_every_way_to_a_fragment(spark):
    texts = [
        ("fragment", "A", "T", "fragment A on T { f1 ...B }"), ("fragment", "B", "T", "fragment B on T { f2 ...A }"),
        ("query", "Q", None, "query Q { t { ...A nope { ...B } } }"),
    ]
    rows = [("f", 1, i, 0, kind, name, condition, raw, "Admin", i, [("Admin", "R")], None) for i, (kind, name, condition, raw) in enumerate(texts)]
    blocks = spark.createDataFrame(
        rows, "file string, strategy int, seq int, def_no int, type string, name string, type_condition string, raw string, client string, "
        "start_line int, roots array<struct<client:string,root:string>>, error string",
    )
    found = stage(usage.block_selections(blocks), "selections")
    got = {(r.path, r.name, r.depth) for r in usage.spread_places(found).filter("start_line = 2 AND path LIKE '%:T%'").collect()}
    assert got == {
        (".t/:T", "f1", 3), (".t/:T/:T", "f2", 4), (".t/.nope/:T", "f2", 4), (".t/.nope/:T/:T", "f1", 5),
    }


def test_reached_over_pairs_in_columns(spark):
    schema = "file string, client string, start_line int, to array<string>, leads array<struct<fragment:string,to:string>>"
    rows = [
        ("a", "Admin", 1, ["A"], [("A", "B"), ("B", "C"), ("C", "A"), ("X", "Y")]),
        ("b", "Admin", 2, ["A", "Z"], None),
        ("c", "Admin", 3, ["B"], []),
        ("d", "Admin", 4, ["X"], [("A", "B"), ("X", "A")]),
    ]
    got = usage._reached(spark.createDataFrame(rows, schema).coalesce(1)).collect()
    assert sorted((r.file, r.fragment) for r in got) == [
        ("a", "A"), ("a", "B"), ("a", "C"), ("b", "A"), ("b", "Z"), ("c", "B"), ("d", "A"), ("d", "B"), ("d", "X"),
    ]
