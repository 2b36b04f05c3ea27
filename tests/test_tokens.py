from driftlens.operators.tokens import definitions, selections


def candidate_rows(spark, texts, mode="node"):
    rows = [(f"f{i}", 1, 0, text, 1, mode, 1) for i, text in enumerate(texts)]
    return spark.createDataFrame(
        rows, "file string, strategy int, seq int, body string, start_line int, mode string, error_line int"
    )


def split(spark, texts, mode="node"):
    found = {}
    for r in definitions(candidate_rows(spark, texts, mode)).orderBy("file", "def_no").collect():
        found.setdefault(int(r.file[1:]), []).append(r)
    return found


def test_definitions(spark):
    texts = [
        "{ a }",
        "query A @dir(x: 1) { a } fragment F on T @d { b }",
        'query B($x: In! = {a: [1, 2], b: "}"}, $y: [Int!] @d(v: $z)) { a(i: {k: {}}) }',
        "# head {\nquery C { a # }\n b }",
        'mutation { a(s: """block "quoted" } text""") { b } }',
        "subscription S { a }\n\n\nquery T { b }",
        "type T { a: Int } query U { a }",
    ]
    found = split(spark, texts)
    assert [(r.type, r.name) for r in found[0]] == [("query", None)]
    assert [(r.type, r.name, r.type_condition) for r in found[1]] == [("query", "A", None), ("fragment", "F", "T")]
    assert found[2][0].variables == ["x", "y"] and found[2][0].error is None
    assert found[3][0].raw == "query C { a # }\n b }"
    assert [(r.type, r.name, r.error) for r in found[4]] == [("mutation", None, None)]
    assert [(r.name, r.start_line, r.end_line) for r in found[5]] == [("S", 2, 2), ("T", 5, 5)]
    assert [r.name for r in found[6]] == ["U"]


def test_modes_place_lines(spark):
    text = "\n  query A {\n a }\n query B { b }"
    assert [(r.start_line, r.end_line) for r in split(spark, [text], "offset")[0]] == [(1, 2), (3, 3)]
    assert [(r.start_line, r.end_line) for r in split(spark, [text], "node")[0]] == [(2, 3), (4, 4)]
    assert [(r.start_line, r.end_line) for r in split(spark, [text], "document")[0]] == [(1, 2), (3, 3)]


BROKEN = [
    "", "   # nothing\n", "query A {", "query A { a } }", "{ }", "{ a( }", "{ a(x: ) }", "hello { a }", "{ a } tail",
    "query A { a ( b { c ) } }", "fragment on on T { a }", "query A", '{ a(s: "open) }', "query A ($x: ) { a }",
    "{a: 1}", '{"a": "b"}', "{ a [b] }", "{ a: { b } }",
    "{ ... on { a } }", "{ ... on",
]


def test_broken_texts_give_one_unknown_row(spark):
    found = split(spark, BROKEN)
    for i, text in enumerate(BROKEN):
        assert [(r.type, r.name, r.raw) for r in found[i]] == [("unknown", None, text.strip())], text
        assert found[i][0].error


def test_selections(spark):
    text = (
        "query Q($v: Int) @top(a: 1) {\n"
        "  me: user(id: {deep: {er: $v}}, on: true) @include(if: $v) { name ...F ... on T { on } ... @skip(if: true) { z } }\n"
        "  last\n}"
    )
    blocks = spark.createDataFrame([("f", text)], "file string, raw string")
    rows = selections(blocks, ["file"]).orderBy("line", "col").collect()
    got = [(r.kind, r.name, r.alias, r.type_condition, r.depth, r.path, r.line, r.col) for r in rows]
    assert got == [
        ("field", "user", "me", None, 1, "", 2, 3),
        ("argument", "id", None, None, 1, "", 2, 12),
        ("argument", "on", None, None, 1, "", 2, 34),
        ("field", "name", None, None, 2, ".user", 2, 63),
        ("spread", "F", None, None, 2, ".user", 2, 71),
        ("inline", None, None, "T", 2, ".user", 2, 73),
        ("field", "on", None, None, 3, ".user/:T", 2, 84),
        ("inline", None, None, None, 2, ".user", 2, 89),
        ("field", "z", None, None, 3, ".user/:", 2, 111),
        ("field", "last", None, None, 1, "", 3, 3),
    ]


def test_selections_have_no_depth_limit(spark):
    text = "{ " + " { ".join(f"a{i}" for i in range(1, 601)) + " }" * 600
    blocks = spark.createDataFrame([("f", text), ("g", "{ b { c } d }")], "file string, raw string")
    rows = {(r.file, r.name): (r.depth, r.path) for r in selections(blocks, ["file"]).collect()}
    assert rows.pop(("g", "c")) == (2, ".b") and rows.pop(("g", "b")) == rows.pop(("g", "d")) == (1, "")
    assert rows == {("f", f"a{i}"): (i, "/".join(f".a{k}" for k in range(1, i))) for i in range(1, 601)}


def test_braces_of_arguments_lead_nowhere(spark):
    text = "{ a(x: {y: {z: 1}}) { b c(q: {r: 2}) d { e } } f(o: {p: {}}) { g } }"
    blocks = spark.createDataFrame([("f", text)], "file string, raw string")
    rows = {r.name: r.path for r in selections(blocks, ["file"]).collect() if r.kind == "field"}
    assert rows == {"a": "", "b": ".a", "c": ".a", "d": ".a", "e": ".a/.d", "f": "", "g": ".f"}


def test_texts_are_read_inside_their_rows(spark):
    blocks = spark.createDataFrame([("f", "query Q { a(x: 1) { ...F b } }")], "file string, raw string")
    plans = [selections(blocks, ["file"]), definitions(candidate_rows(spark, ["query Q { a }"], "node"))]
    for df in plans:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        # Tokens are no rows: nothing is ordered, windowed or grouped by the number of a token.
        assert "regexp_extract_all" not in plan and "brace" not in plan
    assert [(r.kind, r.name, r.path) for r in plans[0].collect()] == [
        ("field", "a", ""), ("argument", "x", ""), ("spread", "F", ".a"), ("field", "b", ".a"),
    ]


def test_texts_that_share_a_key_do_not_parse(spark):
    rows = candidate_rows(spark, ["query Q { a }"], "node")
    got = definitions(rows.union(rows)).collect()
    assert [(r.type, r.raw) for r in got] == [("unknown", "query Q { a }")]


def test_texts_are_dealt_out_once(spark, capsys):
    """Definitions and what tells the first block of a group share one shuffle, whatever is repeated."""
    from driftlens.operators.dedupe import first_blocks, marked_blocks

    text = "query A { a }"
    rows = [
        ("f", 1, 0, text, 4, "node", 4), ("f", 2, 1, f" {text}\n", 3, "node", 3), ("f", 4, 2, "query {", 2, "node", 2), ("g", 1, 0, text, 1, "node", 1),
        # One key twice, and files without a name.
        ("g", 2, 1, text, 1, "node", 1), ("g", 2, 1, "query B { b }", 2, "node", 7), (None, 1, 0, text, 1, "node", 1), (None, 2, 1, text, 2, "node", 2),
    ]
    found = spark.createDataFrame(rows, "file string, strategy int, seq int, body string, start_line int, mode string, error_line int")
    defined = definitions(found)
    marked = marked_blocks(defined)
    marked.explain()
    assert capsys.readouterr().out.count("Exchange") == 1
    got = sorted((r.file or "", r.strategy, r.type, r.raw, r.start_line, r.is_first) for r in marked.collect())
    assert got == [
        ("", 1, "query", text, 1, True), ("", 2, "query", text, 2, False), ("f", 1, "query", text, 4, False), ("f", 2, "query", text, 3, True),
        ("f", 4, "unknown", "query {", 2, True), ("g", 1, "query", text, 1, True), ("g", 2, "unknown", "query B { b }", 7, True),
    ]
    first = marked.filter("is_first").drop("is_first")
    assert sorted(map(str, first.collect())) == sorted(map(str, first_blocks(defined).collect()))
