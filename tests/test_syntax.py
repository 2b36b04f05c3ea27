"""Places and texts of parse errors."""

from driftlens.operators.syntax import FALLBACK, syntax_errors
from driftlens.plans import jobs

VALID = [
    "{ a }",
    "query A @dir(x: 1) { a } fragment F on T @d { b }",
    'query B($x: In! = {a: [1, 2], b: "}"}, $y: [[Int!]!]! @d(v: 1) $z: E = RED) { a(i: {k: {}, l: [], m: [$x, {n: $y}]}) }',
    "# head {\nquery C { a # }\n b }",
    'mutation { a(s: """block "quoted" } text""") @x @y(z: -1.5e3) { b: c(d: null) @e ...F @g ... @h { i } ... on T @j(k: 1) { l } on } }',
    "type T { a(b: [Int!] = [1]): Int @d(x: 1) } query U { fragment query type }",
    "subscription S { ... { a } }",
]
WRONG = [
    ("", 1, 1, "Unexpected <EOF>."),
    ("{ }", 1, 3, "Expected Name, found '}'."),
    ("hello { a }", 1, 1, "Unexpected Name 'hello'."),
    ("{ a }\n}", 2, 1, "Unexpected '}'."),
    ("query A", 1, 8, "Expected '{', found <EOF>."),
    ("query A {\n  a {\n    b\n", 4, 1, "Expected Name, found <EOF>."),
    ("{ a( }", 1, 6, "Expected Name, found '}'."),
    ("{ a(x 1) }", 1, 7, "Expected ':', found Int '1'."),
    ("{ a(x: ) }", 1, 8, "Unexpected ')'."),
    ("query A($x Int) { a }", 1, 12, "Expected ':', found Name 'Int'."),
    ("query A(x: Int) { a }", 1, 9, "Expected '$', found Name 'x'."),
    ("query A($x: [Int) { a }", 1, 17, "Expected ']', found ')'."),
    ("query A($x: = 1) { a }", 1, 13, "Expected Name, found '='."),
    ("fragment on on T { a }", 1, 10, "Unexpected Name 'on'."),
    ("fragment F { a }", 1, 12, "Expected 'on', found '{'."),
    ("{ ... on { a } }", 1, 10, "Expected Name, found '{'."),
    ("{ ... 1 }", 1, 7, "Expected '{', found Int '1'."),
    ('{ a "s" }', 1, 5, "Expected Name, found String 's'."),
    ("{ a(x: {y 1.5}) }", 1, 11, "Expected ':', found Float '1.5'."),
    ('{ a(x: "open)\n }', 1, 14, "Unterminated string."),
    ('{ a(x: """open)\n }', 2, 3, "Unterminated string."),
    ("{ a ? }", 1, 5, "Unexpected character: '?'."),
    ("{ a(x: 01) }", 1, 8, "Invalid number '01'."),
    ("{ a @ }", 1, 7, "Expected Name, found '}'."),
    ("{ a: { b } }", 1, 6, "Expected Name, found '{'."),
    ("type T { a: Int", 1, 16, "Unexpected <EOF>."),
]


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return {r["id"]: (r["at_line"], r["at_col"], r["problem"]) for r in syntax_errors(rows, "id", "text").collect()}


def test_first_wrong_token(spark):
    told = found(spark, [text for text, *_ in WRONG])
    for i, (text, line, column, message) in enumerate(WRONG):
        assert told[i] == (line, column, f"Syntax Error: {message}"), text


def test_valid_texts_have_no_wrong_token(spark):
    told = found(spark, VALID)
    assert {i: told[i] for i in told if told[i] != (1, 1, FALLBACK)} == {}


def test_null_and_deep_texts(spark):
    deep = "query {\n" + "a {" * 2000 + "a" + "}" * 1999
    told = found(spark, [None, deep])
    assert told[0] == (1, 1, "Syntax Error: Unexpected <EOF>.")
    assert told[1] == (2, 6000 + 1 + 1999 + 1, "Syntax Error: Expected Name, found <EOF>.")


def test_lines_of_the_file(spark):
    blocks = spark.createDataFrame(
        [("f", 7, "{ a\n ( }", "bad"), ("g", 1, "{ a\n ( }", "bad"), ("g", 1, "{ a\n ( }", "bad"), ("h", 1, "{ a }", None)],
        "file string, start_line int, raw string, error string",
    )
    rows = sorted(tuple(r) for r in jobs.parse_issues(blocks, detailed=True).collect())
    told = ("error", "[GRAPHQL_PARSE] Syntax Error: Expected Name, found '}'.")
    assert rows == [("f", 8, 4, *told), ("g", 2, 4, *told), ("g", 2, 4, *told)]
