import re

import pytest
from pyspark.sql import functions as F

from driftlens.operators import issues, lint


def operations(spark, texts):
    return spark.createDataFrame([(f"f{i}", t, 10) for i, t in enumerate(texts)], "file string, raw string, start_line int")


OPERATION_TEXTS = [
    "query Q($s: String!, $s: String!, $t: String) { list(first: $s, last: $t, offset:\n $s) { id } }",
    "{ Customer { a } SHOP() order (\n) user\n{ b } notuser { c } }",
    "{ a(first: 'x', limit:  \"y z\", count: 3) b(EXTRAARG: 1, x: 2) }",
    "{ test Tested latest nonexistentThing éunknown dummy_1 @TestDir @dummy }",
    "subscription  S { ... on\n T { a } ...F ... G }\nFRAGMENT  P  on  U { a }",
]


@pytest.mark.parametrize("rule", lint.OPERATION_RULES, ids=lambda r: r.id)
def test_operation_rules_match_where_the_pattern_does(spark, rule):
    mode = re.I if "i" in rule.flags else 0
    expected = set()
    for i, text in enumerate(OPERATION_TEXTS):
        for hit in re.finditer(rule.pattern, text, mode):
            if rule.id.startswith("g2") and hit.group(1).lower() not in lint.NEED_ARGUMENTS:
                continue
            before = text[: hit.start()]
            expected.add((f"f{i}", 10 + before.count("\n") + 1, len(before.rsplit("\n", 1)[-1]) + 1))
    found = lint.lint_operations(operations(spark, OPERATION_TEXTS), ["file"], {rule.id}).collect()
    assert {(r.file, r.line, r.column) for r in found} == expected
    assert all(r.message.startswith(f"[{rule.tag}] ") and r.level == rule.level for r in found)


def test_string_variables(spark):
    found = lint.lint_operations(operations(spark, OPERATION_TEXTS), ["file"], {"g4"}).collect()
    # Once per declaration and use.
    places = [OPERATION_TEXTS[0].index(argument) + 1 for argument in ("first", "offset")]
    assert sorted((r.file, r.line, r.column) for r in found) == [("f0", 11, p) for p in places for _ in range(2)]


def model_issues(spark, raw, rules, name="M"):
    df = spark.createDataFrame([("f", name, raw, 5)], "file string, model_name string, raw string, start_line int")
    return sorted((r.line, r.column, r.level, r.message) for r in lint.lint_models(df, ["file"], rules).collect())


def test_standing_model_rules(spark):
    raw = (
        "class M(BaseModel):\n    # a: int\n    a: int  # note\n    b: Optional[int]\n    c: str= 'x'\n"
        "    another_extra_field: optional[str] = None\n    AGE: Optional[STR] = None\n    d: Optional[Dict[str, int]] = None\n"
        "    e: int = Field(1, le = 3)\n"
    )
    got = model_issues(spark, raw, None)
    assert [(line, column, message.split("]")[0]) for line, column, _, message in got] == [
        (7, 1, "[PYDANTIC_REQUIRED_FIELD"),
        (11, 5, "[PYDANTIC_EXTRA_FIELD"),
        (11, 13, "[PYDANTIC_EXTRA_FIELD"),
        (12, 5, "[PYDANTIC_TYPE_MISMATCH"),
        (13, 8, "[PYDANTIC_COMPLEX_TYPE"),
        (14, 14, "le (less than or equal) constraint found in model 'M' - verify constraint values are appropriate"),
    ]


@pytest.mark.parametrize(
    "rules,raw,want",
    [
        (["m7"], "class A:\n  x: Other\n  y: List[int]\n  z: Late\n",
         [(5, 7, "Nested model 'x' in field 'A'"), (7, 3, "Nested model 'Lis' in field 'y'")]),
        (["m9"], "f(a: int = None, b: Optional[int] = None, c: str = None)",
         [(5, 1, "Field 'a'"), (5, 1, "consider using Optional[Optional[int]]"), (5, 1, "Field 'c'")]),
        (["m10"], "class A:\n  c = C(extra='allow')\n", []),
        (["m11"], "@validator('x')\ndef f(cls):\n  pass\ndef g():\n  return 1\nx: int", [(6, 1, "Validator function 'f'")]),
        (["m11"], "@validator('x')\ndef f(cls):\n  return 1\n", [(5, 1, "Validator for field 'x'")]),
        (["m13"], "Field(alias='a_B') Field(alias='ab') Field(x, alias=\"_1\")", [(5, 1, "'a_B'"), (5, 1, "'_1'")]),
        (["m14"], "class A(BaseModel, X):\n  pass\nclass B(RootModel[int], BaseModel):\n  pass", [(5, 1, "Model 'B'")]),
    ],
)
def test_opt_in_rules(spark, rules, raw, want):
    got = model_issues(spark, raw, rules)
    assert len(got) == len(want)
    for line, column, text in want:
        assert any(g[0] == line and g[1] == column and text in g[3] for g in got), (got, text)


def test_categories_and_fixes(spark):
    messages = ["[DEPRECATED] userErrors", "[GRAPHQL_SYNTAX] x", "[INPUT] y", "[PYDANTIC_OPTIONAL] z", "[REMOVED] [ADDED]"]
    df = spark.createDataFrame([("f", 1, 1, m) for m in messages], "file string, line int, column int, message string")
    counts = {r.category: r.n for r in issues.category_counts(df).collect()}
    assert len(counts) == 9 and counts["OTHER"] == 1 and counts["REMOVED"] == 1 and counts["ADDED"] == 0
    fixes = {r.issue: r.fix for r in issues.suggestions(df).collect()}
    assert fixes[messages[0]] == "Replace 'userErrors' with 'customerUserErrors'"
    assert fixes[messages[2]] == issues.NO_FIX


def test_numbering_handles_ties_and_nulls(spark):
    rows = [("a", 3, "x"), ("a", 1, "y"), ("a", 3, "w"), ("a", None, "z"), ("b", 9, "q"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "file string, line int, issue string")
    got = {r.issue: r.position for r in issues.numbered(df, ["line", "issue"]).collect()}
    assert got == {"z": 1, "y": 2, "w": 3, "x": 4, "q": 1, "n": 1}


def test_preview(spark):
    df = spark.createDataFrame([("a\nb\nc\n",), (None,)], "raw string")
    shown, left = issues.preview(F.col("raw"), 2)
    assert [tuple(r) for r in df.select(shown, left).collect()] == [("a\nb", 1), ("", 0)]
