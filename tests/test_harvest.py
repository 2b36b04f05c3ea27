import os

import pytest
from pyspark.sql import functions as F

from driftlens.operators import harvest, issues, models
from driftlens.plans import jobs
from driftlens.session import stage
from driftlens.sources import corpus, sinks


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    files = {
        "a.py": b'from pydantic import BaseModel\nq = gql("""query A { a }""")\nclass M(BaseModel):\n    x: int\n',
        "sub/b.graphql": b"query B {\n b }\nquery C { c }\n",
        "sub/c.gql": b"{ broken",
        "sub/with space+1.py": b"q = 'query W { w }'\n",
        "venv/d.py": b"q = 'query D { d }'\n",
        "build_1/e.py": b"q = 'query E { e }'\n",
        "node_modules": b"not a folder",
        "bad.py": b"q = '\xff'\n",
        "empty.py": b"x = 1\n",
        "notes.txt": b"query N { n }",
    }
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(root)


def names(df, root):
    return sorted(os.path.relpath(r.file, root) for r in df.select("file").collect())


def test_scan(spark, tree):
    listed = corpus.list_files(spark, tree, patterns=["build_*"])
    good = corpus.readable(listed)
    assert names(good, tree) == ["a.py", "empty.py", "sub/b.graphql", "sub/c.gql", "sub/with space+1.py"]
    assert names(corpus.unreadable(listed), tree) == ["bad.py"]
    assert names(corpus.first_files(good, 2), tree) == ["a.py", "empty.py"]
    single = corpus.list_files(spark, os.path.join(tree, "sub/b.graphql"))
    assert [(r.ext, r.source) for r in single.collect()] == [("graphql", "query B {\n b }\nquery C { c }\n")]


def test_default_exclusions_match_folders_and_python_files(spark):
    paths = ["x/tests/a.py", "tests.py", "schema", "schema.py", "scripts/q.gql", "src/scripts.gql", "src/ok.py"]
    df = spark.createDataFrame([(p,) for p in paths], "file string")
    kept = df.filter(~corpus.excluded_names(F.col("file"), (*corpus.DEFAULT_EXCLUSIONS, "tests.py")))
    assert sorted(r.file for r in kept.collect()) == ["schema", "schema.py", "src/ok.py", "src/scripts.gql"]


def test_whole_job(spark, tree, tmp_path):
    files = corpus.readable(corpus.list_files(spark, tree, patterns=["build_*"]))
    h = jobs.Harvest(files, exact_lines=True)
    got = sorted((os.path.basename(r.file), r.type, r.name, r.start_line, r.end_line) for r in h.blocks.collect())
    assert got == [
        ("a.py", "query", "A", 2, 2),
        ("b.graphql", "query", "B", 1, 2),
        ("b.graphql", "query", "C", 3, 3),
        ("c.gql", "unknown", None, 1, 1),
        ("with space+1.py", "query", "W", 1, 1),
    ]
    assert [(r.model_name, r.type, r.start_line, r.end_line, r.raw) for r in h.models.collect()] == [
        ("M", "BaseModel/RootModel", 3, 4, "class M(BaseModel):\n    x: int")
    ]
    assert issues.totals(h.blocks, h.models).collect()[0] == (4, 5, 1)
    nested = {os.path.basename(r.file): r for r in h.nested().collect()}
    assert [b.name for b in nested["b.graphql"].graphql] == ["B", "C"]
    out = str(tmp_path / "json")
    sinks.write_json(h.nested(), out)
    assert spark.read.json(out).count() == 4
    lines = str(tmp_path / "lines")
    sinks.write_issue_lines(jobs.parse_issues(h.blocks), lines)
    text = spark.read.text(lines).collect()[0].value
    assert text.endswith("c.gql:1:1: error: [GRAPHQL_VALIDATION] GraphQL parsing error: the text is not a valid operation document")


def python_rows(spark, source):
    files = spark.createDataFrame([("f.py", "py", source)], "file string, ext string, source string")
    return harvest.read_python(files)


CASES = {
    "same body, later copy": ('a = gql("query A { a }")\nb = gql("query A {a}")\n', [("query", "A", 1)]),
    "comment and layout do not count": (
        'a = """query A { a }"""\nb = """query A {\n  a # x\n}"""\n', [("query", "A", 1)]),
    "annotated": ('Query: str = "{ a }"\nother: str = "{ a }"\nx: str = "query X { x }"\n', [("query", None, 1), ("query", "X", 3)]),
    "annotated over lines": ('q: str = """query X {\n x }"""\n', [("query", "X", 2)]),
    "any balanced string": ('x = "{ a }"\ny = "{ a"\nz = "{a: 1}"\n', [("query", None, 1), ("unknown", None, 3)]),
    "returned call": ("def f():\n    return gql('query A { a }')\n", [("query", "A", 2)]),
    "interpolated member": ('q = f"query A {{ a(x: {o.x}, y: {n}, z: {f()}) }}"\n', [("query", "A", 1), ("unknown", None, 1)]),
    "name bound twice": ('p = "query A { a "\np = "query B { b "\nq = p + "}"\n', [("query", "A", 3)]),
    "unbound name": ('q = p + "{ a }"\n', []),
    "dynamic member": ('v = "query A { a "\nw = v + "x"\nd = "query D { d }"\ngql(d.query)\ngql(d["query"])\n', [("query", "D", 3)]),
    "field default": (
        "from pydantic import BaseModel as BM\nclass A(BM):\n    q: str = Field(default='query A { a }')\n    r = 'mutation B { b }'\n"
        "class C:\n    s: str = Field(default='query C { c }')\n", [("query", "A", 3), ("mutation", "B", 4)]),
    "not python": ("def (:\n  return \"\"\"query A { a }\"\"\"\n  return 'nothing'\n", [("query", "A", 3)]),
    "parenthesised concatenation": ('q = (\n  "query A {"\n  + " a }"\n)\n', [("query", "A", 2)]),
}


@pytest.fixture(scope="module")
def harvested_cases(spark):
    rows = [(case, "py", source) for case, (source, _) in CASES.items()]
    python = stage(harvest.read_python(spark.createDataFrame(rows, "file string, ext string, source string")), "cases")
    found = harvest.model_candidates(python)
    return harvest.blocks(found).select("file", "type", "name", "start_line").collect()


@pytest.mark.parametrize("case", CASES)
def test_strategies(harvested_cases, case):
    got = [(r.type, r.name, r.start_line) for r in harvested_cases if r.file == case]
    assert sorted(got, key=str) == sorted(CASES[case][1], key=str)


def test_error_is_placed_where_the_text_stands(spark):
    source = "x = 1\n" * 4 + 'q = ("query Broken_text_a "\n     "{ a(x: ) }")\n'
    python = python_rows(spark, source)
    rows = harvest.blocks(harvest.candidates(python)).collect()
    assert [(r.type, r.start_line, r.end_line) for r in rows] == [("unknown", 5, 5)]


def test_model_precedence_and_last_definition(spark):
    source = (
        "import pydantic\nfrom dataclasses import dataclass\n"
        "@dataclass\nclass A(pydantic.BaseModel):\n    x: int\n"
        "class B(Generic[T], A):\n    pass\n"
        "@pydantic.dataclasses.dataclass(config=1)\nclass C:\n    pass\n"
        "class D(A):\n    pass\nclass D:\n    pass\n"
        "class E(F):\n    pass\nclass F(E):\n    pass\n"
    )
    rows = models.models(python_rows(spark, source)).collect()
    got = sorted((r.model_name, r.type) for r in rows)
    assert got == [("A", "BaseModel/RootModel"), ("B", "BaseModel/RootModel"), ("C", "PydanticDataclass")]


def test_reaching_roots_follows_long_chains_and_ends_on_cycles(spark):
    edges = [("f", f"C{i}", f"C{i - 1}", False) for i in range(1, 12)] + [("f", "C0", "BaseModel", True)]
    edges += [("f", "X", "Y", False), ("f", "Y", "Z", False), ("f", "Z", "X", False), ("g", "D", "C3", False)]
    edges += [("f", "W", "Y", False), ("f", "W", "C2", False)]
    df = spark.createDataFrame(edges, "file string, class string, base string, is_root boolean")
    got = {(r.file, r["class"]) for r in models.reaching_roots(df).collect()}
    assert got == {("f", f"C{i}") for i in range(12)} | {("f", "W")}


def test_facts_never_raise():
    import time

    from driftlens.operators.facts import UNREADABLE, list_facts

    assert list_facts('x = "\\ud800 { a }"')["strings"][0]["parts"][0]["text"] == "? { a }"
    for terms in (1500, 5000):
        start = time.perf_counter()
        facts = list_facts("x = " + " + ".join(['"plain words that are no operation"'] * terms))
        assert time.perf_counter() - start < 1.0
        assert facts["error"] is None or facts["error"].startswith(UNREADABLE)
        assert sum(len(s["parts"]) for s in facts["strings"]) <= 2 * terms
    deep = list_facts("x = " + "(" * 5000 + "1" + ")" * 5000)
    assert deep["strings"] == [] and deep["error"]


def test_batches_are_read_without_searching_for_cycles(spark):
    import gc

    from driftlens.functions.batches import uncollected

    with uncollected():
        assert not gc.isenabled()
    assert gc.isenabled()


def test_body_keys_are_shuffled_as_bytes(spark):
    from driftlens.operators.dedupe import body_key

    rows = spark.createDataFrame([("{ a }",), ("{a} # x",), ("{ b }",), (None,)], "raw string").select(body_key().alias("k")).collect()
    assert rows[0].k == rows[1].k != rows[2].k and {len(r.k) for r in rows} == {32}
