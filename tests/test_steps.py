"""Steps that many queries share do their work once: what their plans hold, with results on rows where that is easily lost."""

from datetime import datetime

from pyspark.sql import functions as F

from driftlens.corpora import derived
from driftlens.operators import surface, tokens, usage
from driftlens.plans import jobs
from driftlens.session import staged_paths


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def joins_of(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_schema_fields_group_the_items_once(spark, tmp_path):
    early, late, both = datetime(1995, 1, 1), datetime(1999, 6, 1), datetime(1998, 6, 1)
    rows = [
        (4, 7, "R", early), (4, 7, "N", early), (5, 14, "N", both), (4, 1, None, early), (4, None, "R", late), (4, -2, "N", late),
        (6, 3, "R", both), (None, 2, "R", late), (8, 3, "R", None), (40, 10, "A", late),
    ]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_returnflag string, l_shipdate timestamp").write.parquet(
        f"{tmp_path}/lineitem.parquet"
    )
    found = derived.schema_fields(spark, str(tmp_path))
    assert plan_of(found).count("FileScan") == 1
    old, new = derived.OLD, derived.NEW
    admin, shop = "Admin", "Storefront"
    # A grouping row by row says the same.
    item = spark.read.parquet(f"{tmp_path}/lineitem.parquet").select(
        F.floor(F.col("l_orderkey") / 2).cast("bigint").alias("k"), (F.col("l_partkey") % 7).alias("p"),
        F.explode(F.array_compact(F.array(
            F.when(F.col("l_shipdate") < F.lit(derived.LAST_OLD).cast("timestamp"), old),
            F.when(F.col("l_shipdate") >= F.lit(derived.FIRST_NEW).cast("timestamp"), new),
        ))).alias("version"), (F.col("l_returnflag") == "R").alias("flagged"),
    ).groupBy("k", "p", "version").agg(F.bool_or("flagged").alias("flagged"))
    own = {(r.version, None if r.k is None else f"T{r.k}", None if r.p is None else f"f{r.p}", r.flagged, r.p) for r in item.collect()}
    got = [r for r in found.collect() if r.type_name not in ("QueryRoot", "Mutation")]
    assert len(got) == len(own) and {(r.version, r.type_name, r.field_name, r.is_deprecated, r.ord) for r in got} == own
    starts = {(r.schema, r.version, r.type_name, r.field_name, r.named_type, r.is_deprecated) for r in found.collect()} - {
        (r.schema, r.version, r.type_name, r.field_name, r.named_type, r.is_deprecated) for r in got
    }
    assert starts == {
        *[(shop, v, "QueryRoot", f"t{k}", f"T{k}", False) for k in (2, 3) for v in (old, new)],
        *[(shop, v, "Mutation", "m3", "T3", False) for v in (old, new)],
        (admin, new, "QueryRoot", "t20", "T20", True),
    }


BLOCK = "file string, strategy int, seq int, def_no int, raw string, start_line int"


def test_texts_with_a_key_of_their_own_are_not_shuffled(spark):
    rows = [("a", 1, 0, 0, "{ x { y } }", 1), ("b", 1, 0, 0, "{ z(k: 1) }", 2), (None, 1, 0, 0, "{ n }", 3)]
    found = tokens.selections_beside(spark.createDataFrame(rows, BLOCK), usage.BLOCK_KEY, ["start_line"])
    assert "Exchange" not in plan_of(found)
    assert sorted((r.file or "", r.name, r.start_line) for r in found.collect()) == [
        ("", "n", 3), ("a", "x", 1), ("a", "y", 1), ("b", "k", 2), ("b", "z", 2),
    ]


def test_texts_that_share_a_key_are_read_with_their_number(spark):
    rows = [("a", 1, 0, 0, "{ x }", 1), ("a", 1, 0, 0, "{ x }", 1), (None, 1, 0, 0, "{ n }", 3), (None, 1, 0, 0, "{ n }", 3), ("b", 1, 0, 0, "{ z }", 2)]
    blocks = spark.createDataFrame(rows, BLOCK)
    key = usage.BLOCK_KEY
    whole = tokens.selections(blocks, key)
    beside = tokens.selections_beside(blocks, key, ["start_line"]).drop("start_line")
    assert sorted(map(tuple, beside.distinct().collect()), key=str) == sorted(map(tuple, whole.distinct().collect()), key=str)
    assert beside.count() == 2 * whole.filter("file IS NULL OR file = 'a'").count() + 1


def test_models_are_staged_when_asked_for(spark):
    files = spark.createDataFrame(
        [("m.py", "py", "from pydantic import BaseModel\nclass A(BaseModel):\n    query: str = 'query Q { a }'\n"), ("n.py", "py", "class B:\n    query = 'query R { a }'\n"),
         ("o.py", "py", "q = 'query S { a }'\n")],
        "file string, ext string, source string",
    )
    before = len(staged_paths(spark))
    h = jobs.Harvest(files)
    assert not [p for p in staged_paths(spark)[before:] if "/models-" in p]
    assert sorted(r.name for r in h.blocks.collect()) == ["Q", "R", "S"]
    assert [r.model_name for r in h.models.collect()] == ["A"] and h.models is h.models


def test_what_is_told_of_an_argument_is_told_in_one_pass(spark):
    uses = spark.createDataFrame(
        [("f", 1, 0, 0, 1, "Admin", "Q", "user", 10, 1, 3, True, True), ("f", 1, 0, 0, 2, "Admin", "Q", "nope", 10, 2, 3, False, True),
         ("f", 1, 0, 0, 3, "Admin", "Q", "__typename", 10, 2, 9, False, True), ("f", 1, 0, 0, 4, "Admin", None, "x", 10, 3, 1, False, False),
         ("f", 1, 0, 0, 5, "Admin", "Q", "user", 10, 4, 3, True, True), (None, 1, 0, 0, 1, "Admin", "Q", "plain", 10, 5, 3, True, True)],
        "file string, strategy int, seq int, def_no int, node int, client string, type_name string, name string, start_line int, line int, col int, "
        "known boolean, is_object boolean",
    )
    given = spark.createDataFrame(
        [("f", 1, 0, 0, 1, "id", 1, 8), ("f", 1, 0, 0, 5, "bad", 4, 8), ("f", 1, 0, 0, 2, "bad", 2, 8), (None, 1, 0, 0, 1, "bad", 5, 8)],
        "file string, strategy int, seq int, def_no int, node int, arg string, line int, col int",
    )
    args = spark.createDataFrame(
        [("Admin", "v", "Q", "user", "id", True, "ID")],
        "schema string, version string, type_name string, field_name string, arg_name string, is_required boolean, named_type string",
    )
    found = surface.argument_issues(uses, given, args, "v")
    assert joins_of(found) == 2
    assert sorted(map(tuple, found.collect())) == [
        ("f", 11, 3, "Cannot query field 'nope' on type 'Q'."),
        ("f", 13, 3, "Field 'user' argument 'id' of type 'ID!' is required, but it was not provided."),
        ("f", 13, 8, "Unknown argument 'bad' on field 'Q.user'."),
    ]
