"""Usage against two schema versions: which selected fields are deprecated, removed or added.

The corpus side stays narrow and is shuffled few times: field paths are resolved once per distinct path, not once
per selection, and only paths with something to report are joined back to the selections.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions.regex import spell
from driftlens.operators.catalog import drift_lookup, in_version, is_deprecated, roots
from driftlens.operators.dedupe import distinct_inputs, distinct_issues
from driftlens.operators.tokens import selections, selections_beside
from driftlens.session import stage

# The client names, in the order in which both are tried, and the header patterns.
CLIENTS = ("Admin", "Storefront")
UNKNOWN = "Unknown"
HEADER = r"(query|mutation|subscription)\s+([A-Za-z0-9_]+)?\s*[{(]"
ROOT_FIELD = r"\{\s*([A-Za-z0-9_]+)\s*"
FRAGMENT_HEADER = r"fragment\s+([A-Za-z0-9_]+)\s+on\s+([A-Za-z0-9_]+)"

# Not the name of any operation.
FRAGMENT_KIND = " fragment"

BLOCK_KEY = ["file", "strategy", "seq", "def_no"]


def header(raw: Column) -> dict[str, Column]:
    """Operation kind and name, first field, and a fragment's name and type, by pattern; null when absent."""

    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(raw, spell(pattern), group), F.lit(""))

    return {
        "operation": part(HEADER, 1),
        "operation_name": part(HEADER, 2),
        "root_field": part(ROOT_FIELD, 1),
        "fragment_name": part(FRAGMENT_HEADER, 1),
        "fragment_type": part(FRAGMENT_HEADER, 2),
    }


def _membership(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Which of the clients' schemas have the key."""
    return rows.groupBy(*keys).agg(
        *[F.bool_or(F.col("schema") == client).alias(f"in_{client}") for client in CLIENTS]
    )


def _own_key(key: Column) -> Column:
    """A join key that is never null: rows without a key get one of their own, which matches nothing, so that they
    do not all gather in the task that handles nulls."""
    return F.coalesce(key, F.concat(F.lit(" "), F.hex(F.xxhash64(*BLOCK_KEY))))


def with_client(blocks: DataFrame, types: DataFrame, fields: DataFrame, old: str, named_roots=None) -> DataFrame:
    """Adds ``client``: the schema that alone has the block's first field, or the fragment's type."""
    old_roots = in_version(roots(types, named_roots), old)
    root_fields = in_version(fields, old).select("schema", "type_name", "field_name").join(old_roots, ["schema", "type_name"]).select(
        "schema", F.col("operation").alias("_kind"), F.col("field_name").alias("_key")
    )
    # A block asks for its first field or for its type condition, so both stand in one table and blocks are joined once.
    conditions = in_version(types, old).select("schema", F.lit(FRAGMENT_KIND).alias("_kind"), F.col("type_name").alias("_key"))
    known = _membership(root_fields.unionByName(conditions), ["_kind", "_key"])
    parts = header(F.col("raw"))
    has_fragment = parts["fragment_type"].isNotNull()
    headed = blocks.select(
        "*",
        F.when(has_fragment, FRAGMENT_KIND).otherwise(F.coalesce(parts["operation"], F.lit(""))).alias("_kind"),
        _own_key(F.when(has_fragment, parts["fragment_type"]).otherwise(parts["root_field"])).alias("_key"),
    )
    joined = headed.join(known, ["_kind", "_key"], "left")
    admin, storefront = (F.col(f"in_{c}") for c in CLIENTS)
    client = F.when(admin & ~storefront, CLIENTS[0]).when(storefront & ~admin, CLIENTS[1]).otherwise(UNKNOWN)
    return joined.select(*blocks.columns, client.alias("client"))


def with_roots(blocks: DataFrame, types: DataFrame, old: str, named_roots=None) -> DataFrame:
    """Adds ``roots``: the clients a block is checked against, with the type its selections start from.

    An unknown client means both. A fragment starts from its type condition, in the schemas that have it.
    """
    old_roots = (
        in_version(roots(types, named_roots), old)
        .groupBy(F.col("operation").alias("type"))
        .agg(F.collect_set(F.struct(F.col("schema").alias("client"), F.col("type_name").alias("root"))).alias("op_roots"))
    )
    having = (
        in_version(types, old)
        .groupBy(F.col("type_name").alias("_condition"))
        .agg(F.collect_set("schema").alias("schemas"))
    )
    # Only fragments look for their type; the other blocks meet one row per kind of operation, three at most, whatever the data.
    is_fragment = F.coalesce(F.col("type") == "fragment", F.lit(False))
    fragments = blocks.filter(is_fragment).withColumn("_condition", _own_key(F.col("type_condition"))).join(having, "_condition", "left")
    of_fragment = F.transform(
        "schemas", lambda s: F.struct(s.alias("client"), F.col("type_condition").alias("root"))
    )
    others = blocks.filter(~is_fragment).join(F.broadcast(old_roots), "type", "left")

    def allowed(joined: DataFrame, every: Column) -> DataFrame:
        own = F.filter(every, lambda r: (F.col("client") == UNKNOWN) | (r["client"] == F.col("client")))
        return joined.select(*blocks.columns, F.coalesce(own, F.array().cast("array<struct<client:string,root:string>>")).alias("roots"))

    return allowed(fragments, of_fragment).unionByName(allowed(others, F.col("op_roots")))


def block_selections(blocks: DataFrame) -> DataFrame:
    """Selections of blocks that parse, with the block's ``start_line``, ``type``, ``roots`` and so on."""
    good = blocks.filter(F.col("error").isNull())
    return selections_beside(good, BLOCK_KEY, [
        "type", F.col("name").alias("block_name"), F.col("type_condition").alias("block_condition"),
        F.col("client").alias("block_client"), "start_line", "roots",
    ])


def uses_of(fields: DataFrame) -> DataFrame:
    """Field rows once per client they are checked against; ``root`` is the type their path starts from."""
    return fields.select("file", "start_line", "depth", "path", "name", "line", "col", F.inline("roots"))


def expand_spreads(found: DataFrame, lookup: DataFrame) -> DataFrame:
    """Field rows of blocks once per client, with the fields of all fragments that a block reaches.

    ``found`` should be a staged table: it is read several times. A fragment is looked up by name in the whole file; the last
    definition counts. Its fields start from its type condition, so what it says depends on the client alone, not on the
    way that led to it: every block has the fields of a fragment it reaches once, below the type condition, however many
    spreads lead there. A spread counts where the path to it can be walked.
    """
    direct = uses_of(found.filter("kind = 'field'"))
    spreads = found.filter("kind = 'spread'").select("file", "start_line", F.inline("roots"), "path", F.col("name").alias("to"))
    spreads = stage(spreads.distinct(), "spreads")
    if spreads.isEmpty():
        return direct
    last = (
        found.filter("type = 'fragment'")
        .groupBy("file", "block_name")
        .agg(F.max_by(F.struct(*BLOCK_KEY[1:]), F.struct("start_line", *BLOCK_KEY[1:])).alias("k"))
        .select("file", "k.*")
    )
    below = F.concat_ws("/", F.concat(F.lit(":"), "block_condition"), F.nullif("path", F.lit("")))
    inside = found.join(last, BLOCK_KEY, "left_semi").filter("kind IN ('field', 'spread')").select(
        "file", F.col("block_name").alias("fragment"), F.col("block_condition").alias("root"), "kind", "name", "depth",
        below.alias("path"), "line", "col",
    )
    inside = stage(inside, "fragments")
    leads = inside.filter("kind = 'spread'").select("file", "fragment", "root", "path", F.col("name").alias("to"))
    leads = leads.join(spreads.select("file", "client").distinct(), "file")
    place = ["client", "root", "path"]
    walked = walk(spreads.select(*place).union(leads.select(*place)), lookup)
    alive = stage(walked.select("end"), "alive")
    starts = spreads.join(alive, path_id() == F.col("end"), "left_semi")
    leads = leads.join(alive, path_id() == F.col("end"), "left_semi")
    starts = starts.groupBy("file", "client", "start_line").agg(F.collect_set("to").alias("to"))
    # One file's spreads are one value: a text bounds them.
    leads = leads.groupBy("file", "client").agg(F.collect_set(F.struct("fragment", "to")).alias("leads"))
    reached = _reached(starts.join(leads, ["file", "client"], "left"))
    entered = reached.join(inside.filter("kind = 'field'").drop("kind"), ["file", "fragment"])
    return direct.unionByName(entered.select(*direct.columns))


def spread_places(found: DataFrame) -> DataFrame:
    """Field rows of blocks once per client, with the fields of spread fragments below every place that spreads them.

    Unlike ``expand_spreads`` this tells each way that leads to a fragment: the path is the spread's, the type condition and the
    path in the fragment, the depth that of both, whether or not a version knows the field above. ``found`` should be a
    staged table. The last definition of a name in the file counts. Rounds go on until no spread is left; a path that
    enters a fragment for the second time ends there, as all that would follow has been seen on it.
    """
    keep = ["file", "start_line", "roots", "depth", "path", "name", "line", "col"]
    fields = found.filter("kind = 'field'").select(*keep)
    nothing = F.array().cast("array<string>")
    frontier = found.filter("kind = 'spread'").select(*keep[:-2], nothing.alias("entered")).distinct()
    last = (
        found.filter("type = 'fragment'")
        .groupBy("file", "block_name")
        .agg(F.max_by(F.struct(*BLOCK_KEY[1:]), F.struct("start_line", *BLOCK_KEY[1:])).alias("k"))
        .select("file", "k.*")
    )
    inside = found.join(last, BLOCK_KEY, "left_semi").filter("kind IN ('field', 'spread')").select(
        "file", F.col("block_name").alias("fragment"), F.col("block_condition").alias("condition"), "kind",
        F.col("name").alias("in_name"), F.col("depth").alias("in_depth"), F.col("path").alias("in_path"), "line", "col",
    )
    inside = stage(inside, "fragments")
    below = F.concat_ws("/", F.nullif("path", F.lit("")), F.concat(F.lit(":"), "condition"), F.nullif("in_path", F.lit("")))
    whole = fields
    while not frontier.isEmpty():
        grown = (
            frontier.withColumnRenamed("name", "fragment")
            .filter(~F.array_contains("entered", F.col("fragment")))
            .join(inside, ["file", "fragment"])
            .select(
                "file", "start_line", "roots", (F.col("depth") + F.col("in_depth")).cast("int").alias("depth"), below.alias("path"),
                F.col("in_name").alias("name"), "line", "col", "kind", F.array_append("entered", F.col("fragment")).alias("entered"),
            )
        )
        grown = stage(grown, "spread")
        whole = whole.unionByName(grown.filter("kind = 'field'").select(*keep))
        frontier = grown.filter("kind = 'spread'").select(*keep[:-2], "entered").distinct()
    return uses_of(whole)


def _reached(starts: DataFrame) -> DataFrame:
    """``file, client, start_line, fragment``: what the fragments ``to`` lead to over the pairs ``leads``, themselves included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            # Both sides of the pairs as lists of their own: rows of dictionaries take several times as long.
            pairs = batch.column("leads")
            sides = pairs.flatten()
            froms, tos = sides.field("fragment").to_pylist(), sides.field("to").to_pylist()
            end = 0
            for first, n in zip(batch.column("to").to_pylist(), pc.list_value_length(pairs).to_pylist()):
                start, end = end, end + (n or 0)
                after: dict[str, list[str]] = {}
                for lead, to in zip(froms[start:end], tos[start:end]):
                    after.setdefault(lead, []).append(to)
                seen, waiting = set(first), list(first)
                while waiting:
                    fresh = [to for to in after.get(waiting.pop(), ()) if to not in seen]
                    seen.update(fresh)
                    waiting += fresh
                rows.append(sorted(seen))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in ("file", "client", "start_line")), pa.array(rows, pa.list_(pa.string()))],
                names=["file", "client", "start_line", "fragments"],
            )

    schema = "file string, client string, start_line int, fragments array<string>"
    return starts.mapInArrow(run, schema).select("file", "client", "start_line", F.explode("fragments").alias("fragment"))


def path_id(client: str = "client", root: str = "root", path: Column | str = "path") -> Column:
    """A number for a path from a root."""
    return F.xxhash64(client, root, path)


def walk(paths: DataFrame, lookup: DataFrame) -> DataFrame:
    """``end, at``: the number of each path of ``client, root, path`` that can be walked, and the type it ends at.

    The paths become a trie: one row per distinct prefix. Each round walks one level, one step for each prefix, and is
    written down, so a prefix is looked up once however many paths share it, and no plan grows with the depth.
    """
    steps = F.when(F.col("path") != "", F.split("path", "/")).otherwise(F.array().cast("array<string>"))
    split = paths.distinct().withColumn("steps", steps)
    prefix = lambda k: path_id(path=F.array_join(F.slice("steps", F.lit(1), k), "/"))
    every = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("steps")), lambda k: k > 0),
        lambda k: F.struct(k.alias("level"), prefix(k).alias("end"), prefix(k - 1).alias("before"), F.element_at("steps", k).alias("step")),
    )
    trie = stage(split.select("client", F.inline(every)).distinct(), "trie")
    longest = trie.agg(F.max("level")).first()[0] or 0
    known = [stage(paths.select(path_id(path=F.lit("")).alias("end"), F.col("root").alias("at")).distinct(), "walked")]
    for level in range(1, longest + 1):
        rows = trie.filter(F.col("level") == level).drop("level").join(known[-1].withColumnRenamed("end", "before"), "before")
        by_field = F.col("step").startswith(".")
        name = F.substring("step", F.lit(2), F.length("step"))
        rows = _look_up(rows, lookup, F.when(by_field, F.col("at")), name, F.concat(F.lit(" "), F.hex("end")))
        to = F.when(by_field, F.coalesce(F.col("old.named_type"), new_field(name)["named_type"])).otherwise(F.nullif(name, F.lit("")))
        known.append(stage(rows.select("end", to.alias("at")).filter("at IS NOT NULL"), "walked"))
    whole = known[0]
    for part in known[1:]:
        whole = whole.unionByName(part)
    return whole


def resolve_paths(uses: DataFrame, lookup: DataFrame) -> DataFrame:
    """For every distinct ``(client, root, path, name)`` the parent type and what both versions know of the field."""
    paths = stage(uses.select("client", "root", "path", "name").distinct(), "paths")
    rows = paths.join(walk(paths.select("client", "root", "path"), lookup), path_id() == F.col("end")).drop("end")
    nowhere = F.concat(F.lit(" "), F.hex(path_id()))
    rows = _look_up(rows, lookup, F.col("at"), F.col("name"), nowhere)
    return rows.select(
        "client", "root", "path", "name",
        F.col("at").alias("type_name"),
        "old",
        new_field(F.col("name")).alias("new"),
    )


def new_field(used: Column) -> Column:
    """The new version's field: in the old version's spelling, else as it is used."""

    def spelled(name: Column) -> Column:
        return F.try_element_at(F.filter("new_names", lambda n: n["field_name"] == name), F.lit(1))

    return F.coalesce(spelled(F.col("old.field_name")), spelled(used))


def _look_up(rows: DataFrame, lookup: DataFrame, type_name: Column, name: Column, nowhere: Column) -> DataFrame:
    """Left join with the lookup; without a type the key is one that matches nothing and is the row's own."""
    left = rows.withColumn("_type", F.coalesce(type_name, nowhere)).withColumn("_low", F.lower(name))
    right = lookup.select(
        F.col("schema").alias("_schema"), F.col("type_name").alias("_of"), F.col("low").alias("_key"), "old", "new_names"
    )
    on = (
        (left["client"] == right["_schema"]) & (left["_type"] == right["_of"]) & (left["_low"] == right["_key"])
    )
    return left.join(right, on, "left").drop("_schema", "_of", "_key", "_type", "_low")


def path_status(resolved: DataFrame) -> DataFrame:
    """One row per path and kind of drift: DEPRECATED, REMOVED, ADDED; a field may have two."""
    old, new = F.col("old"), F.col("new")
    reason = F.coalesce(old["deprecation_reason"], F.lit("None"))

    def status(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("reason"))

    kinds = F.array_compact(
        F.array(
            F.when(
                F.coalesce(old["is_deprecated"], F.lit(False)),
                status("DEPRECATED", F.concat(F.lit("is deprecated in old schema: "), reason)),
            ),
            F.when(old.isNotNull() & new.isNull(), status("REMOVED", F.lit("was removed in new schema"))),
            F.when(old.isNull() & new.isNotNull(), status("ADDED", F.lit("was added in new schema"))),
        )
    )
    return resolved.select("client", "root", "path", "name", "type_name", F.inline(kinds))


def drift_message(kind: Column, field: Column, type_name: Column, reason: Column, client: Column) -> Column:
    return F.concat(
        F.lit("["), kind, F.lit("] Field '"), field, F.lit("' in type '"), type_name, F.lit("' "), reason,
        F.when(client.isin(*CLIENTS), F.concat(F.lit(" ("), client, F.lit(")"))).otherwise(""),
    )


def usage_drift(
    blocks: DataFrame,
    types: DataFrame,
    fields: DataFrame,
    old: str,
    new: str,
    named_roots: DataFrame | None = None,
    strict_added: bool = False,
) -> DataFrame:
    """Issues for every deprecated, removed or added field the blocks select.

    ``blocks`` are deduplicated operation blocks. Result: ``file, line, column, level, kind, type_name, field_name,
    reason, client, message``.
    """
    rooted = stage(rooted_blocks(blocks, types, fields, old, named_roots), "blocks")
    found = stage(block_selections(rooted), "selections")
    return drift_of(found, types, fields, old, new, strict_added)


def rooted_blocks(
    blocks: DataFrame, types: DataFrame, fields: DataFrame, old: str, named_roots: DataFrame | None = None
) -> DataFrame:
    """Blocks with their client and the types their selections start from."""
    return with_roots(with_client(blocks, types, fields, old, named_roots), types, old, named_roots)


def drift_of(
    found: DataFrame, types: DataFrame, fields: DataFrame, old: str, new: str, strict_added: bool = False
) -> DataFrame:
    """Drift issues of ``found``, the staged selections of blocks."""
    lookup = stage(drift_lookup(types, fields, old, new, strict_added), "lookup")
    uses = stage(expand_spreads(found, lookup), "uses")
    flagged = path_status(resolve_paths(uses, lookup))
    issues = uses.join(flagged, ["client", "root", "path", "name"]).select(
        "file",
        (F.col("start_line") + F.col("line")).cast("int").alias("line"),
        (F.col("col") + 1).cast("int").alias("column"),
        F.lit("warning").alias("level"),
        "kind",
        "type_name",
        F.col("name").alias("field_name"),
        "reason",
        "client",
    )
    issues = issues.withColumn(
        "message", drift_message(F.col("kind"), F.col("field_name"), F.col("type_name"), F.col("reason"), F.col("client"))
    )
    return distinct_issues(issues)


def deprecated_inputs(
    blocks: DataFrame, types: DataFrame, args: DataFrame, inputs: DataFrame, old: str, client: str = CLIENTS[0],
    named_roots: DataFrame | None = None,
) -> DataFrame:
    """Deprecated fields of the input types that a mutation's arguments have."""
    mutations = blocks.filter((F.col("type") == "mutation") & F.col("error").isNull())
    called = selections(mutations, [*BLOCK_KEY, "start_line"]).filter("depth = 1 AND kind = 'field'")
    root = in_version(roots(types, named_roots), old).filter((F.col("schema") == client) & (F.col("operation") == "mutation"))
    arg_types = (
        in_version(args, old).filter(F.col("schema") == client)
        .join(root.select("schema", "type_name"), ["schema", "type_name"], "left_semi")
        .select(F.col("field_name").alias("name"), F.col("named_type").alias("input_type"))
        .distinct()
    )
    flagged = in_version(inputs, old).filter((F.col("schema") == client) & is_deprecated()).select(
        F.col("type_name").alias("input_type"), "field_name", F.coalesce("deprecation_reason", F.lit("")).alias("reason")
    )
    issues = (
        # Arguments come several to a row of their table, so Spark takes them for far fewer: sorted at every size, not broadcast. They are
        # joined with what is called first, as each has all flagged fields of its type.
        called.join(arg_types.hint("merge"), "name").join(flagged, "input_type")
        .select(
            "file",
            F.col("start_line").alias("line"),
            F.lit(1).alias("column"),
            F.lit("warning").alias("level"),
            F.lit("INPUT").alias("kind"),
            F.col("input_type").alias("type_name"),
            "field_name",
            "reason",
            F.concat(
                F.lit("[INPUT] Field '"), "field_name", F.lit("' in input type '"), "input_type",
                F.lit("' is deprecated: "), "reason",
            ).alias("message"),
        )
    )
    return distinct_inputs(issues)
