"""The same results as ANSI SQL over the tables.

Where a query runs on planted texts, the SQL states what was planted: it never repeats the pattern under test.
"""

from __future__ import annotations

from driftlens.corpora import planted
from driftlens.corpora.derived import FIRST_NEW, LAST_OLD, NEW, OLD
from driftlens.operators import issues as issue_values
from driftlens.plans import queries

N = len(planted.SOURCES)
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
W = r"[\p{L}\p{N}_]"


def lit(value) -> str:
    if value is None:
        return "CAST(NULL AS VARCHAR)"
    if isinstance(value, int):
        return f"CAST({value} AS BIGINT)"
    return "'" + value.replace("'", "''") + "'"


def values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


def filled(column: str) -> str:
    return (
        f"replace(replace(replace({column}, '<k1>', CAST(k1 AS VARCHAR)), '<k>', CAST(k AS VARCHAR)), '<o>', CAST(o AS VARCHAR))"
    )


ORDERS = (
    "o AS (SELECT o_orderkey AS o, o_orderkey // 2 AS k, o_orderkey // 2 + 1 AS k1, "
    "'src/c' || o_custkey || '/o' || o_orderkey || '.py' AS file FROM orders)"
)
BLOCKS = (
    f"{ORDERS}, planted(tpl, type, name, raw, s, e) AS ({values(planted.BLOCKS)}), "
    f"blocks AS (SELECT file, o, k, k1, tpl, type, {filled('name')} AS name, {filled('raw')} AS raw, s AS start_line, "
    f"e AS end_line FROM o JOIN planted ON o % {N} = tpl)"
)

# The blocks of the standalone documents next to those of the sources, under template numbers of their own.
DOCUMENT_ROWS = (
    (90, "query", "A<o>", "query A<o> {\n  t<k> { f0 }\n}", 3, 5),
    (91, "mutation", "B<o>", "mutation B<o>($x: Int = 3, $y: [String!]) {\n  m<k>(a: $x, b: {c: $y}) { f1 }\n}", 7, 9),
    (92, "query", None, "{ t<k> { f2 } }", 10, 10),
)
DOCUMENT_SELECTED = (
    (90, "query", "t<k>", ""), (90, "query", "f0", ".t<k>"), (91, "mutation", "m<k>", ""), (91, "mutation", "f1", ".m<k>"),
    (92, "query", "t<k>", ""), (92, "query", "f2", ".t<k>"),
)
ALL_BLOCKS = (
    f"{ORDERS}, planted(tpl, type, name, raw, s, e) AS ({values(planted.BLOCKS)}), "
    f"in_documents(tpl, type, name, raw, s, e) AS ({values(DOCUMENT_ROWS)}), "
    "c AS (SELECT c_custkey AS o, c_custkey AS k, c_custkey AS k1, 'gql/c' || c_custkey || '.graphql' AS file FROM customer), "
    f"blocks AS (SELECT file, o, k, k1, tpl, type, {filled('name')} AS name, {filled('raw')} AS raw, s AS start_line, "
    f"e AS end_line FROM o JOIN planted ON o % {N} = tpl UNION ALL SELECT file, o, k, k1, tpl, type, {filled('name')}, {filled('raw')}, s, e "
    "FROM c CROSS JOIN in_documents)"
)

# Template 3 lacks a value, template 5 a closing brace.
PARSE_ERRORS = """SELECT file, start_line AS line, CASE tpl WHEN 3 THEN instr(raw, ')') ELSE length(raw) + 1 END AS "column",
      'error' AS level, '[GRAPHQL_PARSE] Syntax Error: ' || CASE tpl WHEN 3 THEN 'Unexpected '')''.' ELSE 'Expected Name, found <EOF>.' END
      AS message FROM blocks WHERE type = 'unknown'"""
WRONG = values([(i, *row) for i, row in enumerate(planted.WRONG)])

# The catalogue, from the line items.
SCHEMA = f"""
items AS (
  SELECT CASE WHEN (l_orderkey // 2) // 2 % 2 = 0 THEN 'Admin' ELSE 'Storefront' END AS schema, l_orderkey // 2 AS k,
         l_partkey % 7 AS p, l_returnflag = 'R' AS r, l_shipdate < TIMESTAMP '{LAST_OLD}' AS is_old,
         l_shipdate >= TIMESTAMP '{FIRST_NEW}' AS is_new
  FROM lineitem),
seen AS (SELECT schema, '{OLD}' AS version, k, p, r FROM items WHERE is_old
         UNION ALL SELECT schema, '{NEW}', k, p, r FROM items WHERE is_new),
own AS (SELECT schema, version, k, p, bool_or(r) AS r FROM seen GROUP BY schema, version, k, p),
starts AS (SELECT DISTINCT schema, version, k FROM own),
fields AS (
  SELECT schema, version, 'T' || k AS type_name, 'f' || p AS field_name, r AS is_deprecated,
         CASE WHEN r AND p <> 3 THEN 'use f' || ((p + 1) % 7) END AS deprecation_reason,
         CASE WHEN p = 0 THEN 'T' || (k + 1) ELSE 'String' END AS named_type FROM own
  UNION ALL
  SELECT schema, version, 'QueryRoot', 't' || k, k % 10 = 0, CASE WHEN k % 10 = 0 THEN 'legacy' END, 'T' || k FROM starts
  UNION ALL
  SELECT schema, version, 'Mutation', 'm' || k, k % 10 = 0, CASE WHEN k % 10 = 0 THEN 'legacy' END, 'T' || k FROM starts
  WHERE k % 3 = 0),
types AS (SELECT DISTINCT schema, version, type_name FROM fields),
old_types AS (SELECT schema, type_name FROM types WHERE version = '{OLD}'),
new_types AS (SELECT schema, type_name FROM types WHERE version = '{NEW}'),
old_fields AS (SELECT * FROM fields WHERE version = '{OLD}'),
new_fields AS (SELECT * FROM fields WHERE version = '{NEW}'),
common AS (SELECT * FROM old_types INTERSECT SELECT * FROM new_types)"""

DIFF = f"""{SCHEMA},
diff AS (
  SELECT coalesce(a.schema, b.schema) AS schema, coalesce(a.type_name, b.type_name) AS type_name,
         coalesce(a.field_name, b.field_name) AS field_name,
         CASE WHEN b.field_name IS NULL THEN 'removed' WHEN a.field_name IS NULL THEN 'added' ELSE 'kept' END AS status,
         coalesce(a.is_deprecated, FALSE) AS is_deprecated,
         CASE WHEN a.is_deprecated THEN coalesce(a.deprecation_reason, 'Deprecated') END AS reason
  FROM old_fields a FULL OUTER JOIN new_fields b USING (schema, type_name, field_name)),
field_diff AS (SELECT d.* FROM diff d JOIN common USING (schema, type_name)),
changes AS (
  SELECT schema, 'removed_types' AS change, type_name, CAST(NULL AS VARCHAR) AS field_name, CAST(NULL AS VARCHAR) AS reason
  FROM (SELECT * FROM old_types EXCEPT SELECT * FROM new_types)
  UNION ALL SELECT schema, 'added_types', type_name, NULL, NULL FROM (SELECT * FROM new_types EXCEPT SELECT * FROM old_types)
  UNION ALL SELECT schema, 'removed_fields', type_name, field_name, NULL FROM field_diff WHERE status = 'removed'
  UNION ALL SELECT schema, 'added_fields', type_name, field_name, NULL FROM field_diff WHERE status = 'added'
  UNION ALL SELECT schema, 'deprecated_fields', type_name, field_name, reason FROM field_diff WHERE is_deprecated)"""

# Blocks with their client and start type; the selections planted in them; each selection's parent type.
CLIENTS = f"""{ALL_BLOCKS}, {SCHEMA},
roots AS (SELECT schema, 'query' AS operation, 'QueryRoot' AS root FROM old_types WHERE type_name = 'QueryRoot'
          UNION ALL SELECT schema, 'mutation', 'Mutation' FROM old_types WHERE type_name = 'Mutation'),
entry AS (  -- a shorthand block has no header, so its client stays unknown
  SELECT b.*, CASE WHEN tpl = 92 THEN NULL WHEN type = 'mutation' THEN 'm' || k ELSE 't' || k END AS root_field FROM blocks b),
attributed AS (
  SELECT e.*,
    CASE WHEN type = 'fragment' THEN EXISTS (SELECT 1 FROM old_types t WHERE t.schema = 'Admin' AND t.type_name = 'T' || e.k)
         ELSE EXISTS (SELECT 1 FROM old_fields f JOIN roots r ON f.schema = r.schema AND f.type_name = r.root
           WHERE f.schema = 'Admin' AND r.operation = coalesce(nullif(e.type, 'unknown'), 'query') AND f.field_name = e.root_field) END AS a,
    CASE WHEN type = 'fragment' THEN EXISTS (SELECT 1 FROM old_types t WHERE t.schema = 'Storefront' AND t.type_name = 'T' || e.k)
         ELSE EXISTS (SELECT 1 FROM old_fields f JOIN roots r ON f.schema = r.schema AND f.type_name = r.root
           WHERE f.schema = 'Storefront' AND r.operation = coalesce(nullif(e.type, 'unknown'), 'query') AND f.field_name = e.root_field) END AS s
  FROM entry e),
clients AS (SELECT *, CASE WHEN a AND NOT s THEN 'Admin' WHEN s AND NOT a THEN 'Storefront' ELSE 'Unknown' END AS client FROM attributed),
rooted AS (
  SELECT c.*, r.schema AS checked, r.root FROM clients c JOIN roots r ON r.operation = c.type
  WHERE c.client = 'Unknown' OR c.client = r.schema
  UNION ALL
  SELECT c.*, t.schema, t.type_name FROM clients c JOIN old_types t ON c.type = 'fragment' AND t.type_name = 'T' || c.k
  WHERE c.client = 'Unknown' OR c.client = t.schema)"""

USES = f"""{CLIENTS},
old_eff AS (
  SELECT schema, type_name, field_name, is_deprecated OR deprecation_reason IS NOT NULL AS is_deprecated, deprecation_reason, named_type
  FROM (SELECT * FROM old_fields UNION ALL
        SELECT n.* FROM new_fields n WHERE NOT EXISTS (SELECT 1 FROM old_types t WHERE t.schema = n.schema AND t.type_name = n.type_name))),
any_field AS (SELECT schema, type_name, field_name, max(named_type) AS named_type FROM
  (SELECT schema, type_name, field_name, named_type FROM old_eff UNION ALL SELECT schema, type_name, field_name, named_type FROM new_fields)
  GROUP BY schema, type_name, field_name),
selected(tpl, type, name, path) AS ({values((*planted.SELECTED, *DOCUMENT_SELECTED))}),
direct AS (
  SELECT r.file, r.o, r.k, r.k1, r.tpl, r.type, r.checked AS client, r.client AS found, r.root, r.raw, r.start_line, {filled('s.name')} AS name,
         {filled('s.path')} AS path, length(s.path) - length(replace(s.path, '/', '')) + CASE WHEN s.path = '' THEN 0 ELSE 1 END + 1 AS depth
  FROM rooted r JOIN selected s USING (tpl, type)),
spreads AS (
  SELECT q.file, q.o, q.k, q.k1, q.tpl, q.type, q.checked AS client, q.client AS found, 'T' || q.k AS root, f.raw, q.start_line, n.name,
         ':T' || q.k AS path, 1 AS depth
  FROM rooted q JOIN blocks f ON f.file = q.file AND f.type = 'fragment' AND q.tpl = 6 AND q.type = 'query'
  CROSS JOIN (VALUES ('f1'), ('f2')) n(name)
  WHERE EXISTS (SELECT 1 FROM any_field a WHERE a.schema = q.checked AND a.type_name = q.root AND a.field_name = 't' || q.k)),
uses AS (
  SELECT u.*, instr(raw, name) AS pos FROM (SELECT * FROM direct UNION ALL SELECT * FROM spreads) u),
placed AS (
  SELECT u.*, length(before) - length(replace(before, chr(10), '')) + 1 AS line,
         length(before) - CASE WHEN instr(before, chr(10)) = 0 THEN 0 ELSE length(before) - instr(reverse(before), chr(10)) + 1 END + 1 AS col
  FROM (SELECT *, substr(raw, 1, pos - 1) AS before FROM uses) u),
walked AS (
  SELECT p.*,
    CASE WHEN path = '' OR path LIKE ':T%' THEN root
         WHEN path LIKE '%/.f0%' THEN (SELECT b.named_type FROM any_field a JOIN any_field b ON b.schema = a.schema AND b.type_name = a.named_type AND b.field_name = 'f0'
              WHERE a.schema = p.client AND a.type_name = p.root AND a.field_name = 't' || p.k)
         ELSE (SELECT a.named_type FROM any_field a WHERE a.schema = p.client AND a.type_name = p.root
              AND a.field_name = CASE WHEN path LIKE '.m%' THEN 'm' ELSE 't' END || p.k) END AS type_name
  FROM placed p),
resolved AS (
  SELECT w.file, w.client, w.root, w.path, w.name, w.type_name, w.depth, w.line, w.col, w.start_line,
         o.field_name AS old_field, o.is_deprecated, o.deprecation_reason, n.field_name AS new_field
  FROM walked w
  LEFT JOIN old_eff o ON o.schema = w.client AND o.type_name = w.type_name AND o.field_name = lower(w.name)
  LEFT JOIN new_fields n ON n.schema = w.client AND n.type_name = w.type_name AND n.field_name = coalesce(o.field_name, w.name)
  WHERE w.type_name IS NOT NULL),
drift AS (
  SELECT *, 'DEPRECATED' AS kind, 'is deprecated in old schema: ' || coalesce(deprecation_reason, 'None') AS reason FROM resolved WHERE is_deprecated
  UNION ALL SELECT *, 'REMOVED', 'was removed in new schema' FROM resolved WHERE old_field IS NOT NULL AND new_field IS NULL
  UNION ALL SELECT *, 'ADDED', 'was added in new schema' FROM resolved WHERE old_field IS NULL AND new_field IS NOT NULL),
drift_issues AS (
  SELECT file, start_line + line AS line, col + 1 AS "column", 'warning' AS level, kind, type_name, name AS field_name, reason,
         min(client) AS client,
         '[' || kind || '] Field ''' || name || ''' in type ''' || type_name || ''' ' || reason || ' (' || min(client) || ')' AS message
  FROM drift GROUP BY file, start_line + line, col + 1, kind, type_name, name, reason)"""

# The same with the fields of a fragment below every place that spreads it, whether or not a version knows the field above.
PLACES = USES.replace("'T' || q.k AS root, f.raw", "q.root, f.raw").replace(
    "':T' || q.k AS path, 1 AS depth", "'.t' || q.k || '/:T' || q.k AS path, 3 AS depth"
).replace(
    """
  WHERE EXISTS (SELECT 1 FROM any_field a WHERE a.schema = q.checked AND a.type_name = q.root AND a.field_name = 't' || q.k))""", ")"
).replace("CASE WHEN path = '' OR path LIKE ':T%' THEN root", "CASE WHEN path = '' THEN root")

# Selections against the old schema alone; a block of an unknown client counts for the first one.
CHECKED = f"""{USES},
chain AS (
  SELECT p.*,
    CASE WHEN path = '' THEN root
         WHEN path LIKE '%/.f0%' THEN (SELECT b.named_type FROM old_fields a JOIN old_fields b ON b.schema = a.schema AND b.type_name = a.named_type AND b.field_name = 'f0'
              WHERE a.schema = p.client AND a.type_name = p.root AND a.field_name = 't' || p.k)
         ELSE (SELECT a.named_type FROM old_fields a WHERE a.schema = p.client AND a.type_name = p.root
              AND a.field_name = CASE WHEN path LIKE '.m%' THEN 'm' ELSE 't' END || p.k) END AS at_type
  FROM placed p WHERE path NOT LIKE ':T%' AND path NOT LIKE '.t%/.f0/:T%' AND NOT (found = 'Unknown' AND client = 'Storefront')
  UNION ALL
  SELECT p.*, (SELECT b.named_type FROM old_fields a JOIN old_fields b ON b.schema = a.schema AND b.type_name = a.named_type AND b.field_name = 'f0'
              WHERE a.schema = p.client AND a.type_name = p.root AND a.field_name = 't' || p.k)
  FROM placed p WHERE path LIKE '.t%/.f0/:T%' AND NOT (found = 'Unknown' AND client = 'Storefront')),
checked AS (
  SELECT c.*, EXISTS (SELECT 1 FROM old_fields f WHERE f.schema = c.client AND f.type_name = c.at_type AND f.field_name = c.name) AS known,
         EXISTS (SELECT 1 FROM old_types t WHERE t.schema = c.client AND t.type_name = c.at_type) AS is_object
  FROM chain c WHERE at_type IS NOT NULL),
root_uses AS (SELECT * FROM checked WHERE known AND path = '' AND root <> 'T' || k),
arguments AS (
  SELECT file, start_line + line - 1 AS line, col AS "column", 'GRAPHQL_VALIDATION' AS kind, 'warning' AS level,
    '[GRAPHQL_VALIDATION] Cannot query field ''' || name || ''' on type ''' || at_type || '''.' AS message
  FROM checked WHERE is_object AND NOT known
  UNION ALL
  SELECT file, start_line + line - 1, col, 'EXTRA_FIELD', 'warning',
    '[EXTRA_FIELD] Unknown argument ''' || CASE tpl WHEN 2 THEN 'first' ELSE 'id' END || ''' on field ''' || root || '.' || name || '''.'
  FROM (SELECT r.* REPLACE (col + length(name) + 1 AS col) FROM root_uses r WHERE tpl IN (2, 3))
  WHERE k NOT IN (SELECT p_partkey FROM part)
  UNION ALL
  SELECT file, start_line + line - 1, col + length(name) + CASE arg WHEN 'a' THEN 1 ELSE 8 END, 'EXTRA_FIELD', 'warning',
    '[EXTRA_FIELD] Unknown argument ''' || arg || ''' on field ''' || root || '.' || name || '''.'
  FROM root_uses CROSS JOIN (VALUES ('a'), ('b')) v(arg) WHERE tpl = 91
  UNION ALL
  SELECT file, start_line + line - 1, col, 'MISSING_REQUIRED_ARG', 'error',
    '[MISSING_REQUIRED_ARG] Field ''' || name || ''' argument ''id'' of type ''I' || (k % 100) || '!'' is required, but it was not provided.'
  FROM root_uses JOIN part ON p_partkey = k AND p_size > 25 WHERE tpl <> 3)"""

ISSUES = """
issues AS (
  SELECT 'f' || user_id AS file, event_id % 500 AS line, event_id % 80 + 1 AS "column",
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END AS level, event_id, event_type,
    CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN '[DEPRECATED] Field ''email'' in type ''C'' is deprecated in old schema: use defaultEmailAddress.emailAddress (Admin)'
      WHEN event_type = 'signup' AND event_id % 3 = 0 THEN '[DEPRECATED] Field ''userErrors'' in type ''P'' is deprecated in old schema: x'
      WHEN event_type = 'signup' THEN '[DEPRECATED] Field ''a'' in type ''P'' is deprecated in old schema: x'
      WHEN event_type = 'error' THEN '[GRAPHQL_SYNTAX] Invalid syntax'
      WHEN event_type = 'click' THEN '[REMOVED] Field ''b'' in type ''P'' was removed in new schema'
      WHEN event_type = 'view' AND event_id % 2 = 0 THEN '[PYDANTIC_REQUIRED_FIELD] Field ''c'' in model ''M'' has no default value'
      WHEN event_type = 'view' THEN '[GRAPHQL_VALIDATION] GraphQL parsing error: Inline fragment'
      WHEN event_id % 4 = 0 THEN '[ADDED] Field ''d'' in type ''P'' was added in new schema'
      WHEN event_id % 4 = 1 THEN '[MISSING_REQUIRED_ARG] Field ''e'' argument ''x'' of type ''Y'' is required'
      WHEN event_id % 4 = 2 THEN '[PYDANTIC_TYPE_MISMATCH] count field should be int, not str'
      ELSE 'max_length constraint found in model ''M''' END AS message,
    CASE WHEN event_type = 'signup' THEN 'DEPRECATED' WHEN event_type = 'error' THEN 'GRAPHQL_VALIDATION'
      WHEN event_type = 'click' THEN 'REMOVED' WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'PYDANTIC_REQUIRED_FIELD'
      WHEN event_type = 'view' THEN 'GRAPHQL_VALIDATION' WHEN event_id % 4 = 0 THEN 'ADDED' ELSE 'OTHER' END AS category,
    CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'Replace ''email'' field with ''defaultEmailAddress.emailAddress'''
      WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'Replace ''userErrors'' with ''customerUserErrors'''
      WHEN event_type = 'signup' THEN 'Replace with the suggested alternative field from the deprecation message'
      WHEN event_type = 'error' THEN 'Review the code for the specific issue mentioned in the error'
      WHEN event_type = 'click' THEN 'Remove this field as it no longer exists in the schema'
      WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'Add default value or make field optional if appropriate'
      WHEN event_type = 'view' THEN 'Verify inline fragment type compatibility with parent context'
      WHEN event_id % 4 = 0 THEN 'This field is new - consider if you need to handle it'
      WHEN event_id % 4 = 1 THEN 'Add the required argument to the field'
      ELSE 'Review the code for the specific issue mentioned in the error' END AS fix
  FROM events)"""


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


def candidates(strategy: int, templates: tuple[int, ...] | None = None, only: str = "") -> str:
    rows = [
        (tpl, body, first, last)
        for tpl, number, body, first, last in planted.CANDIDATES
        if number == strategy and (templates is None or tpl in templates) and only in body
    ]
    return with_(
        f"{ORDERS}, planted(tpl, body, s, e) AS ({values(rows)})",
        f"SELECT file, s AS start_line, e AS end_line, md5({filled('body')}) AS body FROM o JOIN planted ON o % {N} = tpl",
    )


def located(rows, columns: str) -> str:
    return with_(
        f"{ORDERS}, planted(tpl, {columns}) AS ({values(rows)})",
        f"SELECT file, {columns} FROM o JOIN planted ON o % {N} = tpl",
    )


def words(table: str, keys: str, text: str) -> str:
    """Suspicious words with their places: the text is cut before each word, and the parts before it are measured."""
    word = f"(?:nonExistent|invalid|unknown|test|dummy|extra){W}*"
    first = f"[^{W[1:-1]}]"
    return f"""
WITH cut AS (SELECT {keys}, string_split(regexp_replace({text}, '(^|{first})({word})', '\\1' || chr(1) || '\\2', 'gi'), chr(1)) AS parts FROM {table}),
numbered AS (SELECT {keys}, parts, unnest(range(2, len(parts) + 1)) AS i FROM cut),
texts AS (SELECT {keys}, regexp_extract(parts[i], '^(?i:{word})') AS word, array_to_string(parts[1:i - 1], '') AS before FROM numbered)
SELECT {keys}, length(before) - length(replace(before, chr(10), '')) + 2 AS line,
  length(before) - CASE WHEN instr(before, chr(10)) = 0 THEN 0 ELSE length(before) - instr(reverse(before), chr(10)) + 1 END + 1 AS "column",
  '[GRAPHQL_NON_EXISTENT_FIELD] Field ''' || word || ''' likely does not exist in schema' AS message FROM texts"""


def category_table(source: str) -> str:
    names = ", ".join(f"({lit(c)}, {lit(c.replace('_', ' ').title())})" for c in issue_values.CATEGORIES)
    return (
        f"SELECT c.category, c.label, count(i.category) AS n FROM (VALUES {names}) c(category, label) "
        f"LEFT JOIN {source} i ON i.category = c.category GROUP BY c.category, c.label"
    )


def positions(table: str, key: str, text: str, pattern: str, base: int) -> str:
    """Matches with line and column from the lengths of matches and of the text between them."""
    return f"""
WITH pieces AS (
  SELECT {key}, regexp_extract_all({text}, '{pattern}') AS hits, string_split_regex({text}, '{pattern}') AS gaps FROM {table}),
numbered AS (SELECT {key}, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM pieces),
texts AS (SELECT {key}, hits[i] AS match,
  list_reduce(list_transform(range(1, i + 1), lambda j: gaps[j] || CASE WHEN j < i THEN hits[j] ELSE '' END), lambda x, y: x || y) AS before
  FROM numbered)
SELECT {key}, match, length(before) - length(replace(before, chr(10), '')) + 1 + {base} AS line,
  length(before) - CASE WHEN instr(before, chr(10)) = 0 THEN 0 ELSE length(before) - instr(reverse(before), chr(10)) + 1 END + 1 AS col
FROM texts"""


def defects(rows) -> str:
    """Planted rule hits: condition, line, column, level, message."""
    parts = [
        f"SELECT 'ops/o' || o || '.py' AS file, CAST({line} AS BIGINT) AS line, CAST({col} AS BIGINT) AS \"column\", "
        f"{lit(level)} AS level, {filled(lit(message))} AS message FROM o WHERE {when}"
        for when, line, col, level, message in rows
    ]
    return with_(ORDERS, " UNION ALL ".join(parts))


def class_hits(rows, table: str = "customer", key: str = "c_custkey", mark: str = "<c>", prefix: str = "c") -> str:
    parts = [
        f"SELECT 'models/{prefix}' || {key} || '.py' AS file, CAST({line} AS BIGINT) AS line, CAST({col} AS BIGINT) AS \"column\", "
        f"{lit(level)} AS level, replace({lit(message)}, '{mark}', CAST({key} AS VARCHAR)) AS message FROM {table} WHERE {when}"
        for when, line, col, level, message in rows
    ]
    return " UNION ALL ".join(parts)


# Planted rule hits in operation texts (lines count from 10, one further for texts cut out of a file).
G = {
    "g1_extra_argument": [
        ("o % 4 = 2", 12, 3, "error", "[GRAPHQL_EXTRA_ARGUMENT] field 'items' does not accept extra argument")],
    "g2_missing_argument": [
        ("o % 4 = 1", 12, 3, "error", "[GRAPHQL_MISSING_ARGUMENT] field 'product' may require arguments"),
        ("o % 4 = 0", 12, 3, "error", "[GRAPHQL_MISSING_ARGUMENT] field 'customer' may require arguments")],
    "g3_invalid_argument": [
        ("o % 5 = 0", 13, 8, "error",
         "[GRAPHQL_INVALID_ARGUMENT] first argument should be a number, not a string: 'ten'")],
    "g4_type_mismatch": [
        ("o % 5 = 1 AND o % 3 = 0", 13, 8, "error",
         "[GRAPHQL_TYPE_MISMATCH] variable '$n' declared as String! but used for numeric 'limit' argument")],
    "g5_non_existent": [
        ("o % 7 = 0", 14, 3, "error", "[GRAPHQL_NON_EXISTENT_FIELD] Field 'nonExistentThing' likely does not exist in schema"),
        ("o % 6 = 0", 15, 9, "error", "[GRAPHQL_NON_EXISTENT_FIELD] Field 'invalidThing' likely does not exist in schema"),
        ("o % 4 = 2", 12, 9, "error", "[GRAPHQL_NON_EXISTENT_FIELD] Field 'extraArg' likely does not exist in schema")],
    "g6_directive": [
        ("o % 6 = 0", 15, 8, "error", "[GRAPHQL_INVALID_DIRECTIVE] invalid directive '@invalidThing'")],
    "g7_fragment": [
        ("o % 4 = 0", 16, 3, "error", "[GRAPHQL_INVALID_FRAGMENT] inline fragment on type 'T<k>' may not be compatible"),
        ("o % 4 = 0", 16, 3, "error", "[GRAPHQL_INVALID_FRAGMENT] fragment spread 'on' likely does not exist"),
        ("o % 4 = 1", 16, 3, "error", "[GRAPHQL_INVALID_FRAGMENT] fragment spread 'Part<o>' likely does not exist")],
    "g8_fragment_definition": [
        ("o % 8 = 0", 18, 1, "warning",
         "[GRAPHQL_FRAGMENT_DEFINITION] fragment 'Part<o>' on type 'T<k>' may not be valid")],
    "g9_subscription": [
        ("o % 3 = 1", 11, 1, "warning",
         "[GRAPHQL_SUBSCRIPTION] subscription 'W<o>' may not be properly configured")],
}
_found = "found in model 'M<c>' - verify"
# Planted rule hits in model classes, which start at line 3. Line n of a class is 2 + n of its file.
M = {
    "m1": [("c_custkey % 2 = 0", 4, 1, "warning",
            "[PYDANTIC_REQUIRED_FIELD] Field 'id' in model 'M<c>' has no default value - may be required")],
    "m2": [
        ("c_custkey % 6 = 0", 9, 17, "info", f"max_length constraint {_found} constraint values are appropriate"),
        ("c_custkey % 6 = 1", 9, 17, "info",
         f"ge (greater than or equal) constraint {_found} constraint values are appropriate"),
        ("c_custkey % 6 = 1", 9, 17, "info",
         f"le (less than or equal) constraint {_found} constraint values are appropriate"),
        ("c_custkey % 6 = 3", 9, 17, "info", f"regex constraint {_found} regex pattern is correct")],
    "m3": [
        ("c_custkey % 3 = 0", 6, 11, "warning", f"[PYDANTIC_COMPLEX_TYPE] List type {_found} type compatibility"),
        ("c_custkey % 3 = 1", 6, 11, "warning", f"[PYDANTIC_COMPLEX_TYPE] Union type {_found} type compatibility")],
    "m4": [
        ("c_custkey % 4 = 0", 7, 5, "error", "[PYDANTIC_TYPE_MISMATCH] phone field should be str, not int"),
        ("c_custkey % 4 = 1", 7, 5, "error", "[PYDANTIC_TYPE_MISMATCH] price field should be Decimal/Float, not str")],
    "m5": [
        ("c_custkey % 5 = 0", 8, 5, "warning", "[PYDANTIC_EXTRA_FIELD] extra_field may not be in schema"),
        ("c_custkey % 5 = 1", 8, 13, "warning", "[PYDANTIC_EXTRA_FIELD] extra_field may not be in schema"),
        ("c_custkey % 5 = 1", 8, 5, "warning", "[PYDANTIC_EXTRA_FIELD] another_extra_field may not be in schema"),
        ("c_custkey % 5 = 2", 8, 5, "warning", "[PYDANTIC_EXTRA_FIELD] test_field may not be in schema")],
    "m6": [
        ("c_custkey % 3 <> 2", 5, 5, "info", f"[PYDANTIC_COMPLEX_TYPE] Optional type {_found} type compatibility"),
        ("TRUE", 6, 5, "info", f"[PYDANTIC_COMPLEX_TYPE] Optional type {_found} type compatibility"),
        ("c_custkey % 5 < 3", 7, 5, "info", f"[PYDANTIC_COMPLEX_TYPE] Optional type {_found} type compatibility"),
        ("c_custkey % 4 = 2", 9, 5, "info", f"[PYDANTIC_COMPLEX_TYPE] Union type {_found} type compatibility"),
        ("c_custkey % 4 = 3", 9, 5, "info", f"[PYDANTIC_COMPLEX_TYPE] Literal type {_found} type compatibility"),
        ("c_custkey % 5 = 4", 14, 5, "info", f"[PYDANTIC_COMPLEX_TYPE] Optional type {_found} type compatibility")],
    "m8": [("c_custkey % 4 = 2", 9, 5, "info", f"[PYDANTIC_COMPLEX_TYPE] Union type {_found} type compatibility")],
    "m9": [("c_custkey % 2 = 0", 3, 1, "warning",
            "[PYDANTIC_NONE_VALUE] Field 'v' in model 'M<c>' has default None but type is not Optional - "
            "consider using Optional[int]")],
    "m10": [
        ("c_custkey % 3 = 0", 10, 31, "info",
         "[PYDANTIC_EXTRA_CONFIG] Model 'M<c>' has extra='forbid' - extra fields will cause validation errors"),
        ("c_custkey % 3 = 1", 10, 31, "info",
         "[PYDANTIC_EXTRA_CONFIG] Model 'M<c>' has extra='ignore' - extra fields will be ignored")],
    "m11": [
        ("c_custkey % 5 = 3", 11, 5, "warning",
         "[PYDANTIC_FIELD_PRESENCE] Validator for field 'missing' found but field may not be defined in model 'M<c>'"),
        ("c_custkey % 4 = 0", 12, 5, "warning",
         "[PYDANTIC_VALIDATOR] Validator function 'check' in model 'M<c>' may be missing return statement")],
    "m12": [("c_custkey % 5 = 4", 3, 1, "info",
             "[PYDANTIC_OPTIONAL] Field 'opt' in model 'M<c>' is Optional but has no default value")],
    "m13": [("c_custkey % 6 = 2", 3, 1, "info",
             "[PYDANTIC_ALIAS] Field alias 'codeName_X' in model 'M<c>' may not follow consistent naming convention")],
    "m14": [("c_custkey % 7 = 0", 3, 1, "warning",
             "[PYDANTIC_INHERITANCE] Model 'M<c>' inherits from multiple Pydantic models which may cause conflicts")],
}
M7 = [
    ("TRUE", 2, 7, "info", "[PYDANTIC_NESTED_MODEL] Nested model 'a' in field 'D<s>' - verify model exists"),
    ("TRUE", 4, 5, "info", "[PYDANTIC_NESTED_MODEL] Nested model 'Part<s>' in field 'owner' - verify model exists"),
    ("TRUE", 5, 5, "info", "[PYDANTIC_NESTED_MODEL] Nested model 'Optiona' in field 'other' - verify model exists"),
]
M_FILES = [
    ("c_custkey % 5 = 4", 1, 1, "info", M["m12"][0][4]),
    ("c_custkey % 6 = 2", 1, 1, "info",
     "[PYDANTIC_ALIAS] Field alias 'codeName_X' may not follow consistent naming convention"),
    ("c_custkey % 7 = 0", 1, 1, "warning", M["m14"][0][4]),
]

NORMAL = f"regexp_replace(regexp_replace(text, '#.*', '', 'g'), '{BLANK}+', '', 'g')"

# Deprecated fields of the input types that arguments of called mutations have.
INPUTS = """, inputs AS (
  SELECT p_partkey % 100 AS n, replace(lower(p_brand), '#', '_') AS f, min(p_size) AS size FROM part GROUP BY 1, 2),
input_issues AS (
  SELECT DISTINCT file, CAST(start_line AS BIGINT) AS line, CAST(1 AS BIGINT) AS "column", 'warning' AS level,
    '[INPUT] Field ''' || f || ''' in input type ''I' || n || ''' is deprecated: ' || CASE WHEN size < 5 THEN 'too small' ELSE '' END AS message
  FROM blocks JOIN part ON p_partkey = k JOIN inputs ON n = k % 100 WHERE type = 'mutation' AND size < 10)"""

# The report: changes under headings of their section and type, a title, and a summary.
REPORT = """,
told AS (
  SELECT *, CASE change WHEN 'removed_types' THEN 1 WHEN 'added_types' THEN 2 WHEN 'removed_fields' THEN 3
    WHEN 'added_fields' THEN 4 ELSE 5 END AS section FROM changes),
schemas AS (SELECT schema FROM old_types UNION SELECT schema FROM new_types),
counted AS (SELECT schema, (SELECT count(*) FROM told t WHERE t.schema = s.schema AND t.section = n)::VARCHAR AS c, n
  FROM schemas s, (VALUES (1), (2), (3), (4), (5)) v(n)),
report_rows AS (
  SELECT schema, section, NULL AS type_name, 0 AS ord, NULL AS field_name,
    chr(10) || ['❌ Removed types', '✅ Added types', '❌ Removed fields', '✅ Added fields', '⚠️  Deprecated fields'][section] || ' in ' || schema || ':' AS line
  FROM (SELECT DISTINCT schema, section FROM told)
  UNION ALL SELECT schema, section, type_name, 0, NULL, '  ' || type_name || ':' FROM (SELECT DISTINCT schema, section, type_name FROM told WHERE section > 2)
  UNION ALL SELECT schema, section, type_name, 1, field_name,
    CASE WHEN field_name IS NULL THEN '  - ' || type_name WHEN section = 5 THEN '    - ' || field_name || ': ' || reason ELSE '    - ' || field_name END FROM told
  UNION ALL SELECT schema, 0, NULL, 0, NULL, chr(10) || '🏢 ' || schema || ' Schema Analysis' FROM schemas
  UNION ALL SELECT schema, 0, NULL, 1, NULL, repeat('-', 30) FROM schemas
  UNION ALL SELECT schema, 6, NULL, 0, NULL, chr(10) || '📈 ' || schema || ' Summary:' FROM schemas
  UNION ALL SELECT schema, 6, NULL, [4, 5, 1, 2, 3][n], NULL, '  - ' || ['Removed types', 'Added types', 'Removed fields', 'Added fields', 'Deprecated fields'][n] || ': ' || c FROM counted),
report AS (SELECT schema, section::BIGINT AS section, type_name::VARCHAR AS type_name, ord::BIGINT AS ord, field_name::VARCHAR AS field_name, line FROM report_rows)"""

TREE = """tree AS (
  SELECT o_custkey AS k, ['pkg_', '_private/m_', '.hidden/x_', 'node_modules/y_', 'src/deep/_', 'notes/t_'][k % 6 + 1] || k
      || ['/__init__.py', '.py', '.graphql', '.py', '.gql', '.txt'][k % 6 + 1] AS file,
    ['py', 'py', 'graphql', 'py', 'gql', 'txt'][k % 6 + 1] AS ext,
    '# customer ' || k || chr(10) || '# orders ' || count(*) || chr(10) AS text FROM orders GROUP BY o_custkey)"""

UNREADABLE = """SELECT 'o' || o_orderkey || '.py' AS file, CAST(1 AS BIGINT) AS line, CAST(1 AS BIGINT) AS "column", 'error' AS level,
      '[VALIDATION_ERROR] File processing error: the text is not valid UTF-8' AS message FROM orders WHERE o_orderkey % 10 = 0"""

# The blocks of the nested spreads; for the second fragment ``k`` is its own type's number.
NESTED = (
    f"{ORDERS}, blocks AS (SELECT 'nest/o' || o || '.py' AS file, o, CASE WHEN start_line = 2 THEN k1 ELSE k END AS k, k1, k AS first_k, "
    "start_line AS tpl, type, '' AS name, '' AS raw, start_line, start_line AS end_line "
    "FROM o CROSS JOIN (VALUES ('fragment', 1), ('fragment', 2), ('fragment', 3), ('query', 4)) v(type, start_line))"
)

ORACLES: dict[str, str] = {
    "s2_exclusions": """SELECT o_orderkey AS o, 'src/m.py' AS file FROM orders
      WHERE o_orderkey % 5 >= 3 AND o_orderkey % 7 NOT IN (0, 1)""",
    "s1_scan": with_(TREE, "SELECT file, ext, md5(text) AS source FROM tree WHERE k % 6 NOT IN (3, 5) AND k % 10 <> 7"),
    "s6_rejects": with_(TREE, "SELECT file, 'the text is not valid UTF-8' AS problem FROM tree WHERE k % 6 NOT IN (3, 5) AND k % 10 = 7"),
    "s7_introspection": with_(SCHEMA, """SELECT schema, version, type_name, field_name, is_deprecated, deprecation_reason,
      named_type FROM fields"""),
    "s8_rejected": """SELECT 'Admin' AS schema, 'v' || o_orderkey AS version, 'no access' AS errors FROM orders
      WHERE o_orderkey % 50 = 0""",
    "s10_report_lines": with_(DIFF + REPORT, "SELECT * FROM report"),
    "s10_report_file": with_(DIFF + REPORT, "SELECT unnest(string_split(line, chr(10))) AS line FROM report"),
    "s11_issue_lines": with_(ISSUES, """SELECT file, file || ':' || line || ':' || "column" || ': ' || level || ': ' || message AS text
      FROM issues"""),
    "p1_with_content": with_(ORDERS, """SELECT file FROM o UNION ALL SELECT 'gql/c' || c_custkey || '.graphql' FROM customer"""),
    "p3_operation_start": """SELECT 'ops/o' || o_orderkey || '.py' AS file, TRUE AS starts, TRUE AS balanced FROM orders""",
    "p6_versions": """
      WITH v AS (SELECT CASE o_orderkey % 3
          WHEN 0 THEN '20' || substr(strftime(o_orderdate, '%Y-%m'), 3, 5)
          WHEN 1 THEN CAST(2020 + o_orderkey % 14 AS VARCHAR) || '-' || ['01', '04', '07', '10', '0|'][o_orderkey % 5 + 1]
          ELSE CAST(2020 + o_orderkey % 7 AS VARCHAR) || substr(strftime(o_orderdate, '%Y-%m'), 5, 3) END AS version FROM orders),
      g AS (SELECT version, count(*) AS n FROM v GROUP BY version),
      c AS (SELECT *, substr(version, 1, 4) BETWEEN '2020' AND '2030' AND substr(version, 5, 1) = '-'
        AND substr(version, 6) IN ('01', '04', '07', '10') AS valid FROM g)
      SELECT version, n, valid, CASE WHEN valid THEN CASE WHEN replace(version, '-', '') < '202410' THEN 'token' ELSE 'proxy' END END AS route
      FROM c""",
    "p2_known_types": with_(ORDERS, f"""SELECT type, CAST(strategy AS BIGINT) AS strategy, count(*) AS n FROM (
      SELECT type, strategy FROM o JOIN (VALUES (0, 1, 'query'), (6, 1, 'fragment'), (6, 1, 'query'), (6, 1, 'query'), (0, 2, 'query'),
        (1, 2, 'query'), (6, 2, 'fragment'), (6, 2, 'query'), (6, 2, 'query'), (2, 3, 'query'), (2, 4, 'query'), (3, 4, 'query'),
        (4, 4, 'query'), (5, 4, 'query'), (7, 4, 'mutation'), (8, 4, 'query'), (8, 4, 'subscription'), (8, 5, 'query'),
        (8, 6, 'subscription'), (5, 7, 'query')) v(tpl, strategy, type) ON o % {N} = tpl
      UNION ALL SELECT t, 0 FROM customer CROSS JOIN (VALUES ('query'), ('mutation'), ('query')) w(t)) GROUP BY type, strategy"""),
    "h1_gql_assign": candidates(1),
    "h2_gql_call": candidates(2),
    "h3_op_assign": candidates(3),
    "h4_assigned": candidates(4, (2, 3, 4, 8), "query"),
    "h5_annotated": candidates(4, (8,), "subscription"),
    "h6_returned": candidates(4, (5,)),
    "h7_fallback": candidates(4, (7,)),
    "h8_dynamic": candidates(5),
    "h9_model_defaults": candidates(6).replace("e AS end_line, ", ""),
    "h10_concat": candidates(7),
    "h11_fstring": with_(ORDERS, f"""SELECT file, {filled("'query Q<o> { t<k>(id: 1) { f1 } }'")} AS text FROM o WHERE o % {N} = 3"""),
    "h12_bindings": with_(ORDERS, f"""SELECT file, ctx, {filled("text")} AS text FROM o CROSS JOIN
      (VALUES ('assign', 'query Q<o> {{ t<k> {{ f2 f3 }} }}'), ('concat', 'query Q<o> {{ t<k> {{ f2 f3 }} }}'),
      ('concat', 'query Q<o> {{ t<k> {{ f2 f3 }} ')) v(ctx, text) WHERE o % {N} = 4"""),
    "h13_reach": """
      WITH RECURSIVE edges AS (
        SELECT 'h' || (c_custkey // 64) AS file, 'C' || c_custkey AS class,
          CASE WHEN c_custkey % 64 <> 0 THEN 'C' || ((c_custkey // 64) * 64 + (c_custkey % 64) // 2)
               WHEN (c_custkey // 64) % 3 = 0 THEN 'C' || ((c_custkey // 64) * 64 + 63) ELSE 'BaseModel' END AS base FROM customer),
      reach AS (SELECT file, class FROM edges WHERE base = 'BaseModel'
        UNION SELECT e.file, e.class FROM edges e JOIN reach r ON r.file = e.file AND r.class = e.base)
      SELECT file, class FROM reach""",
    "h14_aliases": """
      WITH f AS (SELECT 'src/m' || c_custkey || '.py' AS file, c_custkey % 5 AS m FROM customer WHERE c_custkey % 5 <> 4)
      SELECT file, 'basemodel' AS role, CASE WHEN m = 0 THEN 'BM' ELSE 'BaseModel' END AS alias FROM f
      UNION ALL SELECT file, 'rootmodel', 'RootModel' FROM f
      UNION ALL SELECT file, 'pydantic_dataclass', CASE WHEN m = 1 THEN 'pdc' ELSE 'dataclass' END FROM f
      UNION ALL SELECT file, 'std_dataclass', CASE WHEN m = 3 THEN 'sdc' ELSE 'dataclass' END FROM f""",
    "h15_models": """
      WITH v(m, name, type, s, e, raw) AS (VALUES
        (0, 'A<c>', 'BaseModel/RootModel', 2, 3, 'class A<c>(BM):
    x: int'), (0, 'B<c>', 'BaseModel/RootModel', 4, 5, 'class B<c>(A<c>):
    y: int'), (1, 'A<c>', 'PydanticDataclass', 3, 4, 'class A<c>:
    x: int'), (1, 'B<c>', 'dataclass', 6, 7, 'class B<c>:
    y: int'), (2, 'A<c>', 'BaseModel/RootModel', 2, 3, 'class A<c>(pydantic.RootModel[int]):
    pass'), (2, 'B<c>', 'PydanticDataclass', 5, 6, 'class B<c>:
    y: int'), (3, 'A<c>', 'dataclass', 3, 4, 'class A<c>:
    x: int'))
      SELECT 'src/m' || c_custkey || '.py' AS file, replace(name, '<c>', CAST(c_custkey AS VARCHAR)) AS model_name, type,
        CAST(s AS BIGINT) AS start_line, CAST(e AS BIGINT) AS end_line, md5(replace(raw, '<c>', CAST(c_custkey AS VARCHAR))) AS raw
      FROM customer JOIN v ON c_custkey % 5 = m""",
    "h16_broken_files": """
      SELECT 'src/m' || c_custkey || '.py' AS file, 'unknown' AS type, CAST(1 AS BIGINT) AS start_line, CAST(4 AS BIGINT) AS end_line,
        md5('from typing import (
class A' || c_custkey || '(BaseModel):
    x: int') AS raw FROM customer WHERE c_custkey % 5 = 4""",
    "h17_defs": with_(ALL_BLOCKS, """SELECT file, type, name, CASE WHEN type = 'fragment' THEN 'T' || k END AS type_condition,
      CAST(CASE tpl WHEN 2 THEN 1 WHEN 91 THEN 2 ELSE 0 END AS BIGINT) AS n_vars, md5(raw) AS raw, start_line, end_line FROM blocks WHERE type <> 'unknown'"""),
    "h18_quotes": f"""
      WITH d AS (SELECT doc_id, regexp_replace(CASE doc_id % 4
          WHEN 0 THEN text WHEN 1 THEN '''' || text || '''' WHEN 2 THEN '"' || text || ''''
          ELSE text END, '^{BLANK}*$', '') AS text, doc_id % 4 AS m FROM documents)
      SELECT doc_id, md5(CASE WHEN m = 1 THEN substr(text, 2, length(text) - 2) ELSE text END) AS body FROM d""",
    "h20_errors": with_(ALL_BLOCKS, """SELECT file, type, name, start_line, end_line, md5(raw) AS raw FROM blocks WHERE type = 'unknown'"""),
    "h21_files": f"""
      WITH v(type, name, n_vars, start_line, end_line) AS ({values(planted.DOCUMENT_BLOCKS)})
      SELECT 'gql/c' || c_custkey || '.graphql' AS file, type, replace(name, '<c>', CAST(c_custkey AS VARCHAR)) AS name, n_vars,
        start_line, end_line FROM customer CROSS JOIN v""",
    "h22_string_lines": located(
        [(0, 4, 5), (1, 1, 1), (2, 3, 4), (3, 1, 1), (4, 2, 2), (5, 2, 2), (6, 4, 4), (7, 2, 2), (8, 4, 4)], "first, last"),
    "h23_assignment_line": located([(0, 2), (1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 5), (7, 1), (8, 3)], "line"),
    "h24_assignment_end": located([(0, 6), (1, 1), (2, 3), (3, 1), (4, 1), (5, 2), (6, 7), (7, 2), (8, 2)], "line"),
    "h25_block_lines": located(
        [(0, 3, 5), (1, 1, 1), (2, 1, 3), (3, 1, 1), (4, 1, 1), (5, 2, 2), (6, 3, 3), (7, 2, 2), (8, 4, 4)], "first, last"),
    "j1_old_lookup": with_(PLACES, "SELECT file, client, path, name, old_field FROM resolved"),
    "j2_new_lookup": with_(PLACES, "SELECT file, client, path, name, new_field FROM resolved"),
    "j3_paths": with_(PLACES, "SELECT file, client, path, name, type_name, CAST(depth AS BIGINT) AS depth, line, col FROM resolved"),
    "j4_inline": with_(USES, "SELECT file, client, name, type_name, line, col FROM resolved WHERE path LIKE '%.f0/%'"),
    "j5_spreads": with_(PLACES, """SELECT file, client, path, name, start_line, line, col, CAST(depth AS BIGINT) AS depth FROM placed
      WHERE depth = 3 AND path LIKE '%/:T%'"""),
    "j5_nested_spreads": with_(CLIENTS.replace(ALL_BLOCKS, NESTED), """SELECT file, client, start_line, path, name FROM (
        SELECT r.file, r.checked AS client, r.start_line, '' AS path, CASE start_line WHEN 1 THEN 'f1' WHEN 2 THEN 'f2' WHEN 3 THEN 'f4' ELSE 't' || k END AS name FROM rooted r
        UNION ALL SELECT r.file, r.checked, r.start_line, '.t' || k, 'nope' FROM rooted r WHERE type = 'query'
        UNION ALL SELECT r.file, r.checked, r.start_line, ':T' || CASE f WHEN 2 THEN k1 ELSE first_k END, CASE f WHEN 1 THEN 'f1' WHEN 2 THEN 'f2' ELSE 'f4' END
        FROM rooted r CROSS JOIN (VALUES (1), (2), (3)) v(f)
        WHERE type = 'fragment' OR EXISTS (SELECT 1 FROM fields a WHERE a.schema = r.checked AND a.type_name = r.root AND a.field_name = 't' || r.k))"""),
    "j6_client": with_(CLIENTS, "SELECT file, type, name, client FROM clients"),
    "j7_both_clients": with_(CLIENTS, "SELECT file, type, name, checked, root FROM rooted WHERE client = 'Unknown' AND type <> 'unknown'"),
    "j8_roots": with_(SCHEMA, """SELECT schema, version, CASE type_name WHEN 'QueryRoot' THEN 'query' ELSE 'mutation' END AS operation,
      type_name FROM types WHERE type_name IN ('QueryRoot', 'Mutation')"""),
    "f10_headers": with_(ALL_BLOCKS, """SELECT file, type, CASE WHEN type <> 'fragment' AND tpl <> 92 THEN type END AS operation,
      CASE WHEN type <> 'fragment' THEN name END AS operation_name,
      CASE type WHEN 'fragment' THEN 'f1' WHEN 'mutation' THEN 'm' || k ELSE 't' || k END AS root_field,
      CASE WHEN type = 'fragment' THEN name END AS fragment_name, CASE WHEN type = 'fragment' THEN 'T' || k END AS fragment_type
      FROM blocks WHERE type <> 'unknown'"""),
    "j9_inputs": with_(ALL_BLOCKS + INPUTS, "SELECT * FROM input_issues"),
    "j10_fragment_types": with_(CLIENTS, """SELECT file, start_line + 1 AS line, CAST(1 AS BIGINT) AS "column", 'error' AS level,
      '[INVALID_FRAGMENT] Type ''T' || k1 || ''' does not exist in schema' AS message FROM clients c
      WHERE tpl = 6 AND type = 'query' AND NOT EXISTS (SELECT 1 FROM old_types t WHERE t.type_name = 'T' || c.k1
        AND t.schema = CASE WHEN c.client = 'Storefront' THEN 'Storefront' ELSE 'Admin' END)"""),
    "j11_fragment_fields": with_(CLIENTS, """SELECT file, start_line + 1 AS line, CAST(1 AS BIGINT) AS "column", 'error' AS level,
      '[INVALID_FIELD_SELECTION] Field ''f4'' does not exist on type ''T' || k1 || '''' AS message FROM clients c
      JOIN old_types t ON t.type_name = 'T' || c.k1 AND t.schema = CASE WHEN c.client = 'Storefront' THEN 'Storefront' ELSE 'Admin' END
      WHERE tpl = 6 AND type = 'query' AND NOT EXISTS (SELECT 1 FROM old_fields f WHERE f.schema = t.schema AND f.type_name = t.type_name
        AND f.field_name = 'f4')"""),
    "j12_override": with_(ISSUES, """, drift AS (
      SELECT 'f' || user_id AS file, event_id % 500 AS line, event_id % 80 + 1 AS "column",
        row_number() OVER (PARTITION BY user_id, event_id % 500, event_id % 80 ORDER BY CASE WHEN event_id % 2 = 0 THEN 'Admin' ELSE 'Storefront' END DESC,
          (event_id + event_id // 2000) % 3 DESC, 'drift ' || event_id DESC) AS r, 'drift ' || event_id AS message FROM events)
      SELECT i.file, i.line, i."column", CASE WHEN d.message IS NULL THEN i.level ELSE 'warning' END AS level,
        coalesce(d.message, i.message) AS message FROM issues i LEFT JOIN drift d ON d.r = 1 AND d.file = i.file AND d.line = i.line
        AND d."column" = i."column" """),
    "j15_arguments": with_(CHECKED, 'SELECT file, line, "column", kind, level, message FROM arguments'),
    "j15_given_arguments": with_(ALL_BLOCKS, """SELECT file, CASE tpl WHEN 91 THEN 'm' ELSE 't' END || k AS name, arg,
      CAST(CASE tpl WHEN 3 THEN 1 ELSE 2 END AS BIGINT) AS line,
      CASE tpl WHEN 3 THEN instr(raw, '(id:') + 1 ELSE 3 + length('t' || k) + 1 + CASE arg WHEN 'b' THEN 7 ELSE 0 END END AS col
      FROM blocks JOIN (VALUES (2, 'first'), (3, 'id'), (91, 'a'), (91, 'b')) v(t, arg) ON t = tpl WHERE type <> 'unknown'"""),
    "sd1_removed_types": with_(SCHEMA, "SELECT * FROM old_types EXCEPT SELECT * FROM new_types"),
    "sd2_added_types": with_(SCHEMA, "SELECT * FROM new_types EXCEPT SELECT * FROM old_types"),
    "sd3_common_types": with_(SCHEMA, "SELECT * FROM common"),
    "sd4_field_diff": with_(DIFF, "SELECT * FROM field_diff"),
    "sd5_deprecated": with_(DIFF, "SELECT schema, type_name, field_name, reason FROM field_diff WHERE is_deprecated"),
    "sd6_type_fields": with_(SCHEMA, "SELECT DISTINCT schema, version, type_name, field_name FROM fields"),
    "sd7_status": with_(SCHEMA, """SELECT schema, version, type_name, field_name, TRUE AS "exists", is_deprecated,
      deprecation_reason AS reason FROM fields"""),
    "sd7_deprecated_list": with_(SCHEMA, """SELECT schema, version, type_name, field_name, coalesce(deprecation_reason, '') AS reason
      FROM fields WHERE is_deprecated OR deprecation_reason <> ''"""),
    "sd8_path_status": with_(PLACES, "SELECT DISTINCT client, path, name, type_name, kind, reason FROM drift"),
    "a1_evolution": with_(DIFF, """SELECT schema, count(*) FILTER (change = 'removed_types') AS removed_types,
      count(*) FILTER (change = 'added_types') AS added_types, count(*) FILTER (change = 'removed_fields') AS removed_fields,
      count(*) FILTER (change = 'added_fields') AS added_fields, count(*) FILTER (change = 'deprecated_fields') AS deprecated_fields
      FROM changes GROUP BY schema"""),
    "a2_types": with_(SCHEMA, "SELECT schema, version, count(*) AS n_types FROM types GROUP BY schema, version"),
    "a3_fields": with_(SCHEMA, f"""SELECT schema, count(*) FILTER (version = '{OLD}') AS old_fields, count(*) FILTER (version = '{NEW}') AS new_fields,
      printf('%+d', count(*) FILTER (version = '{NEW}') - count(*) FILTER (version = '{OLD}')) AS difference FROM fields GROUP BY schema"""),
    "a4_detail": with_(DIFF, "SELECT * FROM changes"),
    "a4_type_counts": with_(DIFF, "SELECT schema, change, type_name, count(field_name) AS n_fields FROM changes GROUP BY schema, change, type_name"),
    "a5_totals": with_(DIFF, "SELECT schema, change, count(*) AS total FROM changes GROUP BY schema, change"),
    "a6_categories": with_(ISSUES, category_table("issues")),
    "a7_by_category": with_(ISSUES, 'SELECT category, file, line, "column", message FROM issues'),
    "a8_totals": with_(BLOCKS, f"""SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) AS files,
      (SELECT count(*) FROM blocks) + 3 * (SELECT count(*) FROM customer) AS blocks,
      (SELECT count(*) FROM o WHERE o % {N} IN (7, 8)) AS models"""),
    "a9_by_type": with_(BLOCKS, """SELECT type, count(*) AS n FROM (SELECT type FROM blocks UNION ALL
      SELECT t FROM customer CROSS JOIN (VALUES ('query'), ('mutation'), ('query')) v(t)) GROUP BY type"""),
    "a11_classify": f"""
      WITH v(i, kind, level, text) AS (VALUES (0, 'DEPRECATED', 'warning', {lit(queries.VALIDATION_MESSAGES[0])}),
        (1, 'REMOVED', 'error', {lit(queries.VALIDATION_MESSAGES[1])}), (2, 'MISSING_REQUIRED_ARG', 'error', {lit(queries.VALIDATION_MESSAGES[2])}),
        (3, 'EXTRA_FIELD', 'warning', {lit(queries.VALIDATION_MESSAGES[3])}), (4, 'INVALID_FRAGMENT', 'warning', {lit(queries.VALIDATION_MESSAGES[4])}),
        (5, 'TYPE_MISMATCH', 'error', {lit(queries.VALIDATION_MESSAGES[5])}), (6, 'INVALID_OPERATION', 'error', {lit(queries.VALIDATION_MESSAGES[6])}),
        (7, 'GRAPHQL_VALIDATION', 'warning', {lit(queries.VALIDATION_MESSAGES[7])}))
      SELECT event_type, kind, level, '[' || kind || '] ' || text AS message, count(*) AS n FROM events JOIN v ON event_id % 8 = i
      GROUP BY event_type, kind, level, text""",
    "a12_unnamed": """SELECT 'gql/c' || c_custkey || '.graphql' AS file, CAST(10 AS BIGINT) AS line, CAST(1 AS BIGINT) AS "column", 'error' AS level,
      '[INVALID_OPERATION] Unnamed operation in multi-operation file' AS message FROM customer""",
    "f1_normalise": f"SELECT doc_id, md5({NORMAL}) AS body FROM documents",
    "f2_offset_line": """SELECT doc_id, length(b) - length(replace(b, chr(10), '')) + 1 AS line FROM
      (SELECT doc_id, substr(text, 1, n_chars * 2 // 3) AS b FROM documents)""",
    "f3_position": positions("pages", "page_id", "html", rf"<{W}+", 0),
    "f4_position": positions("documents", "doc_id", "text", r"\p{Nd}+", 1),
    "f4_offset_position": """
      WITH d AS (SELECT doc_id, text, n_chars * (doc_id % 5) // 4 AS pos FROM documents),
      b AS (SELECT doc_id, pos >= length(text) AS past, substr(text, 1, pos) AS b FROM d)
      SELECT doc_id, CASE WHEN past THEN 8 ELSE 8 + length(b) - length(replace(b, chr(10), '')) END AS line,
        CASE WHEN past THEN 1 WHEN instr(b, chr(10)) = 0 THEN length(b) + 1 ELSE instr(reverse(b), chr(10)) END AS col FROM b""",
    "f6_fix": with_(ISSUES, 'SELECT file, line, "column", message AS issue, fix FROM issues'),
    "d1_blocks": f"""
      WITH k AS (SELECT source, lang, doc_id, text, row_number() OVER (PARTITION BY source, lang, {NORMAL} ORDER BY doc_id) AS r FROM documents)
      SELECT source AS file, lang AS type, doc_id AS start_line, md5(text) AS raw FROM k WHERE r = 1""",
    "d2_models": f"""
      WITH k AS (SELECT role, conv_id * 1000 + turn AS s, text, row_number() OVER (PARTITION BY role, {NORMAL} ORDER BY conv_id * 1000 + turn, turn) AS r
        FROM conversations)
      SELECT role AS model_name, s AS start_line, md5(text) AS raw FROM k WHERE r = 1""",
    "d3_files": """SELECT 'f' || user_id AS file, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r
      FROM events) WHERE r = 1""",
    "d4_issues": """
      WITH i AS (SELECT 'f' || (user_id % 20) AS file, event_id % 10 AS line, event_type AS type_name, 'x' || (event_id % 3) AS field_name,
        CASE WHEN event_id % 2 = 0 THEN 'Admin' ELSE 'Storefront' END AS client, 'm' || (event_id % 7) AS message FROM events),
      k AS (SELECT *, row_number() OVER (PARTITION BY file, line, type_name, field_name ORDER BY client, message) AS r FROM i)
      SELECT file, line, type_name, field_name, client, message FROM k WHERE r = 1""",
    "d5_inputs": """SELECT DISTINCT 'f' || (user_id % 20) AS file, event_id % 10 AS line, event_type AS type_name,
      'x' || (event_id % 3) AS field_name, 'r' AS reason FROM events""",
    "d7_order": with_(ISSUES, "SELECT file, line, message AS issue FROM issues"),
    "d9_position": """SELECT 'f' || (user_id % 3) AS file, event_id % 50 AS line, event_id,
      row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id % 50, event_id) AS position FROM events""",
    "d10_preview": r"""
      WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS p FROM documents)
      SELECT doc_id, md5(array_to_string(p[1:10], chr(10))) AS shown, greatest(len(p) - 10, 0) AS left_out FROM d""",
    **{name: defects(rows) for name, rows in G.items()},
    **{f"{rule}_models": class_hits(rows) for rule, rows in M.items()},
    "m7_models": class_hits(M7, "supplier", "s_suppkey", "<s>", "s"),
    "m12_files": class_hits(M_FILES),
    "g5_documents": words("documents", "doc_id", "text"),
    "g5_pages": words("pages", "page_id", "html"),
    "g5_conversations": words("conversations", "conv_id, turn", "text"),
    "g10_parse_errors": with_(ALL_BLOCKS, """SELECT file, start_line AS line, CAST(1 AS BIGINT) AS "column", 'error' AS level,
      '[GRAPHQL_VALIDATION] GraphQL parsing error: the text is not a valid operation document' AS message FROM blocks WHERE type = 'unknown'"""),
    "g11_located_parse_errors": with_(ALL_BLOCKS, f"""{PARSE_ERRORS}
      UNION ALL SELECT 'bad/o' || o_orderkey || '.graphql', l, CASE c WHEN 0 THEN length(replace(t, '<o>', CAST(o_orderkey AS VARCHAR))) + 1 ELSE c END,
      'error', '[GRAPHQL_PARSE] Syntax Error: ' || replace(m, '<o>', CAST(o_orderkey AS VARCHAR))
      FROM orders JOIN ({WRONG}) w(i, t, l, c, m) ON i = o_orderkey % {len(planted.WRONG)}"""),
    "g12_unreadable": UNREADABLE,
    "c1_harvest": with_(ALL_BLOCKS, f"""SELECT file, count(*) AS n_blocks,
      CAST(CASE WHEN any_value(tpl) < 90 AND any_value(o) % {N} IN (7, 8) THEN 1 ELSE 0 END AS BIGINT) AS n_models,
      string_agg(type, ',' ORDER BY start_line, type = 'unknown') AS types,
      string_agg(coalesce(name, '-'), ',' ORDER BY start_line, type = 'unknown') AS names,
      string_agg(start_line || '-' || end_line, ',' ORDER BY start_line, type = 'unknown') AS lines,
      md5(string_agg(raw, chr(10) ORDER BY start_line, type = 'unknown')) AS texts FROM blocks GROUP BY file"""),
    "c2_report": with_(DIFF, f"""SELECT schema, count(*) FILTER (change = 'removed_types') AS removed_types,
      count(*) FILTER (change = 'added_types') AS added_types, count(*) FILTER (change = 'removed_fields') AS removed_fields,
      count(*) FILTER (change = 'added_fields') AS added_fields, count(*) FILTER (change = 'deprecated_fields') AS deprecated_fields,
      any_value(a) AS old_fields, any_value(b) AS new_fields, printf('%+d', any_value(b) - any_value(a)) AS difference
      FROM changes JOIN (SELECT schema, count(*) FILTER (version = '{OLD}') AS a, count(*) FILTER (version = '{NEW}') AS b FROM fields GROUP BY schema)
      USING (schema) GROUP BY schema"""),
    "c3_usage_drift": with_(USES + INPUTS, """SELECT file, line, "column", level, message FROM drift_issues
      UNION ALL SELECT * FROM input_issues"""),
    "c4_surface": " UNION ALL ".join(
        [f"SELECT * FROM ({defects(rows)}) WHERE CAST(regexp_extract(file, 'o([0-9]+)', 1) AS BIGINT) % 11 <> 0" for rows in G.values()]
        + [f"SELECT * FROM ({class_hits(M[rule])})" for rule in ("m1", "m2", "m3", "m4", "m5")]
        + ["""SELECT 'ops/o' || o_orderkey || '.py', CAST(10 AS BIGINT), CAST(1 AS BIGINT), 'error',
          '[GRAPHQL_VALIDATION] GraphQL parsing error: the text is not a valid operation document' FROM orders WHERE o_orderkey % 11 = 0""", UNREADABLE]
    ),
    "c5_surface_schema": with_(CHECKED + f""", general AS (SELECT file, line, "column", level, message FROM arguments
      UNION ALL SELECT file, start_line + 1, 1, 'error', '[INVALID_FRAGMENT] Type ''T' || k1 || ''' does not exist in schema' FROM clients c
        WHERE tpl = 6 AND type = 'query' AND NOT EXISTS (SELECT 1 FROM old_types t WHERE t.type_name = 'T' || c.k1
        AND t.schema = CASE WHEN c.client = 'Storefront' THEN 'Storefront' ELSE 'Admin' END)
      UNION ALL SELECT file, start_line + 1, 1, 'error', '[INVALID_FIELD_SELECTION] Field ''f4'' does not exist on type ''T' || k1 || '''' FROM clients c
        JOIN old_types t ON t.type_name = 'T' || c.k1 AND t.schema = CASE WHEN c.client = 'Storefront' THEN 'Storefront' ELSE 'Admin' END
        WHERE tpl = 6 AND type = 'query' AND NOT EXISTS (SELECT 1 FROM old_fields f WHERE f.schema = t.schema AND f.type_name = t.type_name
        AND f.field_name = 'f4')
      UNION ALL {PARSE_ERRORS}
      UNION ALL SELECT file, start_line, 1, 'error', '[INVALID_OPERATION] Unnamed operation in multi-operation file' FROM blocks WHERE tpl = 92
      UNION ALL SELECT file, start_line + 1, instr(raw, '... on'), 'error', CASE i WHEN 1 THEN
          '[GRAPHQL_INVALID_FRAGMENT] inline fragment on type ''T' || k1 || ''' may not be compatible'
          ELSE '[GRAPHQL_INVALID_FRAGMENT] fragment spread ''on'' likely does not exist' END FROM blocks
        CROSS JOIN (VALUES (1), (2)) v(i) WHERE tpl = 6 AND type = 'query'
      UNION ALL SELECT file, start_line + 1, 1, 'warning', '[GRAPHQL_FRAGMENT_DEFINITION] fragment ''' || name || ''' on type ''T' || k || ''' may not be valid'
        FROM blocks WHERE type = 'fragment'
      UNION ALL SELECT file, start_line + 1, 1, 'warning', '[GRAPHQL_SUBSCRIPTION] subscription ''' || name || ''' may not be properly configured'
        FROM blocks WHERE type = 'subscription'
      UNION ALL {UNREADABLE}),
      last_drift AS (SELECT file, line, "column", message, row_number() OVER (PARTITION BY file, line, "column" ORDER BY client DESC,
        CASE kind WHEN 'DEPRECATED' THEN 1 WHEN 'REMOVED' THEN 2 ELSE 3 END DESC, message DESC) AS r FROM drift_issues)""",
      """SELECT file, line, "column", level, message FROM drift_issues
      UNION ALL SELECT g.file, g.line, g."column", CASE WHEN d.message IS NULL THEN g.level ELSE 'warning' END, coalesce(d.message, g.message)
      FROM general g LEFT JOIN last_drift d ON d.r = 1 AND d.file = g.file AND d.line = g.line AND d."column" = g."column" """),
    "c6_validation": with_(USES + INPUTS + """, kinds AS (SELECT kind AS category FROM drift_issues
      UNION ALL SELECT 'OTHER' FROM input_issues
      UNION ALL SELECT 'OTHER' FROM orders WHERE o_orderkey % 10 = 0
      UNION ALL SELECT 'GRAPHQL_VALIDATION' FROM blocks WHERE type = 'unknown'
      UNION ALL SELECT 'GRAPHQL_VALIDATION' FROM blocks CROSS JOIN (VALUES (1), (2)) WHERE tpl = 6 AND type = 'query'
      UNION ALL SELECT 'OTHER' FROM blocks WHERE type IN ('fragment', 'subscription'))""", category_table("kinds")),
    "c7_dry_run": with_(ISSUES, """SELECT file, line, "column", message AS issue, fix,
      row_number() OVER (PARTITION BY file ORDER BY line, "column", message, fix) AS position FROM issues"""),
    "c8_summary": with_(ALL_BLOCKS, """SELECT file, type, coalesce(name, 'None') AS name, start_line, end_line, md5(raw) AS shown,
      CAST(0 AS BIGINT) AS left_out, row_number() OVER (PARTITION BY file ORDER BY start_line, CASE type WHEN 'unknown' THEN 1 ELSE 0 END) AS position
      FROM blocks"""),
    "flagship_drift_categories": with_(USES + INPUTS + """, kinds AS (SELECT kind AS category FROM drift_issues
      UNION ALL SELECT 'OTHER' FROM input_issues)""", category_table("kinds")),
}

ORACLES["s9_json"] = f"SELECT file, n_blocks, n_models FROM ({ORACLES['c1_harvest']})"
