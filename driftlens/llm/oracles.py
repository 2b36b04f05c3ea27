"""DuckDB SQL for the llm queries that SQL can express."""

from driftlens.llm import rules

WORDS = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]"

ORACLES: dict[str, str] = {}

ORACLES["op5_mixing"] = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap
  FROM totals),
ranked AS (
  SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM totals)::DOUBLE AS wanted,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM weighed),
level AS (SELECT max((wanted - given::DOUBLE) / free::DOUBLE) FILTER (WHERE cap * free >= (wanted - given) * weight) AS l FROM ranked),
goals AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * coalesce(l, 'infinity'::DOUBLE)) AS target FROM weighed, level),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS whole FROM goals),
placed AS (
  SELECT s.doc_id, s.size, c.source_size, c.target, c.whole, c.target - c.whole * c.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::DOUBLE - s.size / 2 AS middle
  FROM sized s JOIN cut c ON s.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target, whole + (rest > 0 AND middle <= rest)::BIGINT AS copies,
       (whole + (rest > 0 AND middle <= rest)::BIGINT) * size AS taken
FROM placed"""

_failed = " + ".join(f"CASE WHEN {test} THEN {rules.BIT[name]} ELSE 0 END" for name, test in rules.RULES)
ORACLES["op9_quality_rules"] = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORDS}') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS lines FROM t),
windows AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT DISTINCT r, i + d AS i FROM twice, (VALUES (0), (1), (2)) v(d)),
reps AS (SELECT r, count(*) AS n FROM covered GROUP BY r),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{BLANKS}', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines, (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
         (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclaim,
         length(regexp_replace(text, '[^A-Za-z\x{{80}}-\x{{10FFFF}}]', '', 'g'))::BIGINT AS n_letters
  FROM w LEFT JOIN reps USING (r)),
f AS (SELECT *, ({_failed})::BIGINT AS failed FROM m)
SELECT *, failed & {rules.BASE} <> 0 AS base_failed, failed & {rules.BASE} = 0 AND failed & {rules.POLICIES[rules.CURRENT]} = 0 AS kept FROM f"""

ORACLES["op4_near_vectors"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM v JOIN roots ON roots.a = vec_id LEFT JOIN counts ON counts.a = vec_id"""

_ESC = r"regexp_replace({}, '([<\[])(\\*)((?:/?(?:INST|SYS|ROLE|TEXT)\]|/?s>))', '\1\2\\\3', 'g')"
ORACLES["op6_chat_format"] = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
pieces AS (
  SELECT *, CASE role WHEN 'user' THEN '[INST] ' || {_ESC.format("text")} || ' [/INST]'
                      WHEN 'system' THEN '[SYS] ' || {_ESC.format("text")} || ' [/SYS]'
                      WHEN 'assistant' THEN {_ESC.format("text")} || '</s>'
                      ELSE '[ROLE] ' || {_ESC.format("role")} || ' [TEXT] ' || {_ESC.format("text")} || ' [/ROLE]' END AS piece
  FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(length(piece)))::BIGINT AS formatted_chars
FROM pieces GROUP BY conv_id"""

# Links by counting common n-grams; the components by the closure of the links.
ORACLES["op8_ngram_join"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS words
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
      ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS g FROM w)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(b) AS component_id
FROM reach JOIN w ON w.doc_id = reach.a LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""


def _levels(name: str, levels: int, key: str) -> str:
    """Common table expressions of the levels of a tree whose leaves are ``<name>0``: ``key, r, h, n``."""
    return "".join(
        f"""
{name}{k + 1} AS (SELECT {key}, r // 3 AS r, (n + 2) // 3 AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY r)) ELSE any_value(h) END AS h
  FROM {name}{k} GROUP BY {key}, r // 3, n),"""
        for k in range(levels)
    )


def _climb(name: str, tree: str, levels: int, start: str, key: str) -> str:
    """From ``start`` (``doc_id, key, r, node, proof``) up the tree: what the node becomes, and its siblings so far."""
    parts = [f"\n{name}0 AS ({start}),"]
    for k in range(levels):
        parts.append(
            f"""
{name}{k + 1} AS (SELECT p.doc_id, p.{key}, p.r // 3 AS r,
    CASE WHEN any_value(t.n) > 1 THEN sha256(string_agg(CASE WHEN t.r = p.r THEN p.node ELSE t.h END, '' ORDER BY t.r)) ELSE any_value(p.node) END AS node,
    any_value(p.proof) || coalesce(string_agg(CASE WHEN t.r <> p.r THEN t.h END, '' ORDER BY t.r), '') AS proof
  FROM {name}{k} p JOIN {tree}{k} t ON t.{key} = p.{key} AND t.r // 3 = p.r // 3 GROUP BY p.doc_id, p.{key}, p.r),"""
        )
    return "".join(parts)


def _spelled(*fields: str) -> str:
    return " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields)


# Levels the statement spells out: enough for 3 ** 13 leaves of a source and 3 ** 7 sources.
_LEAF_LEVELS, _SOURCE_LEVELS = 13, 7
# The remainder of crc32 modulo 2, bit by bit over the decimal id.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, b:
  list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1))))"""

ORACLES["op12_manifest"] = f"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, '') AS g, sha256({_spelled("doc_id", "source", "lang", "n_chars", "text")}) AS leaf,
    CASE WHEN xor({_CRC}, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed, source, lang, n_chars
  FROM documents),
l AS (SELECT doc_id, g, leaf, sha256({_spelled("doc_id", "source", "lang", "n_chars", "changed")}) AS changed,
    row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM d),
t0 AS (SELECT g, r, n, leaf AS h FROM l),{_levels("t", _LEAF_LEVELS, "g")}
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS r, count(*) OVER () AS n FROM t{_LEAF_LEVELS}),
u0 AS (SELECT 0 AS z, r, n, subroot AS h FROM s),{_levels("u", _SOURCE_LEVELS, "z")}{_climb("p", "t", _LEAF_LEVELS, "SELECT doc_id, g, r, changed AS node, '' AS proof FROM l", "g")}{_climb("q", "u", _SOURCE_LEVELS, f"SELECT p.doc_id, 0 AS z, s.r, p.node, p.proof FROM p{_LEAF_LEVELS} p JOIN s USING (g)", "z")}
top AS (SELECT h AS root FROM u{_SOURCE_LEVELS})
SELECT l.doc_id, l.leaf, s.subroot, top.root, sha256(q.proof) AS proof_sha256, q.node AS folded_root, q.node = top.root AS verified
FROM q{_SOURCE_LEVELS} q JOIN l USING (doc_id) JOIN s ON s.g = l.g, top
"""

ORACLES["op13_hard_negatives"] = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id,
  row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank, n.id AS negative_id,
  p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) <= 10
"""
