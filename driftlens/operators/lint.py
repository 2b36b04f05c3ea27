"""Text rules over operation texts and model classes.

A rule is a row of data: a pattern, what to say about a match, and how to place it. All rules of a list are scanned
in one pass over the row, natively, and come out as issue rows; a text is never copied across a shuffle for it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions.regex import spell
from driftlens.functions.text import bind, find_all, strip

ISSUE = "array<struct<rule:string,line:int,column:int,level:string,message:string>>"


@dataclass(frozen=True)
class Rule:
    """``message`` gets a function that extracts a group of the match. ``shift`` is added to the line of a match
    (1 for texts cut out of a file), None puts the issue at the text's first line. ``keep`` may drop matches. ``only`` is a quick
    test of the whole text that holds wherever a match is kept."""

    id: str
    tag: str
    level: str
    pattern: str
    flags: str
    message: Callable[[Callable[[int], Column]], Column]
    shift: int | None = 1
    keep: Callable[[Callable[[int], Column]], Column] | None = None
    only: Callable[[Column], Column] | None = None


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _issue(rule: str, line: Column, column: Column, level: str, message: Column) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        line.cast("int").alias("line"),
        column.cast("int").alias("column"),
        F.lit(level).alias("level"),
        message.alias("message"),
    )


def _tagged(tag: str, text: Column) -> Column:
    return F.concat(F.lit(f"[{tag}] "), text) if tag else text


def rule_issues(rule: Rule, text: Column, start_line: Column) -> Column:
    """Issues of one rule in one text."""
    spelled = spell(rule.pattern, rule.flags)

    def group_of(hit: Column) -> Callable[[int], Column]:
        return lambda g: hit["match"] if g == 0 else F.regexp_extract(hit["match"], spelled, g)

    hits = find_all(text, rule.pattern, rule.flags)
    if rule.keep is not None:
        hits = F.filter(hits, lambda hit: rule.keep(group_of(hit)))

    def issue(hit: Column) -> Column:
        placed = rule.shift is not None
        line = start_line + hit["lines"] + rule.shift if placed else start_line
        column = hit["col"] + 1 if placed else F.lit(1)
        return _issue(rule.id, line, column, rule.level, _tagged(rule.tag, rule.message(group_of(hit))))

    found = F.transform(hits, issue)
    return found if rule.only is None else F.when(rule.only(text), found).otherwise(F.array().cast(ISSUE))


def lint(texts: DataFrame, checks: list[Callable[[Column, Column], Column]], keep: list[str], text: str = "raw"):
    """Issue rows of all checks; ``keep`` columns are carried along."""
    found = F.concat(*[check(F.col(text), F.col("start_line")) for check in checks])
    return texts.filter(F.col(text).isNotNull()).select(*keep, F.inline(found.cast(ISSUE)))


def as_check(rule: Rule) -> Callable[[Column, Column], Column]:
    return lambda text, start: rule_issues(rule, text, start)


# ---- operation texts -------------------------------------------------------------------------------------------

# Fields that are known to need arguments (as compared: in lower case), and words never reported.
NEED_ARGUMENTS = ("customer", "product", "order", "user", "shop")
KNOWN_WORDS = (
    "id", "email", "firstName", "lastName", "name", "title", "description", "on", "fragment", "query", "mutation",
    "subscription", "customerId", "total",
)
NUMERIC_ARGUMENTS = ("first", "last", "limit", "offset", "count")


def _needs_arguments(group: Callable[[int], Column]) -> Column:
    return F.lower(group(1)).isin(*NEED_ARGUMENTS)


def _names_such(text: Column) -> Column:
    """Whether one of the fields that need arguments can be there at all."""
    low = F.lower(text)
    found = low.contains(NEED_ARGUMENTS[0])
    for word in NEED_ARGUMENTS[1:]:
        found = found | low.contains(word)
    return found


EXTRA_ARGUMENTS = r"(?:extraArg|unknownArg|invalidArg|testArg)"


# The patterns, levels and words of these rules.
OPERATION_RULES = (
    Rule("g1", "GRAPHQL_EXTRA_ARGUMENT", "error",
         rf"(\w+)\s*\([^)]*{EXTRA_ARGUMENTS}[^)]*\)", "i",
         lambda g: _say("field '", g(1), "' does not accept extra argument"),
         only=lambda text: text.rlike(spell(EXTRA_ARGUMENTS, "i"))),
    Rule("g2a", "GRAPHQL_MISSING_ARGUMENT", "error", r"(\w+)\s*\(\s*\)", "i",
         lambda g: _say("field '", F.lower(g(1)), "' may require arguments"), keep=_needs_arguments,
         only=_names_such),
    Rule("g2b", "GRAPHQL_MISSING_ARGUMENT", "error", r"(\w+)\s*\{\s*", "i",
         lambda g: _say("field '", F.lower(g(1)), "' may require arguments"), keep=_needs_arguments,
         only=_names_such),
    Rule("g3", "GRAPHQL_INVALID_ARGUMENT", "error",
         r"(?:first|last|limit|offset|count):\s*[\"']([^\"']+)[\"']", "",
         lambda g: _say(F.substring_index(g(0), ":", 1), " argument should be a number, not a string: '", g(1), "'")),
    Rule("g5", "GRAPHQL_NON_EXISTENT_FIELD", "error",
         r"\b(?:nonExistent|invalid|unknown|test|dummy|extra)\w*\b", "i",
         lambda g: _say("Field '", g(0), "' likely does not exist in schema"),
         keep=lambda g: ~F.lower(g(0)).isin(*KNOWN_WORDS)),
    Rule("g6", "GRAPHQL_INVALID_DIRECTIVE", "error", r"@(?:invalid|unknown|test|dummy)\w*", "i",
         lambda g: _say("invalid directive '", g(0), "'")),
    Rule("g7a", "GRAPHQL_INVALID_FRAGMENT", "error", r"\.\.\.\s+on\s+(\w+)", "i",
         lambda g: _say("inline fragment on type '", g(1), "' may not be compatible")),
    Rule("g7b", "GRAPHQL_INVALID_FRAGMENT", "error", r"\.\.\.\s+(\w+)", "i",
         lambda g: _say("fragment spread '", g(1), "' likely does not exist")),
    Rule("g8", "GRAPHQL_FRAGMENT_DEFINITION", "warning", r"fragment\s+(\w+)\s+on\s+(\w+)", "i",
         lambda g: _say("fragment '", g(1), "' on type '", g(2), "' may not be valid")),
    Rule("g9", "GRAPHQL_SUBSCRIPTION", "warning", r"subscription\s+(\w+)", "i",
         lambda g: _say("subscription '", g(1), "' may not be properly configured")),
)


def string_variables_as_numbers(text: Column, start_line: Column) -> Column:
    """A variable declared ``String!`` that is the value of a numeric argument: once per declaration and use."""
    declared = F.transform(
        find_all(text, r"\$(\w+):\s*String!"), lambda hit: F.regexp_extract(hit["match"], spell(r"\$(\w+)"), 1)
    )
    use = "(" + "|".join(NUMERIC_ARGUMENTS) + r"):\s*\$(\w+)"

    def issue(hit: Column) -> Column:
        variable = F.regexp_extract(hit["match"], spell(use), 2)
        argument = F.regexp_extract(hit["match"], spell(use), 1)
        message = _say("variable '$", variable, "' declared as String! but used for numeric '", argument, "' argument")
        return _issue(
            "g4", start_line + hit["lines"] + 1, hit["col"] + 1, "error", _tagged("GRAPHQL_TYPE_MISMATCH", message)
        )

    def pair(names: Column) -> Column:
        def per_use(hit: Column) -> Column:
            variable = F.regexp_extract(hit["match"], spell(use), 2)
            return F.transform(F.filter(names, lambda name: name == variable), lambda _: issue(hit))

        return F.flatten(F.transform(find_all(text, use), per_use))

    return bind(declared, pair)


OPERATION_CHECKS = [as_check(rule) for rule in OPERATION_RULES] + [string_variables_as_numbers]


def lint_operations(blocks: DataFrame, keep: list[str], rules: set[str] | None = None) -> DataFrame:
    """All pattern rules over operation texts ``(raw, start_line)``."""
    checks = [as_check(r) for r in OPERATION_RULES if rules is None or r.id in rules]
    if rules is None or "g4" in rules:
        checks.append(string_variables_as_numbers)
    return lint(blocks, checks, keep)


# ---- model classes ---------------------------------------------------------------------------------------------


def _model() -> Column:
    return F.coalesce(F.col("model_name"), F.lit("None"))


FIELD_LINE = r"^\s*(\w+):\s*([^=]+?)(?:\s*=\s*[^#\n]+)?\s*(?:#.*)?$"


def required_fields(text: Column, start_line: Column) -> Column:
    """Field lines without a default, unless optional."""
    lines = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(line.alias("line"), i.alias("i")))

    def required(item: Column) -> Column:
        line = item["line"]
        kind = strip(F.regexp_extract(line, spell(FIELD_LINE), 2))
        return (
            line.rlike(spell(FIELD_LINE))
            & ~line.contains("= ")
            & ~kind.contains("Optional[")
            & ~line.rlike(spell(r"^\s*#"))
            & ~line.contains("class ")
            & ~line.contains("def ")
        )

    def issue(item: Column) -> Column:
        name = F.regexp_extract(item["line"], spell(FIELD_LINE), 1)
        message = _say("Field '", name, "' in model '", _model(), "' has no default value - may be required")
        return _issue("m1", start_line + item["i"], F.lit(1), "warning", _tagged("PYDANTIC_REQUIRED_FIELD", message))

    return F.transform(F.filter(lines, required), issue)


def _pattern_rules(prefix: str, tag: str, level: str, flags: str, rows, about) -> tuple[Rule, ...]:
    return tuple(
        Rule(f"{prefix}_{i}", tag, level, pattern, flags, lambda g, said=said: about(said))
        for i, (pattern, said) in enumerate(rows)
    )


# The patterns, levels and words of these rules.
CONSTRAINT_RULES = _pattern_rules(
    "m2", "", "info", "",
    (
        (r"Field\([^)]*max_length[^)]*\)",
         ("max_length constraint found in model '", "' - verify constraint values are appropriate")),
        (r"Field\([^)]*ge\s*=\s*\d+[^)]*\)",
         ("ge (greater than or equal) constraint found in model '", "' - verify constraint values are appropriate")),
        (r"Field\([^)]*le\s*=\s*\d+[^)]*\)",
         ("le (less than or equal) constraint found in model '", "' - verify constraint values are appropriate")),
        (r"Field\([^)]*regex[^)]*\)",
         ("regex constraint found in model '", "' - verify regex pattern is correct")),
    ),
    lambda said: _say(said[0], _model(), said[1]),
)
COMPLEX_RULES = _pattern_rules(
    "m3", "PYDANTIC_COMPLEX_TYPE", "warning", "i",
    (
        (r"Optional\[List\[", "List"),
        (r"Optional\[Dict\[", "Dict"),
        (r"Optional\[Union\[", "Union"),
        (r"Optional\[str\s*\|\s*int\]", "Union"),
        (r"Optional\[dict\]", "Dict"),
        (r"Optional\[list\]", "List"),
    ),
    lambda said: _say(said, " type found in model '", _model(), "' - verify type compatibility"),
)
MISMATCH_RULES = _pattern_rules(
    "m4", "PYDANTIC_TYPE_MISMATCH", "error", "im",
    (
        (r"phone:\s*Optional\[int\]", "phone field should be str, not int"),
        (r"total:\s*Optional\[str\]", "total field should be Decimal/Float, not str"),
        (r"is_active:\s*Optional\[str\]", "is_active field should be bool, not str"),
        (r"age:\s*Optional\[str\]", "age field should be int, not str"),
        (r"price:\s*Optional\[str\]", "price field should be Decimal/Float, not str"),
        (r"count:\s*Optional\[str\]", "count field should be int, not str"),
        (r"amount:\s*Optional\[str\]", "amount field should be Decimal/Float, not str"),
    ),
    lambda said: F.lit(said),
)
EXTRA_NAMES = ("extra_field", "another_extra_field", "test_field", "dummy_field", "unknown_field", "invalid_field")
EXTRA_RULES = _pattern_rules(
    "m5", "PYDANTIC_EXTRA_FIELD", "warning", "im",
    tuple((name + r":\s*Optional\[", name) for name in EXTRA_NAMES),
    lambda said: F.lit(f"{said} may not be in schema"),
)

MODEL_CHECKS = {
    "m1": [required_fields],
    "m2": [as_check(r) for r in CONSTRAINT_RULES],
    "m3": [as_check(r) for r in COMPLEX_RULES],
    "m4": [as_check(r) for r in MISMATCH_RULES],
    "m5": [as_check(r) for r in EXTRA_RULES],
}

# ---- opt-in model rules ----------------------------------------------------------------------------------------

# Type names that are not models.
BUILTIN_TYPES = (
    "str", "int", "float", "bool", "list", "dict", "tuple", "set", "bytes", "datetime", "date", "time", "uuid",
    "decimal", "path", "url", "email", "ipv4address", "ipv6address",
)
NESTED_STOPS = ("Optional[", "List[", "Dict[", "Union[", "(", "def ")
NESTED = r"(\w+)\s*:\s*(\w+)(?!\s*\[)"
NESTED_PARTS = r"^(\w+)\s*:\s*(\w+)\z"


def _complex_found(kind: Column) -> Column:
    return _say(kind, " type found in model '", _model(), "' - verify type compatibility")


# The patterns, levels and words of these rules.
TYPE_RULE = Rule(
    "m6", "PYDANTIC_COMPLEX_TYPE", "info", r"(\w+)\s*:\s*(Union\[|List\[|Dict\[|Optional\[|Literal\[)", "",
    lambda g: _complex_found(F.substring_index(g(2), "[", 1)), shift=0,
)
UNION_RULE = Rule(
    "m8", "PYDANTIC_COMPLEX_TYPE", "info", r"(\w+)\s*:\s*Union\[([^\]]+)\]", "",
    lambda g: _complex_found(F.lit("Union")), shift=0,
)
NONE_RULE = Rule(
    "m9", "PYDANTIC_NONE_VALUE", "warning",
    r"(\w+)\s*:\s*(?!Optional\[|None\b)([^=]+?)(?:\s*=\s*None)[,)]", "",
    lambda g: _say("Field '", g(1), "' in model '", _model(),
                   "' has default None but type is not Optional - consider using Optional[", strip(g(2)), "]"),
    shift=None,
)
ALIAS_RULE = Rule(
    "m13", "PYDANTIC_ALIAS", "info", r"Field\s*\(\s*[^)]*alias\s*=\s*['\"]([^'\"]+)['\"]", "",
    lambda g: _say("Field alias '", g(1), "' in model '", _model(), "' may not follow consistent naming convention"),
    shift=None,
    keep=lambda g: g(1).contains("_") & ~((g(1) == F.lower(g(1))) & g(1).rlike(r"\p{Ll}")),
)
INHERITANCE_RULE = Rule(
    "m14", "PYDANTIC_INHERITANCE", "warning", r"class\s+(\w+)\s*\(([^)]+)\):", "",
    lambda g: _say("Model '", g(1), "' inherits from multiple Pydantic models which may cause conflicts"),
    shift=None,
    keep=lambda g: F.size(F.filter(F.split(g(2), ","), lambda base: base.rlike("BaseModel|RootModel"))) > 1,
)
FIELD_TYPES = r"(\w+)\s*:\s*(Optional\[([^\]]+)\])?([^=,\n]+?)(?:\s*=\s*([^,\n]+))?"
OPTIONAL_RULE = Rule(
    "m12", "PYDANTIC_OPTIONAL", "info", FIELD_TYPES, "",
    lambda g: _say("Field '", g(1), "' in model '", _model(), "' is Optional but has no default value"),
    shift=None,
    keep=lambda g: (F.length(strip(g(4))) > 0) & (F.length(g(2)) > 0) & (F.length(g(5)) == 0),
)
AMBIGUOUS_RULE = Rule(
    "m12", "PYDANTIC_TYPE_MISMATCH", "warning", FIELD_TYPES, "",
    lambda g: _say("Field '", g(1), "' in model '", _model(), "' has ambiguous type definition"),
    shift=None,
    keep=lambda g: g(4).contains("str") & g(4).contains("int"),
)


def nested_models(text: Column, start_line: Column) -> Column:
    """Annotations that name another model, up to the first parenthesis, function or complex type of the class."""
    ends = [F.when(F.instr(text, stop) > 0, F.instr(text, stop) - 1 + len(stop)) for stop in NESTED_STOPS]

    def issue(hit: Column) -> Column:
        name, kind = (F.regexp_extract(hit["match"], spell(NESTED_PARTS), g) for g in (1, 2))
        message = _say("Nested model '", kind, "' in field '", name, "' - verify model exists")
        return _issue(
            "m7", start_line + hit["lines"], hit["col"] + 1, "info", _tagged("PYDANTIC_NESTED_MODEL", message)
        )

    def search(stop: Column) -> Column:
        def wanted(hit: Column) -> Column:
            kind = F.lower(F.regexp_extract(hit["match"], spell(NESTED_PARTS), 2))
            return ~kind.isin(*BUILTIN_TYPES) & (hit["offset"] < stop)

        return F.transform(F.filter(find_all(text, NESTED), wanted), issue)

    return bind(F.coalesce(F.least(*ends), F.length(text) + 1), search)


def extra_config(text: Column, start_line: Column) -> Column:
    """A class that configures how extra fields are treated."""
    at = F.instr(text, "extra=") - 1
    before = F.substring(text, F.lit(1), at)
    breaks = F.length(before) - F.length(F.replace(before, F.lit("\n")))
    column = F.length(F.substring_index(before, "\n", -1)) + 1

    def issue(said: Column) -> Column:
        return F.array(_issue("m10", start_line + breaks, column, "info", _tagged("PYDANTIC_EXTRA_CONFIG", said)))

    forbid = _say("Model '", _model(), "' has extra='forbid' - extra fields will cause validation errors")
    ignore = _say("Model '", _model(), "' has extra='ignore' - extra fields will be ignored")
    return (
        F.when((at >= 0) & text.rlike(r"(?d)extra.*forbid"), issue(forbid))
        .when((at >= 0) & text.rlike(r"(?d)extra.*ignore"), issue(ignore))
        .otherwise(F.array().cast(ISSUE))
    )


VALIDATOR = r"@(validator|field_validator|model_validator|root_validator)\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"
FUNCTION = r"def\s+(\w+)\s*\([^)]*\):"
FUNCTION_BODY = r"^[^\n]*+(?:\n(?![^\S\n]*def )[^\n]*+)*+"


def validator_fields(text: Column, start_line: Column) -> Column:
    """Validators of a field the class does not define."""
    names = F.transform(
        find_all(text, r"\w+\s*:"), lambda hit: F.regexp_extract(hit["match"], spell(r"^\w+"), 0)
    )

    def search(defined: Column) -> Column:
        def field(hit: Column) -> Column:
            return F.regexp_extract(hit["match"], spell(VALIDATOR), 2)

        def issue(hit: Column) -> Column:
            message = _say(
                "Validator for field '", field(hit), "' found but field may not be defined in model '", _model(), "'"
            )
            return _issue(
                "m11", start_line + hit["lines"], hit["col"] + 1, "warning",
                _tagged("PYDANTIC_FIELD_PRESENCE", message),
            )

        return F.transform(
            F.filter(find_all(text, VALIDATOR), lambda hit: ~F.array_contains(defined, field(hit))), issue
        )

    return bind(names, search)


def validator_returns(text: Column, start_line: Column) -> Column:
    """Validator functions without a return."""

    def look(hit: Column) -> Column:
        end = hit["offset"] + F.length(hit["match"])
        rest = F.substring(text, end + 1, F.length(text))
        at = F.regexp_instr(rest, F.lit(spell(FUNCTION)))
        body = F.regexp_extract(F.substring(rest, at, F.length(rest)), spell(FUNCTION_BODY), 0)
        before = F.substring(text, F.lit(1), end + at - 1)
        return F.struct(
            at.alias("at"),
            F.regexp_extract(rest, spell(FUNCTION), 1).alias("name"),
            body.contains("return").alias("returns"),
            (F.length(before) - F.length(F.replace(before, F.lit("\n")))).alias("lines"),
            F.length(F.substring_index(before, "\n", -1)).alias("col"),
        )

    def issue(item: Column) -> Column:
        message = _say(
            "Validator function '", item["name"], "' in model '", _model(), "' may be missing return statement"
        )
        return _issue(
            "m11", start_line + item["lines"], item["col"] + 1, "warning", _tagged("PYDANTIC_VALIDATOR", message)
        )

    looked = F.transform(find_all(text, VALIDATOR), look)
    return F.transform(F.filter(looked, lambda item: (item["at"] > 0) & ~item["returns"]), issue)


OPT_IN_CHECKS = {
    "m6": [as_check(TYPE_RULE)],
    "m7": [nested_models],
    "m8": [as_check(UNION_RULE)],
    "m9": [as_check(NONE_RULE)],
    "m10": [extra_config],
    "m11": [validator_fields, validator_returns],
    "m12": [as_check(OPTIONAL_RULE), as_check(AMBIGUOUS_RULE)],
    "m13": [as_check(ALIAS_RULE)],
    "m14": [as_check(INHERITANCE_RULE)],
}


def lint_models(models: DataFrame, keep: list[str], rules: list[str] | None = None) -> DataFrame:
    """Model rules over ``(model_name, raw, start_line)``: the five standing ones, or the rules asked for."""
    known = {**MODEL_CHECKS, **OPT_IN_CHECKS}
    checks = [check for rule in (rules or list(MODEL_CHECKS)) for check in known[rule]]
    return lint(models, checks, keep)


def lint_model_files(files: DataFrame, rules: list[str] = ("m12", "m13", "m14")) -> DataFrame:
    """The opt-in rules that also run over a whole file: every issue stands at line 1.

    Field types are looked at from every model class on to the end of the file; aliases name no model.
    """
    base = files.filter(F.col("ext") == "py").select(
        "file", "source", F.lit(1).alias("start_line"), F.lit(None).cast("string").alias("model_name")
    )
    issues = None
    for rule in rules:
        if rule == "m12":
            classes = find_all(F.col("source"), r"class\s+(\w+)\s*\(.*BaseModel.*\):")
            part = base.select("file", "source", "start_line", F.explode(classes).alias("hit")).select(
                "file",
                "start_line",
                F.regexp_extract("hit.match", spell(r"class\s+(\w+)"), 1).alias("model_name"),
                F.substring(F.col("source"), F.col("hit.offset") + 1, F.length("source")).alias("raw"),
            )
        else:
            part = base.withColumnRenamed("source", "raw")
        found = lint(part, OPT_IN_CHECKS[rule], ["file"])
        if rule == "m13":
            found = found.withColumn("message", F.replace("message", F.lit(" in model 'None'"), F.lit("")))
        issues = found if issues is None else issues.unionByName(found)
    return issues
