"""Where a text that does not parse goes wrong, and what was expected there.

A pushdown automaton over tokens, as data: for each state the classes of tokens it takes, each with the next state and,
for brackets, the state to come back to. Spark folds a text's tokens over that table; the first token without an entry is
the error. Only texts that are already known not to parse are looked at, each different text once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions.text import newlines
from driftlens.operators.lexer import tokens_of

OPERATIONS = ("query", "mutation", "subscription")
TYPE_WORDS = ("type", "schema", "scalar", "interface", "union", "enum", "input", "directive", "extend")
WORDS = ("name", "on", "operation", "fragment", "type")
MARKS = ("!", "$", "&", "(", ")", ":", "=", "@", "[", "]", "{", "|", "}", "...")
NUMBER = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"
FALLBACK = "the text is not a valid operation document"

# A move is the next state and, if a bracket opens, the state after it closes; BACK returns there.
BACK = ("back", None)
Moves = dict[str, tuple[str, str | None]]


def _with_directives(states: dict[str, tuple[str, Moves]], name: str, expected: str, moves: Moves) -> None:
    """A state that takes directives, the state within a directive's name, and the one after that name."""
    moves = {**moves, "@": (f"{name}: directive", None)}
    states[name] = expected, moves
    states[f"{name}: directive"] = "Name", {"name": (f"{name}: named", None)}
    states[f"{name}: named"] = expected, {**moves, "(": ("first argument", name)}


def _states() -> dict[str, tuple[str, Moves]]:
    """For each state what it expects, empty where several things are possible, and its moves."""
    to = lambda state: (state, None)
    selections = ("first selection", "definition")
    inner = ("first selection", "selection")
    states: dict[str, tuple[str, Moves]] = {}

    starts = {"{": selections, "operation": to("operation"), "fragment": to("fragment"), "type": to("type"), "string": to("type")}
    states["document"] = "", starts
    states["definition"] = "", {**starts, "end": to("definition")}

    header = {"{": selections}
    variables = ("first variable", "header")
    _with_directives(states, "header", "'{'", header)
    named = {**header, "(": variables, "@": to("header: directive")}
    states["operation"] = "'{'", {**named, "name": to("named operation")}
    states["named operation"] = "'{'", named
    states["fragment"] = "Name", {"name": to("fragment name"), "on": None}
    states["fragment name"] = "'on'", {"on": to("fragment type")}
    states["fragment type"] = "Name", {"name": to("header")}

    variable = {"$": to("variable name"), ")": BACK}
    _with_directives(states, "variable", "'$'", variable)
    states["first variable"] = "'$'", {"$": to("variable name")}
    states["variable name"] = "Name", {"name": to("variable colon")}
    states["variable colon"] = "':'", {":": to("variable type")}
    after = {**variable, "@": to("variable: directive"), "=": ("value", "variable")}
    states["variable type"] = "Name", {"name": to("typed"), "[": ("item type", "typed")}
    states["typed"] = "'$'", {**after, "!": to("required")}
    states["required"] = "'$'", after
    states["item type"] = "Name", {"name": to("typed item"), "[": ("item type", "typed item")}
    states["typed item"] = "']'", {"]": BACK, "!": to("required item")}
    states["required item"] = "']'", {"]": BACK}

    for state, then in (("value", BACK), ("item", to("item"))):
        back = None if then == BACK else state
        opened = lambda inside: (inside, back) if back else to(inside)  # noqa: B023, E731
        states[state] = "", {
            "name": then, "number": then, "string": then, "[": opened("item"), "{": opened("entry"), "$": opened("value name"),
        }
    states["item"][1]["]"] = BACK
    states["value name"] = "Name", {"name": BACK}
    states["entry"] = "Name", {"name": to("entry colon"), "}": BACK}
    states["entry colon"] = "':'", {":": ("value", "entry")}
    states["first argument"] = "Name", {"name": to("argument colon")}
    states["argument"] = "Name", {"name": to("argument colon"), ")": BACK}
    states["argument colon"] = "':'", {":": ("value", "argument")}

    selection = {"name": to("field"), "...": to("spread"), "}": BACK}
    states["first selection"] = "Name", {"name": to("field"), "...": to("spread")}
    states["selection"] = "Name", selection
    _with_directives(states, "after arguments", "Name", {**selection, "{": inner})
    aliased = {**selection, "{": inner, "(": ("first argument", "after arguments"), "@": to("after arguments: directive")}
    states["field"] = "Name", {**aliased, ":": to("alias")}
    states["alias"] = "Name", {"name": to("aliased field")}
    states["aliased field"] = "Name", aliased
    _with_directives(states, "after spread", "Name", selection)
    _with_directives(states, "inline", "'{'", {"{": inner})
    states["spread"] = "'{'", {"name": to("after spread"), "on": to("condition"), "@": to("inline: directive"), "{": inner}
    states["condition"] = "Name", {"name": to("inline")}

    # Definitions of types are only followed by their brackets.
    opening, closing = "([{", ")]}"
    loose = {c: to("type") for c in ("number", "string", "end", *WORDS, *MARKS) if c not in closing}
    states["type"] = "", {**loose, **{c: ("type body", "type") for c in opening}, "operation": to("operation"), "fragment": to("fragment")}
    within = {c: to("type body") for c in ("number", "string", *WORDS, *MARKS)}
    states["type body"] = "", {**within, **{c: ("type body", "type body") for c in opening}, **{c: BACK for c in closing}}
    return states


_STATES = _states()
# One character per state, so that the open brackets are a text.
_SIGN = {name: chr(0x41 + i) for i, name in enumerate(_STATES)} | {"back": "-"}


def _table() -> Column:
    """State to class to move; a move is the sign of the next state and the sign to come back to, if any."""
    rows = []
    for name, (_, moves) in _STATES.items():
        full = {**({word: moves["name"] for word in WORDS} if "name" in moves else {}), **moves}
        cells = [F.lit(x) for c, move in full.items() if move for x in (c, _SIGN[move[0]] + (_SIGN[move[1]] if move[1] else ""))]
        rows += [F.lit(_SIGN[name]), F.create_map(*cells)]
    return F.create_map(*rows)


def _class(tok: Column) -> Column:
    """What the automaton sees of a token; null for one that no text may hold."""
    return (
        F.when(tok == "on", "on")
        .when(tok.isin(*OPERATIONS), "operation")
        .when(tok == "fragment", "fragment")
        .when(tok.isin(*TYPE_WORDS), "type")
        .when(tok.rlike("^[_A-Za-z]"), "name")
        .when(tok.isin(*MARKS), tok)
        .when(tok.startswith('"') & (F.length(tok) > 1), "string")
        .when(tok.rlike(NUMBER), "number")
    )


def _described(tok: Column) -> Column:
    block = tok.startswith('"""') & (F.length(tok) >= 6)
    quoted = lambda kind, text: F.concat(F.lit(f"{kind} '"), text, F.lit("'"))
    return (
        F.when(tok.isNull(), "<EOF>")
        .when(tok.isin(*MARKS), F.concat(F.lit("'"), tok, F.lit("'")))
        .when(tok.rlike("^[_A-Za-z]"), quoted("Name", tok))
        .when(block, quoted("BlockString", F.substring(tok, F.lit(4), F.length(tok) - 6)))
        .when(tok.startswith('"'), quoted("String", F.substring(tok, F.lit(2), F.length(tok) - 2)))
        .when(tok.rlike(r"^-?[0-9]+$"), quoted("Int", tok))
        .otherwise(quoted("Float", tok))
    )


def _first_refused(tokens: Column) -> Column:
    """``at, state``: the place of the first token without a move, 0 if there is none, and the sign of the state there."""
    table = _table()
    start = F.struct(
        F.lit(_SIGN["document"]).alias("state"), F.lit("").alias("open"), F.lit(0).alias("n"), F.lit(0).alias("at")
    )

    def step(acc: Column, token: Column) -> Column:
        move = F.try_element_at(F.try_element_at(table, acc["state"]), token["kind"])
        back = F.substring(move, 1, 1) == "-"
        state = F.when(back, F.substring(acc["open"], -1, 1)).otherwise(F.substring(move, 1, 1))
        opened = F.when(back, F.substring(acc["open"], F.lit(1), F.length(acc["open"]) - 1)).otherwise(
            F.concat(acc["open"], F.substring(move, 2, 1))
        )
        n = acc["n"] + 1
        refused = F.struct(acc["state"].alias("state"), acc["open"].alias("open"), n.alias("n"), n.alias("at"))
        taken = F.struct(state.alias("state"), opened.alias("open"), n.alias("n"), F.lit(0).alias("at"))
        return F.when(acc["at"] > 0, acc).when(move.isNull(), refused).otherwise(taken)

    return F.aggregate(tokens, start, step, lambda acc: F.struct(acc["at"].alias("at"), acc["state"].alias("state")))


def syntax_errors(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, at_line, at_col, problem`` of texts that do not parse; ``key`` must be unique per row.

    A text in which the automaton finds nothing wrong has its first place and a general message.
    """
    read = texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"), tokens_of(F.col(text)).alias("_read"))
    classed = F.transform("_read", lambda t: F.struct(*[t[c].alias(c) for c in ("n", "offset", "line", "col", "tok")], _class(t["tok"]).alias("kind")))
    whole = read.select(key, "_text", classed.alias("tokens"))
    last = F.substring_index("_text", "\n", -1)
    end = F.struct(
        F.size("tokens").alias("n"), F.length("_text").cast("int").alias("offset"), (newlines(F.col("_text")) + 1).cast("int").alias("line"),
        (F.length(last) + 1).cast("int").alias("col"), F.lit(None).cast("string").alias("tok"), F.lit("end").alias("kind"),
    )
    whole = whole.withColumn("tokens", F.concat("tokens", F.array(end)))
    found = whole.withColumn("_found", _first_refused(F.col("tokens")))
    found = found.withColumn("_t", F.when(F.col("_found.at") > 0, F.try_element_at("tokens", F.col("_found.at"))))
    tok, kind, state = F.col("_t.tok"), F.col("_t.kind"), F.col("_found.state")
    expected = F.create_map(*[F.lit(x) for name, (wanted, _) in _STATES.items() for x in (_SIGN[name], wanted)])
    wanted = F.try_element_at(expected, state)
    open_string = (tok == '"') & kind.isNull()
    rest = F.substring(F.col("_text"), F.col("_t.offset") + 1, F.length("_text"))
    open_block = open_string & rest.startswith('"""')
    unexpected = (wanted == "") | ((state == _SIGN["fragment"]) & (kind == "on"))
    problem = (
        F.when(F.col("_found.at") == 0, FALLBACK)
        .when(open_string, "Syntax Error: Unterminated string.")
        .when(kind.isNull() & tok.rlike("^-?[0-9]"), F.concat(F.lit("Syntax Error: Invalid number '"), tok, F.lit("'.")))
        .when(kind.isNull(), F.concat(F.lit("Syntax Error: Unexpected character: '"), tok, F.lit("'.")))
        .when(unexpected, F.concat(F.lit("Syntax Error: Unexpected "), _described(tok), F.lit(".")))
        .otherwise(F.concat(F.lit("Syntax Error: Expected "), wanted, F.lit(", found "), _described(tok), F.lit(".")))
    )
    # A string that is not closed goes wrong at the end of its line, a block string at the end of the text.
    column = F.when(open_block, end["col"]).when(open_string, F.col("_t.col") + F.length(F.substring_index(rest, "\n", 1)))
    line = F.when(open_block, end["line"]).otherwise(F.col("_t.line"))
    return found.select(
        key,
        F.coalesce(line, F.lit(1)).cast("int").alias("at_line"),
        F.coalesce(column, F.col("_t.col"), F.lit(1)).cast("int").alias("at_col"),
        problem.alias("problem"),
    )
