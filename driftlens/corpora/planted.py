"""Texts with planted content: source templates, and what a harvest must find in each.

``<o>`` stands for an order's key, ``<k>`` for half of it, ``<k1>`` for the number after that, ``<c>`` for a
customer's key. A template is chosen by ``key % number of templates``; nothing else varies, so results follow from
the key alone.
"""

from __future__ import annotations

SOURCES = (
    'from gql import gql\nq = gql("""\nquery Q<o> {\n  t<k> { f0 { f1 f2 } f3 }\n}\n""")\n',
    "client.execute(gql('query Q<o> { t<k> { f4 F5 nope } }'))\n",
    'query = """query Q<o>($a: Int) {\n  t<k>(first: $a) { f0 { f6 } }\n}"""\n',
    'text = f"query Q<o> {{ t<k>(id: {user_id}) {{ f1 }} }}"\n',
    'part = "query Q<o> {"\nfull = part + " t<k> { f2 f3 } " + "}"\n',
    'def load():\n    return "query Q<o> { " + "t<k> { f5 }" + " }"\n',
    'doc = gql("""\nfragment F<o> on T<k> { f1 f2 }\nquery Q<o> { t<k> { ...F<o> f0 { ... on T<k1> { f4 } } } }\n""")\n'
    'again = gql("""\nquery Q<o> { t<k> { ...F<o> f0 { ... on T<k1> { f4 } } } }\n""")\n',
    "def broken(:\n    return 'mutation M<o> { m<k> { f1 } }'\n",
    'from pydantic import BaseModel\nbody = "query Q<o> { t<k> { f6 } }"\nclass Req<o>(BaseModel):\n'
    '    query: str = "subscription S<o> { t<k> { f1 } }"\nrun(gql(body))\nrun(gql(Req<o>.query))\n',
)

# What is found: template, type, name, text, start line, end line. A null type condition, name or text is None.
BLOCKS = (
    (0, "query", "Q<o>", "query Q<o> {\n  t<k> { f0 { f1 f2 } f3 }\n}", 2, 4),
    (1, "query", "Q<o>", "query Q<o> { t<k> { f4 F5 nope } }", 1, 1),
    (2, "query", "Q<o>", "query Q<o>($a: Int) {\n  t<k>(first: $a) { f0 { f6 } }\n}", 1, 3),
    (3, "query", "Q<o>", "query Q<o> { t<k>(id: 1) { f1 } }", 1, 1),
    (3, "unknown", None, "query Q<o> { t<k>(id: ) { f1 } }", 1, 1),
    (4, "query", "Q<o>", "query Q<o> { t<k> { f2 f3 } }", 2, 2),
    (5, "query", "Q<o>", "query Q<o> { t<k> { f5 } }", 2, 2),
    (5, "unknown", None, "query Q<o> { t<k> { f5 }", 2, 2),
    (6, "fragment", "F<o>", "fragment F<o> on T<k> { f1 f2 }", 1, 1),
    (6, "query", "Q<o>", "query Q<o> { t<k> { ...F<o> f0 { ... on T<k1> { f4 } } } }", 2, 2),
    (7, "mutation", "M<o>", "mutation M<o> { m<k> { f1 } }", 2, 2),
    (8, "query", "Q<o>", "query Q<o> { t<k> { f6 } }", 2, 2),
    (8, "subscription", "S<o>", "subscription S<o> { t<k> { f1 } }", 4, 4),
)

# Candidate texts by strategy: template, strategy, body, first and last line.
CANDIDATES = (
    (0, 1, "\nquery Q<o> {\n  t<k> { f0 { f1 f2 } f3 }\n}\n", 2, 6),
    (6, 1, "\nfragment F<o> on T<k> { f1 f2 }\nquery Q<o> { t<k> { ...F<o> f0 { ... on T<k1> { f4 } } } }\n", 1, 4),
    (6, 1, "\nquery Q<o> { t<k> { ...F<o> f0 { ... on T<k1> { f4 } } } }\n", 5, 7),
    (0, 2, "\nquery Q<o> {\n  t<k> { f0 { f1 f2 } f3 }\n}\n", 2, 6),
    (1, 2, "query Q<o> { t<k> { f4 F5 nope } }", 1, 1),
    (6, 2, "\nfragment F<o> on T<k> { f1 f2 }\nquery Q<o> { t<k> { ...F<o> f0 { ... on T<k1> { f4 } } } }\n", 1, 4),
    (6, 2, "\nquery Q<o> { t<k> { ...F<o> f0 { ... on T<k1> { f4 } } } }\n", 5, 7),
    (2, 3, "query Q<o>($a: Int) {\n  t<k>(first: $a) { f0 { f6 } }\n}", 1, 3),
    (2, 4, "query Q<o>($a: Int) {\n  t<k>(first: $a) { f0 { f6 } }\n}", 1, 3),
    (3, 4, "query Q<o> { t<k>(id: 1) { f1 } }", 1, 1),
    (4, 4, "query Q<o> { t<k> { f2 f3 } }", 2, 2),
    (5, 4, "query Q<o> { t<k> { f5 } }", 2, 2),
    (7, 4, "'mutation M<o> { m<k> { f1 } }'", 2, 2),
    (8, 4, "query Q<o> { t<k> { f6 } }", 2, 2),
    (8, 4, "subscription S<o> { t<k> { f1 } }", 4, 4),
    (8, 5, "query Q<o> { t<k> { f6 } }", 5, 5),
    (8, 6, "subscription S<o> { t<k> { f1 } }", 4, 4),
    (3, 7, "query Q<o> { t<k>(id: ) { f1 } }", 1, 1),
    (5, 7, "query Q<o> { t<k> { f5 } }", 2, 2),
    (5, 7, "query Q<o> { t<k> { f5 }", 2, 2),
)

# Selected fields of the blocks above: template, type of the block, name as it stands in the text, and the fields
# and type conditions that lead to it. A spread's fields stand in the fragment's text.
SELECTED = (
    (0, "query", "t<k>", ""),
    (0, "query", "f0", ".t<k>"),
    (0, "query", "f1", ".t<k>/.f0"),
    (0, "query", "f2", ".t<k>/.f0"),
    (0, "query", "f3", ".t<k>"),
    (1, "query", "t<k>", ""),
    (1, "query", "f4", ".t<k>"),
    (1, "query", "F5", ".t<k>"),
    (1, "query", "nope", ".t<k>"),
    (2, "query", "t<k>", ""),
    (2, "query", "f0", ".t<k>"),
    (2, "query", "f6", ".t<k>/.f0"),
    (3, "query", "t<k>", ""),
    (3, "query", "f1", ".t<k>"),
    (4, "query", "t<k>", ""),
    (4, "query", "f2", ".t<k>"),
    (4, "query", "f3", ".t<k>"),
    (5, "query", "t<k>", ""),
    (5, "query", "f5", ".t<k>"),
    (6, "fragment", "f1", ""),
    (6, "fragment", "f2", ""),
    (6, "query", "t<k>", ""),
    (6, "query", "f0", ".t<k>"),
    (6, "query", "f4", ".t<k>/.f0/:T<k1>"),
    (7, "mutation", "m<k>", ""),
    (7, "mutation", "f1", ".m<k>"),
    (8, "query", "t<k>", ""),
    (8, "query", "f6", ".t<k>"),
    (8, "subscription", "t<k>", ""),
    (8, "subscription", "f1", ".t<k>"),
)

# A standalone operation document per customer, and its definitions with their true lines.
DOCUMENT = (
    "# customer <c>\nquery A<c> {\n  t<c> { f0 }\n}\n\nmutation B<c>($x: Int = 3, $y: [String!]) {\n"
    "  m<c>(a: $x, b: {c: $y}) { f1 }\n}\n{ t<c> { f2 } }\n"
)
DOCUMENT_BLOCKS = (
    ("query", "A<c>", 0, 2, 4),
    ("mutation", "B<c>", 2, 6, 8),
    ("query", None, 0, 9, 9),
)

# A model class per customer, line by line: (modulus, residue, text) rows, the last one for all other keys.
MODEL = (
    ((7, 0, "class M<c>(BaseModel, RootModel):"), (1, 0, "class M<c>(BaseModel):")),
    ((2, 0, "    id: int"), (1, 0, "    id: int = 1")),
    ((3, 0, "    tags: Optional[List[str]] = None"), (3, 1, "    tags: Optional[str | int] = None"),
     (1, 0, '    tags: str = "a"')),
    ((4, 0, "    phone: Optional[int] = None"), (4, 1, "    price: Optional[str] = None"),
     (1, 0, "    phone: Optional[str] = None")),
    ((5, 0, "    extra_field: Optional[str] = None"), (5, 1, "    another_extra_field: Optional[str] = None"),
     (5, 2, "    test_field: Optional[str] = None"), (1, 0, '    note: str = "n"')),
    ((6, 0, "    code: str = Field(max_length=10)"), (6, 1, "    code: int = Field(ge=1, le=9)"),
     (6, 2, '    code: str = Field(alias="codeName_X")'), (6, 3, '    code: str = Field(regex="x")'),
     (6, 4, '    code: str = Field(alias="code_name")'), (1, 0, '    code: str = "c"')),
    ((4, 2, "    kind: Union[int, str] = 1"), (4, 3, '    lit: Literal["a"] = "a"'), (1, 0, "    size: int = 1")),
    ((3, 0, '    model_config = ConfigDict(extra="forbid")'), (3, 1, '    model_config = ConfigDict(extra="ignore")'),
     (1, 0, "    flag: bool = True")),
    ((5, 3, '    @field_validator("missing")'), (1, 0, '    @field_validator("id")')),
    ((2, 0, "    def check(cls, v: int = None, w=1):"), (1, 0, "    def check(cls, v: int = 0, w=1):")),
    ((4, 0, "        pass"), (1, 0, "        return v")),
    ((5, 4, "    opt: Optional[int]|None"), (1, 0, "    opt: int = 2")),
)
MODEL_START = 3

# A dataclass per supplier.
DATACLASS = "class D<s>:\n    a: int = 1\n    owner: Part<s>\n    other: Optional[str] = None\n    late: Thing\n"

# An operation with one defect of each kind per order, for the operation rules: (modulus, residue, text) rows.
DEFECTS = (
    ((3, 0, "query D<o>($n: String!, $m: Int) {"), (3, 1, "subscription W<o> {"), (1, 0, "query D<o> {")),
    ((4, 0, "  customer { id }"), (4, 1, "  Product() { id }"), (4, 2, "  items(extraArg: 1) { id }"),
     (1, 0, "  order(id: 1) { id }")),
    ((5, 0, '  list(first: "ten") { id }'), (5, 1, "  list(limit: $n) { id }"), (1, 0, "  list(first: 10) { id }")),
    ((7, 0, "  nonExistentThing"), (7, 1, "  latest"), (1, 0, "  title")),
    ((6, 0, "  name @invalidThing"), (6, 1, "  name @include(if: true)"), (1, 0, "  name")),
    ((4, 0, "  ... on T<k> { id }"), (4, 1, "  ... Part<o>"), (1, 0, "  id")),
    ((1, 0, "}"),),
    ((8, 0, "fragment Part<o> on T<k> { id }"), (1, 0, "# end")),
)

# Texts that do not parse: text, line and column of the first wrong token, what is told about it.
WRONG = (
    ("query Q<o> {\n  a( ) { b }\n}", 2, 6, "Expected Name, found ')'."),
    ("query Q<o>(\n  $x: ) { a }", 2, 7, "Expected Name, found ')'."),
    ("fragment F<o>\n  { a }", 2, 3, "Expected 'on', found '{'."),
    ("{ a }\nhello<o> { b }", 2, 1, "Unexpected Name 'hello<o>'."),
    ('query Q<o> {\n  a(s: "open) { b }\n}', 2, 20, "Unterminated string."),
    ("query Q<o> {\n  a ? b\n}", 2, 5, "Unexpected character: '?'."),
    ("query Q<o> {\n  ... on { a }\n}", 2, 10, "Expected Name, found '{'."),
    ("query Q<o> {\n  a(x: [1, {y: ]) }\n}", 2, 16, "Unexpected ']'."),
    ("query Q<o>\n  @skip { a", 2, 12, "Expected Name, found <EOF>."),
    ("mutation M<o>", 1, 0, "Expected '{', found <EOF>."),
    ("{ a(x: 1) { b(<o> }", 1, 15, "Expected Name, found Int '<o>'."),
)
