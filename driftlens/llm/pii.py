"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton over a text finds anchors: at-signs, plus signs before digits, digits before a dot, runs
of digits, schemes, and words that announce an identifier. Each anchor has a parser of its own that expands it to both
sides by fixed rules and says where the find begins and ends, or that there is none. No parser looks at a text from its
beginning, and an anchor inside what its kind has already read is passed over, so a text is read once and each find once.

Base kinds, leftmost and without overlaps inside a kind; a match that fails its test is dropped, and what it covered is not
tried again:

* ``email``: a local part, an at-sign, and labels with at least one dot between them;
* ``ip``: four runs of digits with single dots between them, each at most 255;
* ``card``: digits with single blanks or hyphens between them, 13 to 19 of them that pass the Luhn test;
* ``phone``: a plus sign, then digits, blanks, parentheses, dots and hyphens from digit to digit, 9 to 15 digits.

Kinds that a cue or a scheme announces:

* ``iban``: after the cue, two letters, two digits and up to 30 letters and digits that pass the test modulo 97;
* ``account``: after the cue, 6 to 17 digits with single blanks or hyphens between them;
* ``ssn``: after the cue, three, two and four digits with hyphens or blanks, none of them all zeros;
* ``login``: the user and password of an address with a scheme, up to its at-sign.

Defined results: null and empty texts hold nothing; offsets count code points, ends are exclusive; equal rows and null keys are
rows like others; texts of any length are read whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import pieces

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "account", "ssn", "login")
# What announces an identifier, in lower case, and schemes of addresses with a user.
CUES = {
    "iban": ("iban",),
    "account": ("account number", "account no", "acct", "konto", "kontonummer", "numéro de compte", "número de cuenta", "compte n"),
    "ssn": ("ssn", "social security"),
}
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "sftp://", "postgres://", "mysql://", "mongodb://", "redis://", "amqp://")

DIGITS = "0123456789"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + DIGITS + "._%+-")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + DIGITS + "-")
DIGIT = frozenset(DIGITS)
# What may stand between a cue and its identifier.
_LINK = re.compile(r"[ \t]{0,3}(?:(?:number|no|nr|num|is|ist|est|es|code)\b)?[.:#=\x20\t]{0,4}", re.IGNORECASE)
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9])")
_SSN = re.compile(r"([0-9]{3})([- ])([0-9]{2})\2([0-9]{4})(?![0-9])")
_LOGIN = re.compile(r"[^\s/@:]{1,64}:[^\s/@]{1,128}@(?=[A-Za-z0-9])")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"[\x20().0-9-]+")


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """All anchors; the value is the kind they belong to and the length of the anchor."""
    made = ahocorasick.Automaton()
    made.add_word("@", ("email", 1))
    for digit in DIGITS:
        made.add_word("+" + digit, ("phone", 2))
        made.add_word(digit + ".", ("ip", 2))
        for other in DIGITS:
            for between in ("", " ", "-"):
                made.add_word(digit + between + other, ("card", 2 + len(between)))
    for kind, cues in CUES.items():
        for cue in cues:
            made.add_word(cue, (kind, len(cue)))
    for scheme in SCHEMES:
        made.add_word(scheme, ("login", len(scheme)))
    made.make_automaton()
    return made


def folded(text: str) -> str:
    """The text in lower case with every code point where it was."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def email(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    """The match around the at-sign at ``at``, with nothing before ``free``."""
    begin = at
    while begin > free and text[begin - 1] in LOCAL:
        begin -= 1
    if begin == at:
        return None
    end, labels, size = at + 1, 0, len(text)
    while True:
        stop = end
        while stop < size and text[stop] in LABEL:
            stop += 1
        if stop == end:
            # A dot without a label after it does not belong to the match.
            end -= 1
            break
        labels += 1
        if stop >= size or text[stop] != ".":
            end = stop
            break
        end = stop + 1
    return (begin, end, True) if labels > 1 else None


def address(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    """Four numbers from the run of digits that ends with the anchor's digit."""
    begin = at
    while begin > free and text[begin - 1] in DIGIT:
        begin -= 1
    end, parts, size = begin, [], len(text)
    while len(parts) < 4:
        stop = end
        while stop < size and text[stop] in DIGIT:
            stop += 1
        if stop == end:
            return None
        parts.append(text[end:stop])
        end = stop
        if len(parts) < 4:
            if end >= size or text[end] != ".":
                return None
            end += 1
    small = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    return begin, end, small


def luhn(digits: str) -> bool:
    total = 0
    for i, sign in enumerate(reversed(digits)):
        n = int(sign) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def card(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    """The whole chain of digits; its first two digits are the anchor."""
    found = _CARD.match(text, at)
    digits = found[0].replace(" ", "").replace("-", "") if found.end() - at <= 2 * 19 else ""
    return at, found.end(), 13 <= len(digits) <= 19 and luhn(digits)


def phone(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    rest = _PHONE.match(text, at + 2)
    if rest is None:
        return None
    end = rest.end()
    while end > at + 3 and text[end - 1] not in DIGIT:
        end -= 1
    if end <= at + 3:
        return None
    return at, end, 9 <= sum(c in DIGIT for c in text[at:end]) <= 15


def _after_cue(text: str, at: int) -> int:
    return _LINK.match(text, at).end()


def iban(text: str, begin: int) -> tuple[int, int] | None:
    found = _IBAN.match(text, begin)
    if found is None:
        return None
    # The longest end that passes; countries differ in length.
    for end in range(found.end(), begin + 14, -1):
        signs = text[begin:end].replace(" ", "").upper()
        if text[end - 1] != " " and 15 <= len(signs) and (end >= len(text) or not text[end].isalnum()):
            if int("".join(str(int(c, 36)) for c in signs[4:] + signs[:4])) % 97 == 1:
                return begin, end
    return None


def account(text: str, begin: int) -> tuple[int, int] | None:
    found = _ACCOUNT.match(text, begin)
    return found.span() if found else None


def ssn(text: str, begin: int) -> tuple[int, int] | None:
    found = _SSN.match(text, begin)
    return found.span() if found and all(int(found[i]) for i in (1, 3, 4)) else None


def login(text: str, begin: int) -> tuple[int, int] | None:
    found = _LOGIN.match(text, begin)
    return (begin, found.end() - 1) if found else None


PARSERS = {"email": email, "ip": address, "card": card, "phone": phone}
ANNOUNCED = {"iban": iban, "account": account, "ssn": ssn, "login": login}


def spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """All finds of a text by kind, in order of their start."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    free = dict.fromkeys(KINDS, 0)
    for last, (kind, size) in automaton().iter(folded(text)):
        at = last - size + 1
        if kind in PARSERS:
            if at < free[kind]:
                continue
            match = PARSERS[kind](text, at, free[kind])
            if match:
                begin, end, good = match
                free[kind] = end
                if good:
                    found[kind].append((begin, end))
        else:
            begin = last + 1 if kind == "login" else _after_cue(text, last + 1)
            match = ANNOUNCED[kind](text, begin) if begin >= free[kind] else None
            if match:
                found[kind].append(match)
                free[kind] = match[1]
    return found


def listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in kinds for a, b in found[kind])


def find(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key, ``spans`` (arrays ``kind, start, stop``) and the number of finds of each base kind, one row per text."""
    kind = dict(docs.dtypes)[key]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            own = [spans(value or "") for value in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            rows = [[{"kind": k, "start": a, "stop": b} for k in KINDS for a, b in found[k]] for found in own]
            counts = [pa.array([len(found[k]) for found in own], pa.int64()) for k in BASE]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(key)), pa.array(rows, span), *counts], names=[key, "spans", *(f"n_{k}" for k in BASE)]
            )

    columns = ", ".join(f"n_{k} long" for k in BASE)
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, spans array<struct<kind:string,start:bigint,stop:bigint>>, {columns}")


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of the registered query from ``find``'s rows."""
    text = lambda rows: F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(key, *(f"n_{k}" for k in BASE), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def masked(text: str) -> str:
    """The text with every find replaced by its kind; overlapping finds are one, named by the first."""
    every = sorted((a, -b, kind) for kind, own in spans(text).items() for a, b in own)
    out, at = [], 0
    for a, minus_b, kind in every:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, -minus_b)
    return "".join([*out, text[at:]])


__all__ = ["BASE", "KINDS", "automaton", "digests", "find", "masked", "spans"]
