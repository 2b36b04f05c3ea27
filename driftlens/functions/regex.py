"""Regular expressions written in the usual ``\\w \\s \\d \\b`` notation, spelled out for Spark's engine.

The word, blank and digit classes are Unicode classes, ``.`` stops at a line feed only, and ignoring case follows
Unicode, whatever the JVM's defaults are.
"""

from __future__ import annotations

WORD = r"\p{L}\p{N}_"
BLANK = r"\s\x1c-\x1f\x85\p{Z}"
DIGIT = r"\p{Nd}"
# The characters of ``BLANK`` one by one.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"

ANY = r"[\s\S]"

_CLASSES = {"w": WORD, "s": BLANK, "d": DIGIT}


def spell(pattern: str, flags: str = "") -> str:
    """Return ``pattern`` with explicit Unicode classes; ``flags`` may hold ``i`` and ``m``."""
    out: list[str] = []
    inside = False
    i = 0
    while i < len(pattern):
        char = pattern[i]
        if pattern.startswith(ANY, i):
            out.append("(?s:.)")
            i += len(ANY)
            continue
        if char == "\\":
            code = pattern[i + 1]
            if code in _CLASSES:
                out.append(_CLASSES[code] if inside else f"[{_CLASSES[code]}]")
            elif code.lower() in _CLASSES and not inside:
                out.append(f"[^{_CLASSES[code.lower()]}]")
            elif code == "b" and not inside:
                out.append(EDGE)
            else:
                out.append(char + code)
            i += 2
            continue
        if char == "[":
            inside = True
        elif char == "]":
            inside = False
        out.append(char)
        i += 1
    return "(?d" + ("iu" if "i" in flags else "") + ("m" if "m" in flags else "") + ")" + "".join(out)
