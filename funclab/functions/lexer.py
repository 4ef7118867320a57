"""Comments of texts whose strings hold code, found in one pass with a stack.

Kotlin writes code into a string as ``${ }`` and Swift as ``\\( )``. Such a hole may span lines, and
holds strings with holes of their own, so no pattern follows it. Here each open string and each open
hole is an entry of a stack; what ends one brings back the one around it.
"""

from __future__ import annotations

import re

#: Languages whose strings can hold code.
LANGUAGES = ("kotlin", "swift")

# In code: what opens a comment, a string or a character literal, and the brackets of holes.
_CODE = {
    "kotlin": re.compile(r"//|/\*|\"\"\"|\"|'(?:[^'\\\n]|\\[^\n][^'\n]*)'|[{}]"),
    "swift": re.compile(r"//|/\*|#+/|#*\"\"\"|#*\"|[()]"),
}
_BLOCK_SIGN = re.compile(r"/\*|\*/")
_STRINGS: dict[tuple[str, str], re.Pattern] = {}


def _string_events(language: str, opener: str) -> re.Pattern:
    """What matters inside a string: its end, a hole, and escapes, which hide both."""
    if (language, opener) not in _STRINGS:
        quotes = opener.lstrip("#")
        marks = opener[: -len(quotes)]
        if language == "kotlin":
            # Quotes before the last three of a raw string are its own.
            end, hole, escape = (r"\"{3,}", r"\$\{", None) if quotes == '"""' else (r"\"", r"\$\{", r"\\.")
        else:
            end, hole, escape = quotes + marks, rf"\\{marks}\(", rf"\\{marks}."
        parts = [rf"(?P<end>{end})", rf"(?P<hole>{hole})", *([escape] if escape else [])]
        _STRINGS[language, opener] = re.compile("|".join(parts), re.DOTALL)
    return _STRINGS[language, opener]


def _note_ends(code, start, ends):
    """Note in ``ends`` where the blocks opened from ``start`` on end, until the first one does."""
    opened = []
    for found in _BLOCK_SIGN.finditer(code, start):
        if found.group() == "/*":
            opened.append(found.start())
        else:
            ends[opened.pop()] = found.end()
            if not opened:
                return
    ends.update(dict.fromkeys(opened))


def block_end(code: str, at: int, nests: bool, ends: dict) -> int | None:
    """End of the block comment that opens at ``at``; None where it stays open.

    ``ends`` keeps what was found out, so many open blocks cost no more than one.
    """
    if nests:
        if at not in ends:
            _note_ends(code, at, ends)
        return ends[at]
    if "open" in ends:  # no end follows an earlier block, so none follows this one
        return None
    found = code.find("*/", at + 2)
    if found < 0:
        ends["open"] = at
        return None
    return found + 2


def comment_spans(code: str, language: str) -> tuple[list[tuple[int, int]], int]:
    """Start and end of each comment, and where the pass ended.

    That is the end of the text, unless a string or a hole stays open: then it is the start of the
    outermost such string, and what follows is not told.
    """
    left, right = "{}" if language == "kotlin" else "()"
    pattern, spans, at = _CODE[language], [], 0
    stack: list[list] = []  # strings as [start, events], holes as [open brackets]
    ends, open_marks = {}, set()
    while True:
        if stack and len(stack[-1]) == 2:
            event = stack[-1][1].search(code, at)
            if event is None:
                break
            at = event.end()
            if event.group("end"):
                stack.pop()
            elif event.group("hole"):
                stack.append([1])
            continue
        event = pattern.search(code, at)
        if event is None:
            break
        sign, start, at = event.group(), event.start(), event.end()
        if sign == "//":
            at = code.find("\n", at)
            at = len(code) if at < 0 else at
            spans.append((start, at))
        elif sign == "/*":
            end = block_end(code, start, True, ends)
            if end is not None:
                spans.append((start, end))
            at = start + 1 if end is None else end
        elif sign in (left, right):
            if stack:
                stack[-1][0] += 1 if sign == left else -1
                if stack[-1][0] == 0:
                    stack.pop()
        elif sign[0] == "#" and sign[-1] == "/":  # a regular expression, unless no end follows
            closing = "/" + sign[:-1]
            end = -1 if closing in open_marks else code.find(closing, at)
            if end < 0:
                open_marks.add(closing)
            at = end + len(closing) if end >= 0 else at - 1
        elif sign[-1] == '"':
            stack.append([start, _string_events(language, sign)])
    if not stack:
        return spans, len(code)
    stop = stack[0][0]
    return [s for s in spans if s[0] < stop], stop


def cut_at(code: str, spans) -> list[str]:
    """The text cut into comments and what lies between; only comments start with ``//`` or ``/*``."""
    out, at = [], 0
    for start, end in [*spans, (len(code), len(code))]:
        between = code[at:start]
        if between.startswith(("//", "/*")):
            out.append(between[0])
            between = between[1:]
        out += [x for x in (between, code[start:end]) if x]
        at = end
    return out
