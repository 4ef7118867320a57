"""Reading labels and line numbers out of free-text answers."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from funclab.config import ANALYSIS_MARKER, NON_VULNERABLE, VULNERABLE
from funclab.functions.binding import bind
from funclab.functions.text import lines_of_code, split_lines, strip

_NO_LINES = "array<int>"
#: Quoted lines times lines of code that are tried one by one; beyond that an index is made of the lines.
TRIED = 8_192


def extract_analysis(answer: Column, strict_marker: bool = False) -> Column:
    """What follows the marker on its line.

    Without a marker the text from the ninth character on is taken, as if the marker had ended
    there; ``strict_marker`` gives null instead.
    """
    at = F.instr(F.lower(answer), ANALYSIS_MARKER)
    rest = F.substring(answer, at + F.lit(len(ANALYSIS_MARKER)), F.lit(1 << 30))
    found = strip(F.substring_index(rest, "\n", 1))
    return F.when(at > 0, found) if strict_marker else found


def response_label(answer: Column, strict_marker: bool = False) -> Column:
    """0 where the analysis says non-vulnerable, else 1."""
    analysis = extract_analysis(strip(F.lower(answer)), strict_marker)
    return F.when(analysis.contains(NON_VULNERABLE.lower()), F.lit(0)).when(analysis.isNotNull(), F.lit(1))


def line_question_gate(answer: Column) -> Column:
    """True where the analysis is "vulnerable" and nothing else; only then lines are asked for."""
    return F.lower(extract_analysis(strip(answer))) == VULNERABLE.lower()


def quoted_code(line_answer: Column) -> Column:
    """The code pieces of an answer: between backticks, or after the first ``: `` of a line."""

    def piece(line):
        quoted = strip(F.get(F.split(line, "`"), F.lit(1)))
        colon = F.instr(line, ": ")
        after = strip(F.substring(line, colon + 2, F.lit(1 << 30)))
        return F.when(line.contains("`"), quoted).when(colon > 0, after)

    return F.array_compact(F.transform(split_lines(strip(line_answer)), piece))


class LineIndex:
    """The lines of a text, to be taken one after the other.

    A piece takes the first free line that contains it, or that it starts with. Lines that contain
    it are found by searching the whole text, from where the last search for the same piece ended;
    lines that are one of its beginnings are looked up in a map from line to places.
    """

    def __init__(self, lines: list[str]):
        self.text, self.free = "\n".join(lines) + "\n", [True] * len(lines)
        self.starts, self.places, self.searched = [], {}, {}
        at = 0
        for i, line in enumerate(lines):
            self.starts.append(at)
            at += len(line) + 1
            self.places.setdefault(line, [0, []])[1].append(i)
        self.lengths = sorted({len(line) for line in self.places})

    def _containing(self, piece):
        at = self.searched.get(piece, 0)
        while at < len(self.text):
            found = self.text.find(piece, at)
            if found < 0:
                break
            i = bisect.bisect_right(self.starts, found) - 1
            if self.free[i]:
                self.searched[piece] = self.starts[i]
                return i
            at = self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text)
        self.searched[piece] = len(self.text)
        return None

    def _beginning(self, piece):
        first = None
        for n in self.lengths:
            if n > len(piece):
                break
            held = self.places.get(piece[:n])
            if held is None:
                continue
            while held[0] < len(held[1]) and not self.free[held[1][held[0]]]:
                held[0] += 1
            if held[0] < len(held[1]) and (first is None or held[1][held[0]] < first):
                first = held[1][held[0]]
        return first

    def take(self, piece: str) -> int | None:
        fits = [i for i in (self._containing(piece), self._beginning(piece)) if i is not None]
        if not fits:
            return None
        self.free[min(fits)] = False
        return min(fits)


@F.pandas_udf(ArrayType(IntegerType()))
def _locate_by_index(pieces: pd.Series, lines: pd.Series) -> pd.Series:
    def locate(said, source):
        index = LineIndex(list(source))
        return [i for i in map(index.take, said) if i is not None]

    return pd.Series([None if p is None else locate(p, s) for p, s in zip(pieces, lines)], index=pieces.index, dtype=object)


def locate_lines(line_answer: Column, code: Column) -> Column:
    """Line ids (0-based) of the quoted code, in answer order.

    Each piece takes the first line that contains it, or that it starts with, among the lines not
    taken before. A null answer locates nothing. Where many lines are quoted from a long text, its
    lines are indexed in Python; all other rows are tried line by line and send nulls there.
    """
    lines = F.transform(split_lines(code), strip)

    def first_free(taken, piece, lines):
        hit = lambda line, i: F.when(
            (line.contains(piece) | piece.startswith(line)) & ~F.array_contains(taken, i), i
        )
        return F.array_min(F.transform(lines, hit))

    def take(taken, piece, lines):
        return bind(
            first_free(taken, piece, lines),
            lambda i: F.when(i.isNull(), taken).otherwise(F.concat(taken, F.array(i))),
        )

    def fold(lines):
        return F.aggregate(
            quoted_code(line_answer),
            F.array().cast(_NO_LINES),
            lambda taken, piece: take(taken, piece, lines).cast(_NO_LINES),
        )

    many = lines_of_code(line_answer).cast("bigint") * lines_of_code(code) > TRIED
    indexed = _locate_by_index(F.when(many, quoted_code(line_answer)), F.when(many, lines))
    located = F.when(many, indexed).otherwise(bind(lines, fold))
    return F.coalesce(located, F.array().cast(_NO_LINES))
