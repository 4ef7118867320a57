"""Line and list functions on function texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from funclab.config import FLAW_LINE_SEPARATOR
from funclab.functions.binding import bind

# The characters Python's str.strip() removes.
PYTHON_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# What str.splitlines() splits at, apart from the newline itself.
OTHER_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def strip(text: Column) -> Column:
    """Trim every kind of blank, not only the space."""
    return F.btrim(text, F.lit(PYTHON_SPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def unify_line_breaks(text: Column) -> Column:
    """Make every line break a ``\\n``. Texts without another break, nearly all, skip the pattern."""
    found = text.contains(OTHER_BREAKS[0])
    for char in OTHER_BREAKS[1:]:
        found = found | text.contains(char)
    return F.when(found, F.regexp_replace(text, f"\r\n|[{OTHER_BREAKS}]", "\n")).otherwise(text)


def drop_final_newline(text: Column) -> Column:
    return F.regexp_replace(text, r"\n\z", "")


def split_lines(text: Column) -> Column:
    """Lines with ``\\n`` as the only break; an empty text is one empty line."""
    return F.split(text, "\n")


def source_lines(text: Column) -> Column:
    """Lines where a final newline opens no line and an empty text has none."""
    empty = F.array().cast("array<string>")
    return bind(text, lambda t: F.when(t == "", empty).otherwise(split_lines(drop_final_newline(t))))


def count_char(text: Column, char: str) -> Column:
    """Occurrences of an ASCII character; sizes in bytes are known without reading the text."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))


def lines_of_code(text: Column) -> Column:
    return count_char(text, "\n") + 1


def count_mod_lines(mod_lines: Column) -> Column:
    """Entries of a comma list, empty ones not counted."""
    return F.size(F.filter(F.split(F.coalesce(mod_lines, F.lit("")), ","), lambda x: x != ""))


def count_listed_lines(mod_lines: Column) -> Column:
    """Entries of a comma list, empty ones counted; a null list has none."""
    return F.when(mod_lines.isNull(), F.lit(0)).otherwise(count_char(mod_lines, ",") + 1)


def norm_lang(language: Column) -> Column:
    low = F.lower(language)
    return F.when(low == "c++", F.lit("cpp")).otherwise(low)


def title_lang(language: Column) -> Column:
    """The form used in file names: first letter upper, the rest lower."""
    return F.concat(F.upper(F.left(language, F.lit(1))), F.lower(F.substring(language, 2, 1 << 30)))


def flaw_lines(code: Column, index_list: Column, strict: bool = False) -> Column:
    """The listed lines (0-based) of ``code``, joined by the separator.

    A blank or null list gives an empty text. An index that is no number, negative or beyond the
    end gives null, or fails the job when ``strict``.
    """
    wanted = F.transform(F.split(index_list, ","), lambda x: strip(x).try_cast("int"))

    def pick(lines):
        return F.transform(wanted, lambda i: F.when(i >= 0, F.get(lines, i)))

    def join(picked):
        broken = F.exists(picked, lambda x: x.isNull())
        if strict:
            complaint = F.concat(F.lit("bad flaw line list: "), index_list)
            return F.when(broken, F.raise_error(complaint).cast("string")).otherwise(
                F.array_join(picked, FLAW_LINE_SEPARATOR)
            )
        return F.when(~broken, F.array_join(picked, FLAW_LINE_SEPARATOR))

    found = bind(split_lines(code), lambda lines: bind(pick(lines), join))
    return F.when(strip(F.coalesce(index_list, F.lit(""))) == "", F.lit("")).otherwise(found)


def parse_line_list(text: Column) -> Column:
    """``"5.0, 7"`` to ``[5, 7]``; null to an empty list."""
    parsed = F.transform(F.split(text, ","), lambda x: strip(x).cast("double").cast("int"))
    return F.coalesce(parsed, F.array().cast("array<int>"))


def parse_ranking(text: Column) -> Column:
    """``"[3, 1]"`` to ``[3, 1]``."""
    return F.from_json(text, "array<int>")


def rounded(number: Column, places: int = 2) -> Column:
    """A double of at least 0, below 2^53 / 10^places, rounded to the nearest decimal as its binary value stands.

    A value exactly between two decimals goes to the even one, so 0.125 gives 0.12, while 2.675,
    whose double lies below its decimal, gives 2.67. The comparison with the middle is made in
    integers: the fraction is laid out in as many binary places as a bigint has room for.
    """
    scale, fives = 10**places, 5**places
    shift = 62 - fives.bit_length()
    whole = F.floor(number)
    fraction = number - whole
    steps = F.floor(fraction * scale)
    laid = fraction * float(2**shift)
    units = laid.cast("bigint")
    above = (units * fives - (steps * 2 + 1) * 2 ** (shift - 1 - places)).cast("double") + (laid - units) * fives
    up = (above > 0) | ((above == 0) & (steps % 2 == 1))
    return (whole * scale + steps + up.cast("int")).cast("double") / scale
