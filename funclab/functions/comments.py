"""Comment removal and comment lines, by lexical tokens.

A code text is cut into tokens (string and character literals, comments, runs of anything else)
by one pattern per language; then comment tokens are blanked. Rules for the patterns:

* Java's matcher recurses once per turn of a repeated group unless the group is possessive, so
  every repeated group here is possessive (``*+``) and long literals cannot overflow the stack.
* Rust, Swift and Kotlin nest block comments, and strings of Swift and Kotlin hold code, which no
  pattern can follow to any depth. Rows where a block comment may open inside another, or several
  stay open, and rows with comment signs and code in a string are cut by a small Python helper; all
  other rows send the helper a null, so the text is read once and stays in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from funclab.functions import lexer
from funclab.functions.batches import slices
from funclab.functions.text import (
    drop_final_newline,
    is_blank,
    norm_lang,
    source_lines,
    split_lines,
    unify_line_breaks,
)

_STRING = r'"(?:[^"\\]|\\(?s:.))*+"'
_INNER = r'"(?:[^"\\\n]|\\[^\n])*+"'


def _hole(opener, left, right, levels=3):
    """Code put into a string, on one line: plain code, strings, and brackets to a few levels."""
    plain = rf'[^"{left}{right}\n]|{_INNER}'
    body = rf"(?:{plain})*+"
    for _ in range(levels):
        body = rf"(?:{plain}|\{left}{body}\{right})*+"
    return rf"{opener}{body}\{right}"


# These follow holes where the stack of the lexer finds one that stays open; a hole that is not closed
# on its line is then read as ordinary text of the string.
_STRING_KOTLIN = r'"(?:[^"\\$]|\\(?s:.)|' + _hole(r"\$\{", "{", "}") + r'|\$)*+"'
_STRING_SWIFT = r'"(?:[^"\\]|' + _hole(r"\\\(", "(", ")") + r'|\\(?s:.))*+"'
_TRIPLE = r'"""(?:[^"\\]|\\(?s:.)|"(?!""))*+"""'
_RAW_TRIPLE = r'"""(?s:.*?)""""*+'  # quotes before the last three are its own
_CHAR = r"'(?:[^'\\\n]|\\[^\n][^'\n]*+)'"
_RAW_RUST = r'(?:(?<![A-Za-z0-9_])|(?<=(?<![A-Za-z0-9_])[bc]))r(#*+)"(?s:.*?)"\1'
_RAW_SWIFT = r'(#++)(?:"(?s:.*?)"|/(?s:.*?)/)\1'  # strings and regular expressions
_RAW_CPP = r'R"([^()\\ \n]{0,16})\((?s:.*?)\)\1"'
_LINE = r"//[^\n]*+"
_LINE_C = r"//(?:[^\\\n]|\\(?s:.))*+"
_BLOCK = r"/\*(?s:.*?)\*/"
_INCLUDE = r'#[ \t]*+include[ \t]*+(?:<[^>\n]*>|"[^"\n]*"|[A-Za-z_][A-Za-z0-9_]*)'
_USING = r"(?<![A-Za-z0-9_])using\s++(?:(?:namespace|enum)\s++)?[A-Za-z0-9_:<>, \t]++;"
_ANY = r"(?s:.)"

# Per language: literals, comments other than blocks, plain runs that start none of these.
_TOKENS = {
    "rust": ([_RAW_RUST, _STRING, _CHAR], [_LINE], r'(?:[^"\'/r]++|r(?!#*+"))++'),
    "kotlin": ([_RAW_TRIPLE, _STRING_KOTLIN, _CHAR], [_LINE], r"[^\"'/]++"),
    "swift": ([_RAW_SWIFT, _TRIPLE, _STRING_SWIFT], [_LINE], r'[^"/#]++'),
    "c": ([_STRING, _CHAR], [_LINE_C, _INCLUDE], r"[^\"'/#]++"),
    "cpp": (
        [_RAW_CPP, _STRING, _CHAR],
        [_LINE_C, _INCLUDE, _USING],
        r'(?:[^"\'/#Ru]++|R(?!")|u(?!sing\s))++',
    ),
}
LANGUAGES = list(_TOKENS)
_NESTING = ["rust", "kotlin", "swift"]
# Kotlin keeps its block comments unless asked: only line comments are removed there by default.
KEEP_BLOCKS = ("kotlin",)

_MARK = "\x01"


def token_pattern(language: str, blocks: bool = True) -> str:
    literals, comments, plain = _TOKENS[language]
    block = [_BLOCK] if blocks else []
    return "|".join([*literals, *comments, *block, plain, _ANY])


def nested_tokens(code: str, language: str) -> list[str]:
    """Tokens of one text, following block comments to any depth where the language nests them.

    Where blocks end is noted once, so many open blocks cost no more than one.
    """
    pattern = re.compile(token_pattern(language, blocks=False))
    tokens, at, ends = [], 0, {}
    while at < len(code):
        if code.startswith("/*", at):
            end = lexer.block_end(code, at, language in _NESTING, ends) or at + 1
        else:
            end = pattern.match(code, at).end()
        tokens.append(code[at:end])
        at = end
    return tokens


def deep_tokens(code: str, language: str) -> list[str]:
    """Tokens of one text with nested blocks, or with code inside its strings, to any depth.

    From a string on that stays open, or holds a hole that does, the patterns cut the rest.
    """
    if language not in lexer.LANGUAGES:
        return nested_tokens(code, language)
    spans, stop = lexer.comment_spans(code, language)
    return lexer.cut_at(code[:stop], spans) + nested_tokens(code[stop:], language)


#: Bytes of text of which a Python worker holds the tokens at a time, unless one row has more.
SLICE_BYTES = 1 << 20


@F.arrow_udf(ArrayType(StringType()))
def _deep_tokens_udf(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for code, language in slices(batches, SLICE_BYTES):
        cut = [None if c is None else deep_tokens(c, lang) for c, lang in zip(code.to_pylist(), language.to_pylist())]
        yield pa.array(cut, pa.list_(pa.string()))


def _may_nest(code: Column, language: Column) -> Column:
    """True where some ``/*`` is followed by another before any ``*/``."""
    opened = F.octet_length(code) - F.octet_length(F.replace(code, F.lit("/*"), F.lit("")))
    pieces = F.split(code, r"/\*")
    inner = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))
    return language.isin(_NESTING) & (opened >= 4) & F.exists(inner, lambda piece: ~piece.contains("*/"))


def _holds_code(code: Column, language: Column) -> Column:
    """True where a string may hold code, and the text a comment."""
    hole = ((language == "kotlin") & code.contains("${")) | ((language == "swift") & code.rlike(r"\\#*\("))
    return hole & (code.contains("//") | code.contains("/*"))


def _stays_open(code: Column) -> Column:
    """True where several ``/*`` follow the last ``*/``: a pattern would look for the end of each."""
    rest = F.substring_index(code, "*/", -1)
    return F.octet_length(rest) - F.octet_length(F.replace(rest, F.lit("/*"), F.lit(""))) >= 4


def _has_comment_sign(code: Column, language: Column) -> Column:
    sign = code.contains("//") | code.contains("/*")
    c_sign = language.isin("c", "cpp") & (code.contains("include") | code.contains("using"))
    return sign | c_sign


def flat_tokens(code: Column, language: Column) -> Column:
    """Tokens for texts without nested block comments; a text without any comment is one token."""
    cut = F.raise_error(F.concat(F.lit("no comment rules for language "), language)).cast("array<string>")
    for name in reversed(LANGUAGES):
        cut = F.when(language == name, F.regexp_extract_all(code, F.lit(token_pattern(name)), F.lit(0))).otherwise(cut)
    return F.when(_has_comment_sign(code, language), cut).otherwise(F.array(code))


def _is_comment(token: Column, language: Column, strip_block: bool) -> Column:
    block = token.startswith("/*") & (F.length(token) > 1)
    if not strip_block:
        block = block & ~language.isin(*KEEP_BLOCKS)
    directive = language.isin("c", "cpp") & token.rlike(r"\A#[ \t]*include")
    using = (language == "cpp") & token.rlike(r"\Ausing\s")
    return token.startswith("//") | block | directive | using


def with_tokens(df: DataFrame, code: str, language: str) -> DataFrame:
    """Add ``_lang`` and ``_tokens``; null texts keep null tokens."""
    keyed = df.withColumn("_lang", norm_lang(F.col(language))).withColumn("_code", unify_line_breaks(F.col(code)))
    text, lang = F.col("_code"), F.col("_lang")
    deep = _may_nest(text, lang) | _holds_code(text, lang) | (lang.isin(LANGUAGES) & _stays_open(text))
    rare = _deep_tokens_udf(F.when(deep, text), lang)
    return (
        keyed.withColumn("_rare", rare)
        .withColumn("_tokens", F.coalesce(F.col("_rare"), flat_tokens(text, lang)))
        .drop("_rare")
    )


def _blanked(strip_block):
    """The text with comments cut out; their line breaks stay, so line numbers hold."""

    def blank(token):
        return F.when(
            _is_comment(token, F.col("_lang"), strip_block), F.regexp_replace(token, r"[^\n]+", "")
        ).otherwise(token)

    return drop_final_newline(F.array_join(F.transform("_tokens", blank), ""))


def _noisy_ids(strip_block):
    """0-based lines that hold some of a comment, or nothing."""

    def mark(token):
        marked = F.concat(F.lit(_MARK), F.replace(F.regexp_replace(token, r"[^\n]+", ""), F.lit("\n"), F.lit("\n" + _MARK)))
        plain = F.replace(token, F.lit(_MARK), F.lit("x"))
        return F.when(_is_comment(token, F.col("_lang"), strip_block), marked).otherwise(plain)

    lines = source_lines(F.array_join(F.transform("_tokens", mark), ""))
    ids = F.transform(lines, lambda line, i: F.when(line.contains(_MARK) | is_blank(line), i))
    return F.array_compact(ids)


def strip_comments(df: DataFrame, code="processed_func", language="language", out=None, strip_block=False) -> DataFrame:
    """Replace ``code`` (or add ``out``) by the text without comments, line for line."""
    return (
        with_tokens(df, code, language)
        .withColumn(out or code, _blanked(strip_block))
        .drop("_lang", "_code", "_tokens")
    )


def noisy_lines(df: DataFrame, code="processed_func", language="language", out="noisy", strip_block=False) -> DataFrame:
    """Add the sorted ids of lines that hold a comment or are blank."""
    return with_tokens(df, code, language).withColumn(out, _noisy_ids(strip_block)).drop("_lang", "_code", "_tokens")


def noisy_annotate(df: DataFrame, code="processed_func", language="language", out="annotated", strip_block=False) -> DataFrame:
    """Add the text with ``# `` before each noisy line."""
    marked = with_tokens(df, code, language).withColumn("_noisy", _noisy_ids(strip_block))
    lines = F.transform(
        source_lines(F.col("_code")),
        lambda line, i: F.when(F.array_contains("_noisy", i), F.concat(F.lit("# "), line)).otherwise(line),
    )
    return marked.withColumn(out, F.array_join(lines, "\n")).drop("_lang", "_code", "_tokens", "_noisy")


def blank_lines(df: DataFrame, code="processed_func", language="language", strip_block=False) -> DataFrame:
    """Add ``clean_code`` and ``blank``: the ids of lines that are blank once comments are gone."""
    clean = with_tokens(df, code, language).withColumn("clean_code", _blanked(strip_block))
    ids = F.transform(source_lines(F.col("clean_code")), lambda line, i: F.when(is_blank(line), i))
    return clean.withColumn("blank", F.array_compact(ids)).drop("_lang", "_code", "_tokens")
