"""Prompt texts as concatenations of literal pieces and columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from funclab.config import DEFAULT_TEMPLATE, NON_VULNERABLE, VULNERABLE, PromptTemplate


def fill(template: str, **columns: Column) -> Column:
    """Put columns into the ``{name}`` places. Column text is never searched for places."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [columns[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p]
    return F.concat(*parts)


def verdict(target: Column) -> Column:
    return F.when(target == 1, F.lit(VULNERABLE)).otherwise(F.lit(NON_VULNERABLE))


def system_text(language: Column, template: PromptTemplate = DEFAULT_TEMPLATE) -> Column:
    return fill(template.system, language=F.lower(language))


def zero_shot_prompt(code: Column, language: Column, template: PromptTemplate = DEFAULT_TEMPLATE) -> Column:
    return fill(template.task, new_source_code=code, language=F.lower(language))


def demonstration(number: Column, code: Column, target: Column, template: PromptTemplate = DEFAULT_TEMPLATE) -> Column:
    text = fill(template.demonstration, i=number.cast("string"), func_before=code, analysis=verdict(target))
    return F.concat(text, F.lit("\n"))


def few_shot_prompt(block: Column, code: Column, language: Column, template: PromptTemplate = DEFAULT_TEMPLATE) -> Column:
    return fill(template.few_shot, code_demonstrations=block, new_source_code=code, language=F.lower(language))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def question_messages(prompt: Column, language: Column, template: PromptTemplate = DEFAULT_TEMPLATE) -> Column:
    """First turn: system text and prompt."""
    return F.array(message("system", system_text(language, template)), message("user", prompt))


def line_question_messages(prompt, answer, language, template: PromptTemplate = DEFAULT_TEMPLATE) -> Column:
    """Second turn: the first one, its answer, and the question for lines."""
    return F.array(
        message("system", system_text(language, template)),
        message("user", prompt),
        message("assistant", answer),
        message("user", F.lit(template.line_question)),
    )


def training_messages(code: Column, target: Column, language: Column, template: PromptTemplate = DEFAULT_TEMPLATE) -> Column:
    """The three messages of a fine-tuning record."""
    return F.array(
        message("system", fill(template.system, language=language)),
        message("user", fill(template.task, new_source_code=code, language=language)),
        message("assistant", fill(template.answer, analysis=verdict(target))),
    )
