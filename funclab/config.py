"""Settings of the study: prompt texts, model names, experiment seeds and skip lists."""

from __future__ import annotations

from dataclasses import dataclass

# Prompt texts. Answers are only comparable when these match to the byte.
TASK_TEXT = """{new_source_code}

Please analyze the following {language} source code and determine if it is vulnerable. Answering in the format:
1. Analysis: Vulnerable/Non-Vulnerable"""

SYSTEM_TEXT = "You are an expert {language} programmer"

LINE_QUESTION = """List the flawed lines with the format:
Line number {line}: `{code}`"""

FEW_SHOT_TEXT = (
    """Here are some examples of {language} source code, each followed by an analysis of its vulnerability status.
{code_demonstrations}

Now, consider the following {language} source code:

"""
    + TASK_TEXT
)

DEMONSTRATION_TEXT = """### Example {i}
### Start target code
{func_before}
### End of target code

### Answer
1. Analysis: {analysis}
### End of Answer

### End of Example {i}
"""

ANSWER_TEXT = "1. Analysis: {analysis}"


@dataclass(frozen=True)
class PromptTemplate:
    """The texts a run uses. Placeholders in braces are filled from columns."""

    task: str = TASK_TEXT
    system: str = SYSTEM_TEXT
    line_question: str = LINE_QUESTION
    few_shot: str = FEW_SHOT_TEXT
    demonstration: str = DEMONSTRATION_TEXT
    answer: str = ANSWER_TEXT


DEFAULT_TEMPLATE = PromptTemplate()

# Answers and markers.
VULNERABLE = "Vulnerable"
NON_VULNERABLE = "Non-Vulnerable"
ANALYSIS_MARKER = "analysis:"
FAILED_CALL_TEXT = "Limit token exceeded"
FLAW_LINE_SEPARATOR = "/~/"

# Balance modes and their file name suffixes.
NO_BALANCING, UNDERSAMPLING, OVERSAMPLING = 0, 1, 2
SUFFIXES = {NO_BALANCING: "_no_balancing", UNDERSAMPLING: "_undersampling", OVERSAMPLING: "_oversampling"}

# The experiments. The seed is the id, but 42 for id 3.
EXPERIMENTS = [(0, 0), (1, 1), (2, 2), (3, 42), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (9, 9)]
VAL_TEST_RATIO = 0.4
RESAMPLE_SEED = 42

# Model (result file) names.
ANSWER_MODELS = ["gpt_fine_tune_undersampling", "gpt_fine_tune_oversampling", "gpt_few_shot"]
RANKING_MODELS = ["linevul_undersampling", "linevul_oversampling", "linevul_no_balancing"]
MODELS = ANSWER_MODELS + RANKING_MODELS
RANKING_FAMILY = "linevul"
OVERLAP_MODELS = [
    "gpt_fine_tune_oversampling",
    "gpt_fine_tune_undersampling",
    "gpt_few_shot",
    "linevul_oversampling",
    "linevul_undersampling",
]

# Experiments set aside because some model had an F1 score of 0.
SKIPPED_EXPERIMENTS = {
    ("kotlin", "data_with_comments_single_before_change"): [3, 4, 6, 7, 8, 9],
    ("kotlin", "data_without_comments_single_before_change"): [0, 3, 7, 6, 4, 8],
    ("swift", "data_with_comments_single_before_change"): [0, 1, 7, 6, 8],
    ("swift", "data_without_comments_single_before_change"): [0, 1, 4, 7, 8],
    ("rust", "data_with_comments_single_before_change"): [0, 3, 6, 8],
    ("rust", "data_without_comments_single_before_change"): [0, 6, 8],
}

# Limits of the fine-tuning service.
MAX_RECORD_TOKENS = 4096
MIN_TARGET_EXAMPLES = 100
MAX_TARGET_EXAMPLES = 25000
TARGET_EPOCHS = 3
MIN_EPOCHS = 1
MAX_EPOCHS = 25
