"""Explicit schemas; nothing is inferred from files."""

from __future__ import annotations

RAW_CSV = (
    "row_id bigint, language string, repo_url string, code string, label int, "
    "before_change string, added_only string, mod_lines string"
)
CLEAN = "processed_func string, target int, flaw_line_index string, flaw_line string"
CLEAN_WITH_KEYS = "row_id bigint, language string, " + CLEAN

MESSAGES = "array<struct<role:string,content:string>>"
# What a message may say.
MESSAGE_FIELDS = ["role", "content", "name"]

# Column names of the two result file formats.
ANSWER_RESULT_CSV = (
    "processed_func string, target int, flaw_line_index string, flaw_line string, "
    "`GPT Prediction` string, `GPT Func Level` string, `GPT Line Level` string, `Prompt` string"
)
RANKING_RESULT_CSV = (
    "processed_func string, flaw_line_index string, y_preds string, y_trues int, "
    "`LineVul Line Level` string, num_flaw_lines int, num_lines int"
)

# One experiment of one configuration, and one run of one model on it.
EXPERIMENT_KEYS = ["language", "configuration", "experiment"]
RUN_KEYS = EXPERIMENT_KEYS + ["model"]

# The seven frames of an experiment.
VARIANTS = [
    "train",
    "val",
    "test",
    "train_undersampling",
    "val_undersampling",
    "train_oversampling",
    "val_oversampling",
]


def require_columns(df, names):
    """Raise when a column is missing, before anything runs."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
