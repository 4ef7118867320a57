"""Chat fine-tuning records: making, checking and pricing them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funclab.config import (
    DEFAULT_TEMPLATE,
    MAX_EPOCHS,
    MAX_RECORD_TOKENS,
    MAX_TARGET_EXAMPLES,
    MIN_EPOCHS,
    MIN_TARGET_EXAMPLES,
    TARGET_EPOCHS,
)
from funclab.functions.prompts import training_messages
from funclab.functions.tokens import TOKENS_PER_MESSAGE, TOKENS_PER_NAME, TOKENS_PER_REPLY, count_pieces
from funclab.plans.settle import lookup_join, settle
from funclab.schemas import MESSAGE_FIELDS

# Error kinds of the format check, roles and message keys.
ERROR_KINDS = [
    "data_type",
    "missing_messages_list",
    "message_missing_key",
    "message_unrecognized_key",
    "unrecognized_role",
    "missing_content",
    "example_missing_assistant_message",
]
ROLES = ["system", "user", "assistant"]
MESSAGE_KEYS = MESSAGE_FIELDS


def fine_tuning_chats(rows: DataFrame, code="processed_func", target="target", language="language", template=DEFAULT_TEMPLATE) -> DataFrame:
    """Add ``messages``: system text, question, and the right answer."""
    return rows.withColumn("messages", training_messages(F.col(code), F.col(target), F.col(language), template))


def chat_format_errors(lines: DataFrame, line="value", by=()) -> DataFrame:
    """Errors of each kind in JSON lines, one row per kind, zeros included.

    A line that is no JSON counts as ``data_type``, like a value that is no object.
    """
    record = F.try_parse_json(F.col(line))
    is_object = F.coalesce(F.schema_of_variant(record).startswith("OBJECT"), F.lit(False))
    listed = F.coalesce(F.try_variant_get(record, "$.messages", "array<variant>"), F.array().cast("array<variant>"))
    messages = F.when(is_object, listed)
    parsed = lines.select(*by, is_object.alias("_object"), messages.alias("_messages"))

    def text(message, path):
        found = F.try_variant_get(message, path, "variant")
        return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(message, path, "string"))

    def keys(message):
        fields = F.map_keys(F.try_variant_get(message, "$", "map<string,variant>"))
        return F.coalesce(fields, F.array().cast("array<string>"))

    def facts(message):
        role, content = text(message, "$.role"), text(message, "$.content")
        return F.struct(
            keys(message).alias("keys"),
            F.coalesce(role, F.lit("")).alias("role"),
            (F.coalesce(content, F.lit("")) == "").alias("no_content"),
        )

    checked = parsed.withColumn("_facts", F.transform("_messages", facts))

    def count(test):
        return F.coalesce(F.size(F.filter("_facts", test)), F.lit(0))

    has_messages = F.col("_object") & (F.size("_messages") > 0)
    no_assistant = has_messages & ~F.exists("_facts", lambda m: m["role"] == "assistant")
    allowed = F.array(*[F.lit(k) for k in MESSAGE_KEYS])
    per_line = {
        "data_type": (~F.col("_object")).cast("int"),
        "missing_messages_list": (F.col("_object") & (F.size("_messages") == 0)).cast("int"),
        "message_missing_key": count(
            lambda m: ~F.array_contains(m["keys"], "role") | ~F.array_contains(m["keys"], "content")
        ),
        "message_unrecognized_key": count(lambda m: F.size(F.array_except(m["keys"], allowed)) > 0),
        "unrecognized_role": count(lambda m: ~m["role"].isin(*ROLES)),
        "missing_content": count(lambda m: m["no_content"]),
        "example_missing_assistant_message": no_assistant.cast("int"),
    }
    sums = checked.groupBy(*by).agg(*[F.coalesce(F.sum(per_line[k]), F.lit(0)).alias(k) for k in ERROR_KINDS])
    return sums.unpivot(list(by), ERROR_KINDS, "error", "n_errors")


def chat_facts(chats: DataFrame, messages="messages", counter=count_pieces, keep=("row_id",)) -> DataFrame:
    """Per record: message and token counts, and which roles occur. No shuffle."""
    fields = chats.schema[messages].dataType.elementType.fieldNames()
    values = [F.col(messages)[name] for name in fields]
    counted = chats.select(
        *keep,
        F.col(messages)["role"].alias("_roles"),
        F.size(messages).alias("n_messages"),
        *[counter(v).alias(f"_tokens_{name}") for name, v in zip(fields, values)],
        *([F.col(messages)["name"].alias("_names")] if "name" in fields else []),
    )
    total = F.col("n_messages") * TOKENS_PER_MESSAGE + TOKENS_PER_REPLY
    for name in fields:
        total = total + F.aggregate(f"_tokens_{name}", F.lit(0), lambda acc, n: acc + F.coalesce(n, F.lit(0)))
    if "name" in fields:
        total = total + F.size(F.array_compact("_names")) * TOKENS_PER_NAME
    answered = F.zip_with("_roles", "_tokens_content", lambda role, n: F.when(role == "assistant", n).otherwise(0))
    return counted.select(
        *keep,
        "n_messages",
        total.cast("bigint").alias("n_tokens"),
        F.aggregate(answered, F.lit(0), lambda acc, n: acc + n).cast("bigint").alias("n_assistant_tokens"),
        *[F.array_contains("_roles", role).alias(f"has_{role}") for role in ROLES],
    )


def turn_facts(turns: DataFrame, chat="conv_id", role="role", content="content", counter=count_pieces) -> DataFrame:
    """The same facts from one row per message.

    Sums are merged before the shuffle and no chat is gathered into a list, so a chat of any
    length is safe.
    """
    counted = turns.select(
        F.col(chat), F.col(role).alias("_role"), counter(F.array(F.col(role), F.col(content))).alias("_tokens")
    ).select(chat, "_role", F.get("_tokens", F.lit(0)).alias("_r"), F.get("_tokens", F.lit(1)).alias("_c"))
    assistant = F.when(F.col("_role") == "assistant", F.col("_c")).otherwise(0)
    return counted.groupBy(chat).agg(
        F.count(F.lit(1)).cast("int").alias("n_messages"),
        (F.sum(F.col("_r") + F.col("_c") + TOKENS_PER_MESSAGE) + TOKENS_PER_REPLY).alias("n_tokens"),
        F.sum(assistant).alias("n_assistant_tokens"),
        *[F.bool_or(F.col("_role") == name).alias(f"has_{name}") for name in ROLES],
    )


def chat_missing_roles(facts: DataFrame, by=()) -> DataFrame:
    return facts.groupBy(*by).agg(
        F.count_if(~F.col("has_system")).alias("n_missing_system"),
        F.count_if(~F.col("has_user")).alias("n_missing_user"),
    )


MEASURES = {
    "num_messages_per_example": "n_messages",
    "num_total_tokens_per_example": "n_tokens",
    "num_assistant_tokens_per_example": "n_assistant_tokens",
}


def chat_length_stats(facts: DataFrame, by=(), approximate: bool = False) -> DataFrame:
    """Spread of messages and tokens per record, one row per measure.

    Exact quantiles keep one counter per distinct length, which is bounded by the longest record,
    not by the number of records.
    """
    quantile = F.percentile_approx if approximate else F.percentile
    lengths = facts.select(*by, *[F.col(c).cast("bigint").alias(name) for name, c in MEASURES.items()])
    long = lengths.unpivot(list(by), list(MEASURES), "measure", "value")
    at = quantile("value", [0.1, 0.5, 0.9])
    return (
        long.groupBy(*by, "measure")
        .agg(
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.avg("value").alias("mean"),
            at.alias("_q"),
        )
        .select(
            *by,
            "measure",
            "min",
            "max",
            "mean",
            F.get("_q", F.lit(1)).cast("double").alias("median"),
            F.get("_q", F.lit(0)).cast("double").alias("p10"),
            F.get("_q", F.lit(2)).cast("double").alias("p90"),
        )
    )


def fine_tune_cost(facts: DataFrame, by=(), max_tokens=MAX_RECORD_TOKENS) -> DataFrame:
    """Records over the limit, default epochs, and billed tokens."""
    sums = facts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.count_if(F.col("n_tokens") > max_tokens).alias("n_too_long"),
        F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(max_tokens))), F.lit(0)).alias("n_billing_tokens"),
    )
    n = F.col("n_examples")
    planned = n * TARGET_EPOCHS
    few = F.least(F.lit(MAX_EPOCHS), F.floor(F.try_divide(F.lit(MIN_TARGET_EXAMPLES), n)))
    many = F.greatest(F.lit(MIN_EPOCHS), F.floor(F.try_divide(F.lit(MAX_TARGET_EXAMPLES), n)))
    epochs = F.when(planned < MIN_TARGET_EXAMPLES, few).when(planned > MAX_TARGET_EXAMPLES, many).otherwise(TARGET_EPOCHS)
    return sums.withColumn("n_epochs", epochs.cast("int")).withColumn(
        "n_charged_tokens", F.col("n_epochs") * F.col("n_billing_tokens")
    )


def chat_overview(chats: DataFrame, by=(), order="row_id", messages="messages") -> DataFrame:
    """Number of records, and the first one in row order.

    The first row is found by its key alone; only then its messages are fetched.
    """
    keys = [*by, order]
    found = settle(chats.groupBy(*by).agg(F.count(F.lit(1)).alias("n_examples"), F.min(order).alias(order)))
    return lookup_join(chats.select(*keys, F.col(messages).alias("first_messages")), found, keys, spread=order).select(
        *by, "n_examples", "first_messages"
    )
