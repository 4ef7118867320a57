"""One query per operator: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from funclab import config
from funclab.functions import comments, responses, text, tokens
from funclab.operators import (
    fewshot,
    finetune,
    inference,
    linelevel,
    metrics,
    preprocess,
    results,
    sampling,
    scores,
    stats,
)
from funclab.plans import runs
from funclab.plans.settle import scratch_path, settle_table
from funclab.schemas import EXPERIMENT_KEYS, MESSAGES, RAW_CSV, RUN_KEYS
from funclab.sources import readers, writers
from funclab.streaming.files import process_new_files
from suite import views

GROUP = ["language", "configuration"]
RUN = RUN_KEYS
EXP = EXPERIMENT_KEYS

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _rounded(df, *names):
    """Means of doubles depend on the order of adding in their last digits."""
    return df.withColumns({n: F.round(n, 9) for n in names})


# --- scans and sinks -------------------------------------------------------------------------


@query
def scan_raw_parquet(spark, sf):
    names = {"row_id": "doc_id", "repo_url": "source", "code": "text"}
    raw = readers.read_raw_parquet(spark, f"{sf}/documents.parquet", names)
    return raw.select("row_id", "repo_url", text.lines_of_code(F.col("code")).alias("n_lines"))


def text_sha():
    return F.sha2(F.coalesce("processed_func", F.lit("")), 256).alias("text_sha")


@query
def scan_raw_csv(spark, sf):
    path = scratch_path(spark, "raw-csv")
    writers.write_csv(views.v_raw(spark, sf), path)
    return readers.read_raw_csv(spark, path, RAW_CSV)


@query
def write_clean(spark, sf):
    path = scratch_path(spark, "clean-csv")
    clean = views.v_clean(spark, sf).drop("configuration")
    writers.write_clean(clean, path)
    schema = "row_id bigint, language string, processed_func string, target int, flaw_line_index string, flaw_line string"
    # An empty text and a null are the same thing in a CSV file.
    return readers.read_clean_csv(spark, path, schema).fillna("", ["flaw_line"])


def _experiments(spark, sf, runs=config.EXPERIMENTS, run_by_run=False):
    clean = views.v_clean(spark, sf)
    return sampling.experiments(clean, sampling.experiment_list(spark, runs), GROUP, require_both=False, run_by_run=run_by_run)


@query
def write_experiments(spark, sf):
    path = scratch_path(spark, "experiments")
    writers.write_experiments(_experiments(spark, sf, run_by_run=True), path, gather=False)
    back = readers.read_experiments(spark, path)
    return back.select(*EXP, "variant", "row_id", "target", text_sha())


@query
def scan_experiments(spark, sf):
    path = scratch_path(spark, "experiments")
    writers.write_experiments(_experiments(spark, sf, run_by_run=True), path, gather=False)
    back = readers.read_experiments(spark, path)
    return stats.split_distribution(back)


@query
def write_chat_jsonl(spark, sf):
    path = scratch_path(spark, "chats")
    writers.write_chat_jsonl(views.v_chats(spark, sf), path)
    back = spark.read.schema(f"messages {MESSAGES}").json(path)
    return back.select(*[F.col("messages")[i]["content"].alias(n) for i, n in enumerate(["system", "user", "assistant"])])


@query
def scan_chat_jsonl(spark, sf):
    path = scratch_path(spark, "chat-lines")
    views.v_chat_lines(spark, sf).select("value").write.text(path)
    lines = readers.read_chat_lines(spark, path)
    return lines.select(
        F.sha2("value", 256).alias("line_sha"),
        F.json_array_length(F.get_json_object("value", "$.messages")).cast("int").alias("n_messages"),
        F.get_json_object("value", "$.messages[0].role").alias("first_role"),
    )


def _named_records(spark, sf):
    path = scratch_path(spark, "named-chats")
    views.v_named_lines(spark, sf).select("value").write.text(path)
    return readers.read_chat_records(spark, path)


@query
def scan_chat_records(spark, sf):
    """Every field of every message of every record in a file, and every line that is none."""
    said = F.transform("messages", lambda m: F.concat_ws("|", m["role"], F.sha2(m["content"], 256), F.coalesce(m["name"], F.lit("-"))))
    return _named_records(spark, sf).select(F.array_join(said, ";").alias("messages"), F.sha2("bad_line", 256).alias("bad_line_sha"))


@query
def chat_report(spark, sf):
    """From a file of chats to the facts that decide on tuning: messages, tokens, names, roles."""
    records = _named_records(spark, sf).where("bad_line is null")
    asked = F.filter("messages", lambda m: m["role"] == "user")[0]
    records = records.withColumns({"asked_sha": F.sha2(asked["content"], 256), "asked_by": asked["name"]})
    return finetune.chat_facts(records, keep=("asked_sha", "asked_by"))


@query
def scan_experiment_tree(spark, sf):
    """A tree of CSV files, some with flaw lines and some without, read back as one frame."""
    path = scratch_path(spark, "experiment-tree")
    made = _experiments(spark, sf, [(3, 42)])
    keys = [*EXP, "variant"]
    writers.write_csv(made.select(*keys, "processed_func", "target", "flaw_line_index", "flaw_line"), path, keys)
    plain = made.withColumn("configuration", F.lit("data_original")).select(*keys, "processed_func", "target")
    writers.write_csv(plain, path, keys, mode="append")
    back = readers.read_experiment_tree(spark, path).fillna("", ["flaw_line"])
    return back.select(*keys, "target", "flaw_line_index", F.sha2("flaw_line", 256).alias("flaw_line_sha"), text_sha())


@query
def scan_result_tree(spark, sf):
    """Both kinds of result files in one tree, read back on one schema."""
    path = scratch_path(spark, "result-tree")
    done = views.v_results(spark, sf, run_by_run=True)
    writers.write_csv(_answer_file(done), path, RUN, gather=False, compression="zstd")
    writers.write_csv(_ranking_file(done), path, RUN, mode="append", gather=False, compression="zstd")
    both = results.normalise_results(*readers.read_result_tree(spark, path))
    return _flat_results(both.fillna("", ["func_response", "line_response"])).select(*RUN, *_RESULT_COLUMNS[:4], "num_lines", "num_flaw_lines", "line_ranking",
        F.sha2("func_response", 256).alias("func_sha"), F.sha2("line_response", 256).alias("line_sha"))


@query
def write_results(spark, sf):
    path = scratch_path(spark, "results")
    done = views.v_results(spark, sf, run_by_run=True).withColumn("line_ranking", F.to_json("line_ranking"))
    writers.write_results(done.withColumn("prompt", F.lit("p")), path, save_prompt=False, gather=False)
    schema = (
        "row_id bigint, processed_func string, target int, prediction int, flaw_line_index string, func_response string, "
        "line_response string, line_ranking string, num_lines int, num_flaw_lines int, "
        "language string, configuration string, experiment int, model string"
    )
    back = spark.read.options(**{**readers.CSV_OPTIONS, "enforceSchema": "true"}).schema(schema).csv(path)
    return back.select(*RUN, "row_id", "target", "prediction", text_sha(), "line_ranking")


def _answer_file(done):
    return done.where(~F.col("model").startswith("linevul")).select(
        *RUN,
        "row_id",
        "processed_func",
        "target",
        "flaw_line_index",
        F.col("prediction").cast("string").alias("GPT Prediction"),
        F.col("func_response").alias("GPT Func Level"),
        F.col("line_response").alias("GPT Line Level"),
    )


def _ranking_file(done):
    return done.where(F.col("model").startswith("linevul")).select(
        *RUN,
        "row_id",
        "processed_func",
        "flaw_line_index",
        F.when(F.col("prediction") == 1, "True").otherwise("False").alias("y_preds"),
        F.col("target").alias("y_trues"),
        F.to_json("line_ranking").alias("LineVul Line Level"),
        "num_flaw_lines",
        "num_lines",
    )


_RESULT_COLUMNS = ["row_id", "target", "prediction", "flaw_line_index", "func_response", "line_response", "num_lines", "num_flaw_lines"]


def _flat_results(df):
    ranking = F.array_join(F.col("line_ranking").cast("array<string>"), ",").alias("line_ranking")
    return df.select(*RUN, *_RESULT_COLUMNS, ranking)


@query
def normalise_results(spark, sf):
    done = views.v_results(spark, sf)
    return _flat_results(results.normalise_results(_answer_file(done), _ranking_file(done)))


@query
def scan_results(spark, sf):
    """Both result file formats written as CSV and read back on one schema."""
    answers, rankings = scratch_path(spark, "answers"), scratch_path(spark, "rankings")
    done = views.v_results(spark, sf, run_by_run=True)
    writers.write_csv(_answer_file(done), answers, RUN, gather=False, compression="zstd")
    writers.write_csv(_ranking_file(done), rankings, RUN, gather=False, compression="zstd")
    options = {**readers.CSV_OPTIONS, "enforceSchema": "true"}
    keys = ", language string, configuration string, experiment int, model string"
    answer_schema = (
        "row_id bigint, processed_func string, target int, flaw_line_index string, "
        "`GPT Prediction` string, `GPT Func Level` string, `GPT Line Level` string" + keys
    )
    ranking_schema = (
        "row_id bigint, processed_func string, flaw_line_index string, y_preds string, y_trues int, "
        "`LineVul Line Level` string, num_flaw_lines int, num_lines int" + keys
    )
    both = results.normalise_results(
        spark.read.options(**options).schema(answer_schema).csv(answers),
        spark.read.options(**options).schema(ranking_schema).csv(rankings),
    )
    return metrics.func_metrics(both).select(*RUN, "tp", "fp", "fn", "tn")


@query
def run_name(spark, sf):
    runs = views.v_results(spark, sf).select("model", "experiment").groupBy("model", "experiment").agg(F.count(F.lit(1)).alias("n"))
    shots = F.when(F.col("model") == "gpt_few_shot", F.col("experiment") + 1)
    tuned = F.when(F.col("model").contains("fine_tune"), F.lit("ft:1")).otherwise(F.lit("gpt-3.5-turbo"))
    return runs.select(
        "model",
        "experiment",
        results.run_name(tuned, shots).alias("run_name"),
        results.suffix_name(F.col("experiment") % 3).alias("suffix"),
    )


# --- preprocessing and statistics ------------------------------------------------------------


@query
def preprocess_(spark, sf):
    return preprocess.preprocess(views.v_raw(spark, sf))


QUERIES["preprocess"] = QUERIES.pop("preprocess_")


@query
def class_filter(spark, sf):
    return preprocess.of_class(views.v_clean(spark, sf), 1).select("row_id", "language", "flaw_line_index")


@query
def class_distribution(spark, sf):
    return stats.class_distribution(views.v_clean(spark, sf), ["language"])


@query
def split_distribution(spark, sf):
    return stats.split_distribution(_experiments(spark, sf))


@query
def dataset_stats(spark, sf):
    return stats.dataset_stats(views.v_raw(spark, sf))


@query
def merged_sketches(spark, sf):
    """Sketches for each language, stored, read and merged; beside what they should tell, within the bounds of their errors."""
    raw = views.v_raw(spark, sf)
    stored = settle_table(stats.dataset_sketches(raw), "sketches")
    told = stats.sketched_stats(stats.merged_sketches(stored)).first()
    loc = text.lines_of_code(F.col("code"))
    share = lambda test: F.avg(test.cast("double"))
    near = {"projects_near": F.abs(F.lit(told["n_projects"]) - F.count_distinct("repo_url")) <= F.count_distinct("repo_url") * 0.05}
    for i, (q, cut) in enumerate(zip((0.1, 0.5, 0.9), told["length_quantiles"])):
        near[f"quantile_{i}_near"] = (share(loc < cut) <= q + 0.02) & (share(loc <= cut) >= q - 0.02)
    sums = [F.lit(told[name]).cast("bigint").alias(name) for name in ("n_records", "n_lines", "n_vul_lines")]
    return raw.agg(*[test.alias(name) for name, test in near.items()]).select(*sums, *near)


@query
def loc_summary(spark, sf):
    return _rounded(stats.loc_summary(views.v_raw(spark, sf)), "mean_loc")


@query
def norm_lang(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", F.upper("lang").alias("lang"))
    named = F.when(F.col("lang") == "ES", F.lit("C++")).otherwise(F.col("lang"))
    return docs.select(
        "doc_id",
        text.norm_lang(named).alias("language"),
        readers.raw_file_name(F.col("lang")).alias("file_name"),
    )


@query
def flaw_lines(spark, sf):
    raw = views.v_raw(spark, sf)
    return raw.select("row_id", text.flaw_lines(F.col("code"), F.col("mod_lines")).alias("flaw_line"))


@query
def parse_line_list(spark, sf):
    raw = views.v_raw(spark, sf)
    listed = text.parse_line_list(F.replace("mod_lines", F.lit(","), F.lit(".0 , ")))
    return raw.select("row_id", F.array_join(listed.cast("array<string>"), "|").alias("ids"), F.size(listed).alias("n"))


@query
def parse_ranking(spark, sf):
    ranked = _ranking_file(views.v_results(spark, sf)).select(*RUN, "row_id", text.parse_ranking(F.col("LineVul Line Level")).alias("r"))
    return ranked.select(*RUN, "row_id", F.size("r").alias("n"), F.get("r", F.lit(0)).alias("first_line"))


# --- comments --------------------------------------------------------------------------------


@query
def strip_comments(spark, sf):
    return comments.strip_comments(views.v_code(spark, sf))


@query
def noisy_lines(spark, sf):
    noisy = comments.noisy_lines(views.v_code(spark, sf))
    return noisy.select("row_id", F.array_join(F.col("noisy").cast("array<string>"), ",").alias("noisy"))


@query
def noisy_annotate(spark, sf):
    return comments.noisy_annotate(views.v_code(spark, sf)).select("row_id", "annotated")


@query
def blank_lines(spark, sf):
    blank = comments.blank_lines(views.v_code(spark, sf))
    return blank.select("row_id", "clean_code", F.array_join(F.col("blank").cast("array<string>"), ",").alias("blank"))


@query
def strip_comments_nested(spark, sf):
    return comments.strip_comments(views.v_nested(spark, sf))


@query
def noisy_lines_nested(spark, sf):
    noisy = comments.noisy_lines(views.v_nested(spark, sf))
    return noisy.select("row_id", F.array_join(F.col("noisy").cast("array<string>"), ",").alias("noisy"))


@query
def noisy_annotate_nested(spark, sf):
    return comments.noisy_annotate(views.v_nested(spark, sf)).select("row_id", "annotated")


@query
def blank_lines_nested(spark, sf):
    blank = comments.blank_lines(views.v_nested(spark, sf))
    return blank.select("row_id", "clean_code", F.array_join(F.col("blank").cast("array<string>"), ",").alias("blank"))


@query
def strip_comments_stream(spark, sf):
    """Files that arrive in two portions, each a run of its own with the same checkpoint."""
    code, where = views.v_code(spark, sf), scratch_path(spark, "arriving")
    half = F.pmod(F.xxhash64("row_id"), F.lit(2))
    for k in range(2):
        code.where(half == k).repartition(2).write.mode("append").parquet(f"{where}/in")
        done = process_new_files(spark, f"{where}/in", code.schema, comments.strip_comments, f"{where}/out", f"{where}/checkpoint", files_per_batch=1)
    return done


# --- sampling --------------------------------------------------------------------------------


@query
def stratified_split(spark, sf):
    runs = sampling.experiment_list(spark)
    return sampling.stratified_split(views.v_clean(spark, sf), runs, GROUP).select("language", "experiment", "row_id", "target", "split")


@query
def plain_split(spark, sf):
    return sampling.plain_split(views.v_clean(spark, sf), ["language"]).select("language", "row_id", "split", "big_train")


@query
def undersample(spark, sf):
    return sampling.undersample(views.v_clean(spark, sf), ["language"]).select("language", "row_id", "target", "processed_func")


@query
def oversample(spark, sf):
    drawn = sampling.oversample(views.v_clean(spark, sf), ["language"], require_both=False)
    return drawn.select("language", "row_id", "target", "copy", text_sha())


def _experiment_rows(df):
    return df.select(*EXP, "variant", "row_id", "target", "copy", text_sha())


@query
def experiment_variants(spark, sf):
    return _experiment_rows(_experiments(spark, sf, [(3, 42)]))


@query
def experiments(spark, sf):
    return _experiment_rows(_experiments(spark, sf))


@query
def frame_order(spark, sf):
    """The seeded order that each frame of each experiment carries."""
    return _experiments(spark, sf).select(*EXP, "variant", "row_id", "copy", sampling.ORDER)


@query
def shuffled(spark, sf):
    return sampling.shuffled(views.v_clean(spark, sf), ["language"]).select("language", "row_id", "shuffle_key", "position")


# --- prompts and chats -----------------------------------------------------------------------


def _split_variants(spark, sf):
    """Train, val and test rows of every experiment."""
    return sampling.stratified_split(views.v_clean(spark, sf), sampling.experiment_list(spark), GROUP)


@query
def few_shot_examples(spark, sf):
    train = _split_variants(spark, sf).where("split = 'train'")
    return fewshot.few_shot_examples(train).select(*EXP, "example", "row_id", "target", "processed_func")


@query
def few_shot_prompts(spark, sf):
    placed = _split_variants(spark, sf)
    blocks = fewshot.few_shot_blocks(fewshot.few_shot_examples(placed.where("split = 'train'")))
    return fewshot.few_shot_prompts(placed.where("split = 'test'"), blocks).select(*EXP, "row_id", "prompt")


@query
def zero_shot_prompts(spark, sf):
    return fewshot.zero_shot_prompts(views.v_clean(spark, sf)).select("row_id", "prompt")


@query
def fine_tuning_chats(spark, sf):
    chats = views.v_chats(spark, sf)
    return chats.select(
        "row_id", *[F.col("messages")[i]["content"].alias(n) for i, n in enumerate(["system", "user", "assistant"])]
    )


@query
def chat_format_errors(spark, sf):
    return finetune.chat_format_errors(views.v_chat_lines(spark, sf))


def _turn_facts(spark, sf):
    return finetune.turn_facts(views.table(spark, sf, "conversations"), content="text")


@query
def chat_tokens(spark, sf):
    """Token counts of chats, from records and from single turns."""
    records = finetune.chat_facts(views.v_chats(spark, sf)).withColumn("origin", F.lit("record"))
    turns = _turn_facts(spark, sf).withColumnRenamed("conv_id", "row_id").withColumn("origin", F.lit("turns"))
    columns = ["origin", "row_id", "n_messages", "n_tokens", "n_assistant_tokens"]
    return records.select(*columns).unionByName(turns.select(*columns))


def chat_tokens_vocabulary(spark, sf):
    """Token counts of chats by a public vocabulary. SQL has no such encoder."""
    import public_tokenizers

    counter = tokens.vocabulary_counter(public_tokenizers.path("byte_bpe_50k.json"))
    facts = finetune.chat_facts(views.v_chats(spark, sf), counter=counter)
    return facts.select("row_id", "n_messages", "n_tokens", "n_assistant_tokens")


#: Queries without SQL; a test holds them against the library itself.
NO_SQL = {"chat_tokens_vocabulary": chat_tokens_vocabulary}


@query
def chat_missing_roles(spark, sf):
    return finetune.chat_missing_roles(_turn_facts(spark, sf))


@query
def chat_length_stats(spark, sf):
    return _rounded(finetune.chat_length_stats(_turn_facts(spark, sf)), "mean", "median", "p10", "p90")


@query
def fine_tune_cost(spark, sf):
    return finetune.fine_tune_cost(_turn_facts(spark, sf))


@query
def chat_overview(spark, sf):
    found = finetune.chat_overview(views.v_chats(spark, sf), by=["language"])
    return found.select("language", "n_examples", F.col("first_messages")[1]["content"].alias("first_user"))


# --- answers ---------------------------------------------------------------------------------


def _answers(spark, sf):
    return views.v_results(spark, sf).where(F.col("func_response").isNotNull())


@query
def extract_analysis(spark, sf):
    analysis = responses.extract_analysis(F.col("func_response")).alias("analysis")
    return _answers(spark, sf).select(*RUN, "row_id", analysis)


@query
def response_label(spark, sf):
    return _answers(spark, sf).select(*RUN, "row_id", responses.response_label(F.col("func_response")).alias("label"))


@query
def line_question_gate(spark, sf):
    gate = responses.line_question_gate(F.col("func_response")).alias("needs_line_level")
    return _answers(spark, sf).select(*RUN, "row_id", gate)


@query
def locate_lines(spark, sf):
    hits = _answers(spark, sf).where("target = 1 and prediction = 1")
    found = responses.locate_lines(F.col("line_response"), F.col("processed_func"))
    return hits.select(*RUN, "row_id", F.array_join(found.cast("array<string>"), ",").alias("lines"))


def stub_model(messages, model):
    """A fixed stand-in for a model: a rule on the question's length."""
    code = messages[1]["content"]
    if len(messages) > 2:
        return "Line number 0: `" + code.split("\n")[0] + "`"
    if len(code) % 11 == 0:
        raise ValueError("too long")
    return "1. Analysis: " + ("Vulnerable" if len(code) % 2 else "Non-Vulnerable")


@query
def batch_predict(spark, sf):
    asked = fewshot.zero_shot_prompts(views.v_clean(spark, sf)).withColumn("model", F.lit("stub"))
    done = inference.batch_predict(asked, stub_model)
    return done.select("row_id", "func_response", "line_response", "prediction", F.length("prompt").alias("n_prompt"))


class FailsFirst:
    """The stub, whose connection breaks at the first call for each question."""

    def __init__(self):
        self.called = set()

    def __call__(self, messages, model):
        asked = hashlib.blake2b(str(messages).encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if asked not in self.called:
            self.called.add(asked)
            raise ConnectionError("broken")
        return stub_model(messages, model)


@query
def retried_predict(spark, sf):
    """Four calls at a time, each of which fails once; errors of a row keep their text."""
    asked = fewshot.zero_shot_prompts(views.v_clean(spark, sf)).withColumn("model", F.lit("stub"))
    retry = inference.Retry(attempts=3, longest_wait=0.0)
    done = inference.batch_predict(asked, FailsFirst(), retry=retry, error="error", at_once=4)
    return done.select("row_id", "func_response", "line_response", "prediction", "error")


def stopping_model(messages, model):
    """The stub with a quota that ends at a question of some length."""
    if len(messages[1]["content"]) % 17 == 3:
        raise inference.StopAsking()
    return stub_model(messages, model)


@query
def resumed_run(spark, sf):
    """A few-shot run that is stopped half way, and a second one that asks only what is left."""
    exps = _experiments(spark, sf, [(3, 42)])
    path = scratch_path(spark, "answers")
    runs.few_shot_run(exps, stopping_model, "base", answers=path)
    done = runs.few_shot_run(exps, stub_model, "base", answers=path)
    return done.select(*EXP, "row_id", "target", "model", "func_response", "line_response", "prediction", "error", "attempt")


@query
def fine_tuned_run(spark, sf):
    done = runs.fine_tuned_run(_experiments(spark, sf, [(3, 42)]), stub_model, "ft:1")
    return done.select(*EXP, "row_id", "target", "model", "func_response", "line_response", "prediction")


@query
def attach_predictions(spark, sf):
    done = views.v_results(spark, sf).select("row_id", "experiment", "model", "prediction")
    joined = inference.attach_predictions(views.v_clean(spark, sf), done)
    return joined.select("language", "experiment", "model", "row_id", "target", "prediction")


# --- results and scores ----------------------------------------------------------------------


@query
def true_positives(spark, sf):
    return results.true_positives(views.v_results(spark, sf))


@query
def model_overlap(spark, sf):
    return results.model_overlap(views.v_results(spark, sf))


@query
def overlap_semi_join(spark, sf):
    done = views.v_results(spark, sf)
    return results.overlap_semi_join(done, results.model_overlap(done)).select(*RUN, "row_id", "prediction")


@query
def include_experiments(spark, sf):
    kept = results.include_experiments(views.v_skips(spark, sf))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return kept.select(*GROUP, joined("skip_experiments"), joined("include_experiments"))


@query
def experiment_totals(spark, sf):
    return results.experiment_totals(views.v_results(spark, sf))


@query
def func_metrics(spark, sf):
    return _rounded(metrics.func_metrics(views.v_results(spark, sf)), *metrics.FUNC_METRICS)


def _facts(spark, sf):
    done = views.v_results(spark, sf)
    totals = results.experiment_totals(done)
    return linelevel.line_facts(done, totals), totals


@query
def topk_accuracy(spark, sf):
    facts, _ = _facts(spark, sf)
    return _rounded(linelevel.topk_accuracy(facts), *[f"top_{k}_accuracy" for k in linelevel.TOP_K])


@query
def ifa(spark, sf):
    facts, _ = _facts(spark, sf)
    return _rounded(linelevel.ifa(facts), "ifa")


@query
def ifa_rounded(spark, sf):
    facts, _ = _facts(spark, sf)
    return linelevel.ifa(facts, places=2)


@query
def effort_at_recall(spark, sf):
    facts, totals = _facts(spark, sf)
    return _rounded(linelevel.effort_at_recall(facts, totals), "effort_at_20_recall")


@query
def recall_at_loc(spark, sf):
    facts, totals = _facts(spark, sf)
    return _rounded(linelevel.recall_at_loc(facts, totals), "recall_at_1_loc")


@query
def line_metrics(spark, sf):
    done = views.v_results(spark, sf)
    return _rounded(linelevel.line_metrics(done, results.experiment_totals(done)), *linelevel.LINE_METRICS)


def _joined_ids(df, *names):
    return df.withColumns({n: F.array_join(F.col(n).cast("array<string>"), ",") for n in names})


@query
def avg_func_metrics(spark, sf):
    mean = scores.avg_func_metrics(views.v_results(spark, sf), views.v_skips(spark, sf))
    return _joined_ids(_rounded(mean, *metrics.FUNC_METRICS), "include_experiments", "zero_f1_experiments")


@query
def avg_line_metrics(spark, sf):
    done = views.v_results(spark, sf)
    totals, overlap = results.experiment_totals(done), results.model_overlap(done)
    mean = scores.avg_line_metrics(done, totals, overlap, views.v_skips(spark, sf))
    return _joined_ids(_rounded(mean, *linelevel.LINE_METRICS), "include_experiments")


@query
def score_matrix(spark, sf):
    done = views.v_results(spark, sf)
    matrix = scores.score_matrix(done, results.experiment_totals(done), None, views.v_skips(spark, sf))
    rounded = _rounded(matrix, *metrics.FUNC_METRICS, *linelevel.LINE_METRICS)
    return _joined_ids(rounded, "func_experiments", "line_experiments", "zero_f1_experiments").orderBy(*GROUP, "model")
