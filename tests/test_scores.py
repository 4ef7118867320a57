import math
import random

import pytest
from pyspark.sql import functions as F

from funclab.operators import linelevel, metrics, results, scores
from funclab.operators.linelevel import LINE_METRICS, TOP_K
from funclab.schemas import RUN_KEYS

SCHEMA = (
    "language string, configuration string, experiment int, model string, row_id long, processed_func string, target int, "
    "prediction int, flaw_line_index string, line_response string, line_ranking array<int>, num_lines int, num_flaw_lines int"
)
MODELS = ["gpt_a", "linevul_undersampling", "linevul_b"]


def made_up(seed=5, n=60):
    """Results where the runs of experiment 2 have no true positive."""
    rng = random.Random(seed)
    rows = []
    for e in range(3):
        for i in rng.sample(range(1000), n):
            lines = [f"l{j}" for j in range(rng.randint(1, 30))]
            truth = sorted(rng.sample(range(len(lines)), rng.randint(1, min(4, len(lines)))))
            target = rng.randint(0, 1)
            for model in MODELS:
                ranked = [rng.randrange(len(lines)) for _ in range(rng.randint(0, 15))]
                said = 1 - target if e == 2 else rng.choice([target, target, 1 - target])
                gpt = model.startswith("gpt")
                # `lJ;` is found in line J alone only if no earlier line is its prefix, so ask by exact text.
                answer = "\n".join(f"Line {j}: `l{j}`" for j in ranked)
                rows.append(
                    ("k", "c", e, model, i, "\n".join(lines), target, said, ", ".join(f"{t}.0" for t in truth))
                    + ((answer if rng.random() < 0.9 else None, None, None, None) if gpt else (None, ranked, len(lines), len(truth) * target))
                )
    return rows


def said_lines(row):
    from test_responses import located

    if row["model"].startswith("linevul"):
        return row["line_ranking"]
    return located(row["line_response"], row["processed_func"]) if row["line_response"] is not None else []


def expected(rows, totals):
    """Line scores of one run, reading the true positives' lines one by one in row order."""
    lines, flaws = totals
    hits = [r for r in sorted(rows, key=lambda r: r["row_id"]) if r["target"] == r["prediction"] == 1]
    said = [said_lines(r) for r in hits]
    truth = [{int(float(x)) for x in r["flaw_line_index"].split(",")} for r in hits]
    firsts = [next((p for p, x in enumerate(s) if x in t), None) for s, t in zip(said, truth)]
    n = len(hits)
    out = {f"top_{k}_accuracy": sum(f is not None and f < k for f in firsts) / n if n else 0 for k in TOP_K}
    clean = [f if f is not None else len(s) or r["processed_func"].count("\n") + 1 for f, s, r in zip(firsts, said, hits)]
    out["ifa"] = sum(clean) / n if n else 100
    goal, found, effort = int(flaws * 0.2), 0, 0
    for right in [x in t for s, t in zip(said, truth) for x in s]:
        if found >= goal:
            break
        effort, found = effort + 1, found + right
    out["effort_at_20_recall"] = effort / lines if lines else 0
    cut = int(lines * 0.01)
    out["recall_at_1_loc"] = sum(len(set(s[:cut]) & t) for s, t in zip(said, truth)) / flaws if flaws else 0
    return out


def by_run(rows):
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r[k] for k in RUN_KEYS), []).append(r)
    return groups


@pytest.fixture(scope="module")
def done(spark):
    return spark.createDataFrame(made_up(), SCHEMA)


def check(done, overlap=None, kept=lambda r: True):
    totals = results.experiment_totals(done)
    known = {r.experiment: (r.total_lines, r.total_flaw_lines) for r in totals.collect()}
    got = {tuple(r[k] for k in RUN_KEYS): r for r in linelevel.line_metrics(done, totals, overlap).collect()}
    groups = by_run(done.collect())
    assert set(got) == set(groups)
    for key, rows in groups.items():
        want = expected([r for r in rows if kept(r)], known[key[2]])
        for name in LINE_METRICS:
            assert math.isclose(got[key][name], want[name], abs_tol=1e-12), (key, name, got[key][name], want[name])


def test_line_metrics(done):
    check(done)
    check(done.repartition(11))


def test_line_metrics_within_the_overlap(done):
    overlap = results.model_overlap(done, MODELS)
    texts = None
    for model in MODELS:
        mine = {(r.experiment, r.processed_func) for r in done.collect() if r.model == model and r.target == r.prediction == 1}
        texts = mine if texts is None else texts & mine
    assert texts and overlap.count() == len(texts)
    check(done, overlap, lambda r: (r["experiment"], r["processed_func"]) in texts)


@pytest.mark.parametrize("buckets", [1, 3, 100000])
def test_effort_does_not_depend_on_ranges(done, buckets):
    totals = results.experiment_totals(done)
    facts = linelevel.line_facts(done, totals)
    base = linelevel.effort_lines(facts, totals).collect()
    assert sorted(base) == sorted(linelevel.effort_lines(facts, totals, buckets=buckets).collect())
    assert any(r.effort_lines > 0 for r in base)


def effort_facts(spark, seed=6):
    """Runs with evenly spread places, with one far place, and with all rows at few places."""
    rng = random.Random(seed)
    rows, goals = [], []
    for e, places in enumerate(([3 * k for k in range(400)], [*range(399), 10**15], [k // 50 for k in range(400)], [5])):
        for k in places:
            said = rng.randint(0, 4)
            rows.append(("k", "c", e, "m", k, said, sorted(rng.sample(range(1, said + 1), rng.randint(0, said)))))
        goals.append(("k", "c", e, 5000, 5 * sum(len(r[6]) for r in rows if r[2] == e) // 2))
    facts = spark.createDataFrame(rows, "language string, configuration string, experiment int, model string, row_id long, n_said int, hit_at array<int>")
    totals = spark.createDataFrame(goals, "language string, configuration string, experiment int, total_lines long, total_flaw_lines long")
    return rows, facts.repartition(5), totals


@pytest.mark.parametrize("buckets", [2, 3, 64])
def test_effort_within_quantile_ranges(spark, buckets):
    rows, facts, totals = effort_facts(spark)
    whole = {r.experiment: r.effort_lines for r in linelevel.effort_lines(facts, totals).collect()}
    cut = {r.experiment: r.effort_lines for r in linelevel.effort_lines(facts, totals, buckets=buckets, bound=5).collect()}
    goals = {r.experiment: int(r.total_flaw_lines * 0.2) for r in totals.collect()}
    for e in (0, 1):
        found = effort = 0
        for r in sorted((r for r in rows if r[2] == e), key=lambda r: r[4]):
            for line in range(1, r[5] + 1):
                if found < goals[e]:
                    effort, found = effort + 1, found + (line in r[6])
        assert cut[e] == whole[e] == effort
    assert set(cut) == set(whole)


def test_one_far_row_leaves_no_large_range(spark):
    _, facts, totals = effort_facts(spark)
    none, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    spans = facts.groupBy(*linelevel.RUN_KEYS).agg(F.count(F.lit(1)).alias("_n")).where("_n = 400").join(totals, linelevel.EXPERIMENT_KEYS)
    goal = F.col("total_flaw_lines") * F.lit(0.2)
    spans = spans.select(*linelevel.RUN_KEYS, goal.cast("bigint").alias("_goal"), none.alias("_low"), none.alias("_high"), zero.alias("_hits_before"), zero.alias("_said_before"), "_n")
    narrow = facts.withColumnRenamed("row_id", "_at")
    kept = {r.experiment: r._n for r in linelevel._goal_ranges(narrow, spans, linelevel.RUN_KEYS, 20).collect()}
    assert kept[0] <= 3 * 20 and kept[1] <= 3 * 20 and kept[2] <= 50


def test_missing_totals_are_refused(done):
    totals = results.experiment_totals(done).where("experiment <> 1")
    facts = linelevel.line_facts(done, totals)
    for scored in (linelevel.line_metrics(done, totals), linelevel.effort_at_recall(facts, totals), linelevel.recall_at_loc(facts, totals)):
        with pytest.raises(Exception, match="no total"):
            scored.collect()


def test_effort_with_a_goal_below_one_line(spark):
    rows = [("k", "c", 0, "linevul_undersampling", 1, "a\nb", 1, 1, "1", None, [0, 1], 200, 4)]
    done = spark.createDataFrame(rows, SCHEMA)
    row = linelevel.line_metrics(done, results.experiment_totals(done)).first()
    assert (row.effort_at_20_recall, row.ifa, row.top_1_accuracy, row.top_3_accuracy, row.recall_at_1_loc) == (0, 1, 0, 1, 0.25)


def test_single_scores_agree_with_the_whole(done):
    totals = results.experiment_totals(done)
    facts = linelevel.line_facts(done, totals)
    whole = linelevel.line_metrics(done, totals).where("n_true_positives > 0")
    for part in (
        linelevel.topk_accuracy(facts),
        linelevel.ifa(facts),
        linelevel.recall_at_loc(facts, totals),
        linelevel.effort_at_recall(facts, totals),
    ):
        assert whole.select(*part.columns).exceptAll(part).count() == 0


@pytest.mark.parametrize(
    "pairs, want",
    [
        ([(1, 1)] * 3 + [(0, 1)] + [(1, 0)] * 2 + [(0, 0)] * 4, (3 / 4, 3 / 5, 2 / 3, 0.7, 10 / math.sqrt(600))),
        ([(1, 0), (0, 0)], (0, 0, 0, 0.5, 0)),
        ([(0, 1), (0, 0)], (0, 0, 0, 0.5, 0)),
        ([(0, 0)], (0, 0, 0, 1, 0)),
        ([(1, 1)], (1, 1, 1, 1, 0)),
        ([(1, 1), (0, 0)], (1, 1, 1, 1, 1)),
        ([(1, 0), (0, 1)], (0, 0, 0, 0, -1)),
    ],
)
def test_func_metrics(spark, pairs, want):
    df = spark.createDataFrame(pairs, "target int, prediction int")
    row = metrics.func_metrics(df, by=[]).first()
    assert all(math.isclose(row[m], w, abs_tol=1e-12) for m, w in zip(metrics.FUNC_METRICS, want))


def test_means_leave_out_skipped_experiments(spark, done):
    skips = spark.createDataFrame([("k", "c", 1)], "language string, configuration string, experiment int")
    per_run = metrics.func_metrics(done).where("experiment <> 1").collect()
    for r in scores.with_absent_experiments(scores.avg_func_metrics(done, skips), 4).collect():
        assert r.absent_experiments == [1, 3]
        mine = [x for x in per_run if x.model == r.model]
        assert r.include_experiments == [0, 2]
        assert r.zero_f1_experiments == [2]
        assert math.isclose(r.f1, sum(x.f1 for x in mine) / 2)


def test_score_matrix(spark, done):
    skips = spark.createDataFrame([("k", "c", 2)], "language string, configuration string, experiment int")
    totals = results.experiment_totals(done)
    rows = scores.score_matrix(done, totals, None, skips).collect()
    assert [r.model for r in rows] == sorted(MODELS)
    line = {r.model: r for r in scores.avg_line_metrics(done, totals, None, skips).collect()}
    for r in rows:
        assert (r.func_experiments, r.line_experiments) == ([0, 1, 2], [0, 1])
        assert all(r[m] == line[r.model][m] for m in LINE_METRICS)


def test_ids_names_and_labels(spark):
    df = spark.createDataFrame([([3, 1],), ([],), (None,)], "ids array<int>")
    got = [r[0] for r in df.select(results.complement(F.col("ids"))).collect()]
    assert got == [[0, 2, 4, 5, 6, 7, 8, 9], list(range(10)), list(range(10))]
    df = spark.createDataFrame([("gpt-3.5-turbo", None), ("ft:x", None), ("gpt-3.5-turbo", 10)], "m string, n int")
    names = [r[0] for r in df.select(results.run_name(F.col("m"), F.col("n"))).collect()]
    assert names == ["gpt_default", "gpt_fine_tuning", "gpt_few_shot_10"]
    df = spark.createDataFrame([("1",), ("true",), ("True",), ("0",), ("x",), (None,)], "p string")
    assert [r[0] for r in df.select(results.as_label(F.col("p"))).collect()] == [1, 1, 1, 0, 0, 0]


def test_overlap_of_an_experiment_without_any_is_empty(done):
    overlap = results.model_overlap(done, MODELS)
    kept = results.overlap_semi_join(done, overlap)
    assert kept.where("experiment = 2").count() == 0 and kept.where("experiment < 2").count() > 0
    assert results.overlap_semi_join(done, None) is done
