import math
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from funclab import config
from funclab.operators import sampling
from funclab.schemas import VARIANTS
from funclab.plans import settle as settling

GROUP = ["language", "configuration"]


def quotas(sizes, ratio=0.4):
    """Rows per class of train, val and test, by exact fractions."""

    def share(counts, size):
        total = sum(counts.values())
        exact = {c: Fraction(n * size, total) if total else Fraction(0) for c, n in counts.items()}
        got = {c: math.floor(x) for c, x in exact.items()}
        order = sorted(exact, key=lambda c: (-(exact[c] - got[c]), c))
        for c in order[: size - sum(got.values())]:
            got[c] += 1
        return got

    n = sum(sizes.values())
    rest = math.ceil(ratio * n)
    train = share(sizes, n - rest)
    left = {c: sizes[c] - train[c] for c in sizes}
    val = share(left, rest - math.ceil(rest * 0.5))
    return {"train": train, "val": val, "test": {c: left[c] - val[c] for c in sizes}}


def counted(rows, *names):
    return Counter(tuple(r[n] for n in names) for r in rows)


@pytest.mark.parametrize("n0, n1", [(348, 51), (10, 10), (5, 0), (1, 1), (7, 3), (100, 1), (0, 3)])
def test_quotas(spark, n0, n1):
    sizes = {c: n for c, n in ((0, n0), (1, n1)) if n}
    counts = spark.createDataFrame([("g", c, n) for c, n in sizes.items()], "g string, target int, n_class long")
    got = {r.target: (r.n_train, r.n_val, r.n_test) for r in sampling.split_quotas(counts, ["g"]).collect()}
    want = quotas(sizes)
    assert got == {c: (want["train"][c], want["val"][c], want["test"][c]) for c in sizes}


def test_split_is_whole_disjoint_and_stratified(spark, clean):
    rows = sampling.stratified_split(clean, sampling.experiment_list(spark), GROUP).collect()
    assert counted(rows, "row_id", "experiment") == {(i, e): 1 for i in range(120) for e, _ in config.EXPERIMENTS}
    sizes = counted(clean.collect(), "language", "target")
    got = counted(rows, "language", "experiment", "split", "target")
    for lang in ("kotlin", "rust"):
        want = quotas({c: sizes[(lang, c)] for c in (0, 1)})
        for e, _ in config.EXPERIMENTS:
            assert {(s, c): got[(lang, e, s, c)] for s in want for c in (0, 1)} == {
                (s, c): want[s][c] for s in want for c in (0, 1)
            }
    trains = {e: frozenset(r.row_id for r in rows if r.experiment == e and r.split == "train") for e in range(10)}
    assert len(set(trains.values())) == 10


def test_split_does_not_depend_on_partitions(spark, clean):
    runs = sampling.experiment_list(spark, [(0, 0), (3, 42)])
    one = sampling.experiments(clean.coalesce(1), runs)
    many = sampling.experiments(clean.repartition(9), runs)
    assert one.exceptAll(many).count() == 0 and one.count() == many.count()


def test_split_without_broadcast_is_the_same(spark, clean, monkeypatch):
    runs = sampling.experiment_list(spark, [(1, 1)])
    small = sampling.experiments(clean, runs)
    monkeypatch.setattr(settling, "MAX_BROADCAST_ROWS", 1)
    large = sampling.experiments(clean, runs)
    assert small.exceptAll(large).count() == 0 and small.count() == large.count()


def test_plain_split(spark, clean):
    rows = sampling.plain_split(clean).collect()
    assert counted(rows, "split") == {("train",): 72, ("val",): 24, ("test",): 24}
    assert all(r.big_train == (r.split != "test") for r in rows)


def test_undersample(spark, clean):
    rows = sampling.undersample(clean, ["language"]).collect()
    sizes = counted(clean.collect(), "language", "target")
    small = {lang: min(sizes[(lang, 0)], sizes[(lang, 1)]) for lang in ("kotlin", "rust")}
    assert counted(rows, "language", "target") == {(lang, c): small[lang] for lang in small for c in (0, 1)}
    assert max(counted(rows, "row_id").values()) == 1


@pytest.mark.parametrize("per_piece", [4096, 2, 1])
def test_oversample(spark, clean, per_piece):
    rows = sampling.oversample(clean, ["language"], per_piece=per_piece).collect()
    sizes = counted(clean.collect(), "language", "target")
    for lang in ("kotlin", "rust"):
        mine = [r for r in rows if r.language == lang]
        big = max(sizes[(lang, 0)], sizes[(lang, 1)])
        assert counted(mine, "target") == {(0,): big, (1,): big}
        assert {r.row_id for r in mine if r.target == 0} == {r.row_id for r in clean.collect() if r.language == lang and r.target == 0}
        texts = {r.row_id: r.processed_func for r in clean.collect()}
        assert all(texts[r.row_id] == r.processed_func for r in mine)
    assert max(counted(rows, "row_id", "copy").values()) == 1


def test_one_row_drawn_thousands_of_times_is_copied_in_pieces(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("row_id"), F.lit("x").alias("language"), (F.col("id") == 7).cast("int").alias("target"), F.lit("t").alias("code")
    )
    drawn = sampling.oversample(rows, ["language"], per_piece=1000)
    hot = drawn.where("target = 1")
    assert hot.count() == 19_999 and hot.select("copy").distinct().count() == 19_999
    assert hot.select("row_id").distinct().count() == 1
    assert hot.select(F.max(F.col("copy") % 20)).first()[0] == 19


def test_equal_classes_redraw_class_0(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(40)], "row_id long, target int")
    got = sampling.oversample(rows).collect()
    assert counted(got, "target") == {(0,): 20, (1,): 20}
    assert len({r.row_id for r in got if r.target == 1}) == 20
    assert len({r.row_id for r in got if r.target == 0}) < 20


def test_one_class_only(spark):
    rows = spark.createDataFrame([(i, 0) for i in range(5)], "row_id long, target int")
    assert sampling.undersample(rows).count() == 0
    with pytest.raises(ValueError, match="both classes"):
        sampling.oversample(rows)
    kept = sampling.oversample(rows, require_both=False).collect()
    assert counted(kept, "row_id") == {(i,): 1 for i in range(5)}


def test_experiments_have_seven_frames(spark, clean):
    rows = sampling.experiments(clean, sampling.experiment_list(spark)).collect()
    got = counted(rows, "language", "experiment", "variant", "target")
    for lang in ("kotlin", "rust"):
        for e, _ in config.EXPERIMENTS:
            for split in ("train", "val"):
                n0, n1 = got[(lang, e, split, 0)], got[(lang, e, split, 1)]
                for c in (0, 1):
                    assert got[(lang, e, f"{split}_undersampling", c)] == min(n0, n1)
                    assert got[(lang, e, f"{split}_oversampling", c)] == max(n0, n1)
            assert not any(k[2].startswith("test_") for k in got)
    members = {}
    for r in rows:
        members.setdefault((r.language, r.experiment, r.variant), set()).add(r.row_id)
    for (lang, e, variant), ids in members.items():
        assert ids <= members[(lang, e, variant.split("_")[0])]
    assert len(rows[0].asDict()) == len(set(rows[0].asDict()))


def test_experiments_refuse_an_empty_class(spark, clean):
    runs = sampling.experiment_list(spark, [(0, 0)])
    with pytest.raises(ValueError, match="both classes"):
        sampling.experiments(clean.where("target = 0"), runs)


def test_null_groups_are_refused(spark, clean):
    rows = clean.withColumn("language", F.when(F.col("row_id") != 5, F.col("language")))
    with pytest.raises(ValueError, match="null in language"):
        sampling.stratified_split(rows, sampling.experiment_list(spark, [(0, 0)]), ["language"])
    with pytest.raises(ValueError, match="null in language"):
        sampling.undersample(rows, ["language"])


def test_shuffled_positions(spark, clean):
    rows = sampling.shuffled(clean, ["language"]).collect()
    for lang in ("kotlin", "rust"):
        mine = sorted((r for r in rows if r.language == lang), key=lambda r: r.shuffle_key)
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))
        assert [r.row_id for r in mine] != sorted(r.row_id for r in mine)


def test_frames_carry_their_order(spark, clean):
    rows = sampling.experiments(clean, sampling.experiment_list(spark, [(0, 0), (3, 42)])).collect()
    frames = {}
    for r in rows:
        frames.setdefault((r.language, r.experiment, r.variant), []).append(r)
    assert {f[2] for f in frames} == set(VARIANTS)
    orders = {}
    for f, mine in frames.items():
        assert len({r.order_key for r in mine}) == len(mine)
        orders[f] = [r.row_id for r in sorted(mine, key=lambda r: r.order_key)]
        assert len(mine) < 5 or orders[f] != sorted(orders[f])
    assert orders["kotlin", 0, "train"][:5] != orders["kotlin", 3, "train"][:5]
    again = sampling.experiments(clean.repartition(7), sampling.experiment_list(spark, [(0, 0), (3, 42)])).collect()
    assert sorted((r.variant, r.row_id, r.copy, r.order_key) for r in rows) == sorted((r.variant, r.row_id, r.copy, r.order_key) for r in again)


def test_repeated_keys_are_refused(spark, clean):
    runs = sampling.experiment_list(spark, [(0, 0)])
    twice = clean.unionByName(clean.where("row_id = 5").withColumn("target", 1 - F.col("target")))
    for sampled in (
        lambda: sampling.stratified_split(twice, runs, GROUP),
        lambda: sampling.plain_split(twice, GROUP),
        lambda: sampling.undersample(twice, GROUP),
        lambda: sampling.oversample(twice, GROUP),
        lambda: sampling.experiments(twice, runs),
        lambda: sampling.shuffled(twice, GROUP),
    ):
        with pytest.raises(ValueError, match="occurs more than once"):
            sampled()
    # The same key in another group is another row.
    apart = clean.unionByName(clean.where("row_id = 5").withColumn("configuration", F.lit("other")))
    assert sampling.stratified_split(apart, runs, GROUP).count() == 121


def test_experiments_made_run_by_run(spark, clean):
    runs = sampling.experiment_list(spark, [(0, 0), (1, 1), (3, 42)])
    plain, by_run = sampling.experiments(clean, runs), sampling.experiments(clean, runs, run_by_run=True)
    assert by_run.columns == plain.columns and by_run.count() == plain.count()
    assert by_run.exceptAll(plain).count() == 0
    # The many copies of a text are made where it lies: no task holds rows of two experiments, but for redrawn ones.
    placed = by_run.where("copy = 0 and variant not like '%over%'").withColumn("task", F.spark_partition_id())
    assert placed.groupBy("task").agg(F.count_distinct("experiment").alias("n")).where("n > 1").count() == 0
