"""Seeded splits and resampling, for all groups and experiments in one plan.

Every choice "the first k of a class in seeded random order" is turned into a cut: the k-th
smallest key of the class. Cuts come from narrow passes over ids; the pass that carries the texts
only compares each row's key with its cut, so texts are neither shuffled nor sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funclab.config import EXPERIMENTS, RESAMPLE_SEED, VAL_TEST_RATIO
from funclab.functions.hashing import draw_int, draw_key
from funclab.plans.ranks import AFTER_ALL, BEFORE_ALL, exact_rank, key_cuts, prefix_digits
from funclab.plans.settle import each_number, fits_broadcast, lookup_join, settle, settle_table

#: Column that holds the seeded order of the rows of a frame: 32 hex digits, none twice in a frame.
ORDER = "order_key"
# A drawn row is copied in pieces of about this many, each a unit of work of its own.
COPIES_PER_PIECE = 4096


def frame_key(variant, seed, key, copy=0):
    """The place of a row in the seeded order of its frame; the experiment is a column of the rows."""
    return draw_key("frame", variant, seed, F.col("experiment"), F.col(key), copy)


def experiment_list(spark, experiments=EXPERIMENTS) -> DataFrame:
    return spark.createDataFrame(experiments, "experiment int, seed int")


def _per_class(total, share, size):
    """Largest remainder: whole part of the share, then one more to the largest fractions."""
    exact = F.coalesce(F.try_divide(share, total) * size, F.lit(0.0))
    return F.floor(exact).cast("bigint"), exact - F.floor(exact)


def _quota(counts, by, target, n_class, size, name):
    """Add ``name``: how many of ``size`` draws fall to each class."""
    group = Window.partitionBy(*by)
    total = F.sum(n_class).over(group).cast("double")
    whole, part = _per_class(total, F.col(n_class).cast("double"), F.col(size))
    split = counts.withColumn("_whole", whole).withColumn("_part", part)
    place = F.row_number().over(group.orderBy(F.col("_part").desc(), F.col(target)))
    missing = F.col(size) - F.sum("_whole").over(group)
    return split.withColumn(name, F.col("_whole") + F.when(place <= missing, 1).otherwise(0)).drop("_whole", "_part")


def split_quotas(counts: DataFrame, by, target="target", val_test_ratio=VAL_TEST_RATIO) -> DataFrame:
    """Rows of each class that go to train, val and test; ``counts`` has one row per class."""
    n = F.sum("n_class").over(Window.partitionBy(*by))
    rest = F.ceil(F.lit(float(val_test_ratio)) * n.cast("double")).cast("bigint")
    test = F.ceil(rest.cast("double") * F.lit(0.5)).cast("bigint")
    sized = counts.withColumn("_size_train", n - rest).withColumn("_size_val", rest - test)
    train = _quota(sized, by, target, "n_class", "_size_train", "n_train")
    left = train.withColumn("_n_left", F.col("n_class") - F.col("n_train"))
    val = _quota(left, by, target, "_n_left", "_size_val", "n_val")
    return val.withColumn("n_test", F.col("_n_left") - F.col("n_val")).drop("_size_train", "_size_val", "_n_left")


def _largest(counts, column):
    return counts.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]


def _cut_table(keyed, by, ranks, names, largest):
    """One row per group; ``names`` maps each new cut column to its rank column in ``ranks``."""
    wanted = None
    for rank in names.values():
        one = ranks.select(*by, F.col(rank).cast("bigint").alias("rank")).where(F.col("rank") > 0)
        wanted = one if wanted is None else wanted.union(one)
    cuts = settle(key_cuts(keyed, by, "_key", wanted.distinct(), prefix_digits(largest)))
    table = ranks
    for name, rank in names.items():
        mine = cuts.select(*by, F.col("rank").alias(rank), F.col("cut").alias(name))
        table = table.join(mine, [*by, rank], "left").withColumn(name, F.coalesce(name, F.lit(BEFORE_ALL)))
    return table


def _require_keys(counts, names):
    """Equi-joins drop null keys, so a null group or class is refused."""
    null = F.greatest(*[F.col(n).isNull() for n in names], F.lit(False), F.lit(False))
    if counts.where(null).limit(1).count():
        raise ValueError(f"null in {', '.join(names)}")


def _class_sizes_of(rows, by, classes, key):
    """Rows of each class as ``n_class``; a null group or class, or a key twice in a group, is refused.

    Keys are counted first and classes from those counts, so the check costs no pass of its own.
    """
    strata = [c for c in classes if c not in by]
    each = rows.groupBy(*by, key).agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in strata])
    counts = settle(each.groupBy(*classes).agg(F.sum("_n").alias("n_class"), F.max("_n").alias("_most"), F.max(F.struct("_n", key))[key].alias("_key")))
    _require_keys(counts, classes)
    repeated = counts.where("_most > 1").select("_key").first()
    if repeated:
        raise ValueError(f"{key} {repeated[0]} occurs more than once in its group")
    return counts.drop("_most", "_key")


def _split_cuts(ids, seeds, by, strata, val_test_ratio, key):
    """Per class and experiment: its seed and quotas, and the keys at which train and val end."""
    classes = [*by, strata] if strata else list(by)
    counts = _class_sizes_of(ids, list(by), classes, key)
    if strata:
        quotas = split_quotas(counts, by, strata, val_test_ratio)
    else:
        quotas = split_quotas(counts.withColumn("_one", F.lit(0)), [*by, "_one"], "_one", val_test_ratio).drop("_one")
    runs = F.array(*[F.struct(F.lit(e).alias("experiment"), F.lit(s).alias("seed")) for e, s in seeds])
    ranks = (
        quotas.withColumn("_upto_val", F.col("n_train") + F.col("n_val"))
        .withColumn("_run", F.explode(runs))
        .select(*classes, "_run.experiment", "_run.seed", "n_train", "n_val", "_upto_val")
    )
    keyed = _per_run(ids, _by_class(ranks, classes, "seed"), classes, key).select(*classes, "_run.experiment", "_key")
    names = {"_train_cut": "n_train", "_val_cut": "_upto_val"}
    return settle(_cut_table(keyed, [*classes, "experiment"], ranks, names, _largest(counts, "n_class")))


def _by_class(table, classes, *columns):
    """One row per class with its runs in a list, as long as the list of experiments."""
    runs = F.array_sort(F.collect_list(F.struct("experiment", *columns)))
    return settle(table.groupBy(*classes).agg(runs.alias("_runs")))


def _per_run(rows, runs, classes, key, parts=0):
    """Each row once per run of its class, with ``_run`` and its ``_key`` there.

    The join happens before the rows are multiplied. Every class has its runs, so no row is lost.
    With ``parts`` the runs are dealt over that many groups, and each group has tasks of its own.
    """
    joined = lookup_join(rows, runs, classes, spread=key)
    if parts:
        mine = F.filter("_runs", lambda _, i: i % parts == F.col("_part"))
        each = each_number(joined, parts, "_part").withColumn("_run", F.explode(mine)).drop("_runs", "_part")
    else:
        each = joined.withColumn("_run", F.explode("_runs")).drop("_runs")
    return each.withColumn("_key", draw_key("split", F.col("_run.seed"), F.col(key)))


_CUTS = ["seed", "_train_cut", "_val_cut"]


def _place(rows, runs, classes, key, parts=0):
    """Each row once per experiment, with its split; ``_run`` stays."""
    split = (
        F.when(F.col("_key") <= F.col("_run._train_cut"), "train")
        .when(F.col("_key") <= F.col("_run._val_cut"), "val")
        .otherwise("test")
    )
    placed = _per_run(rows, runs, classes, key, parts).withColumn("experiment", F.col("_run.experiment"))
    return placed.withColumn("split", split).drop("_key")


def _seeds(experiments):
    """The list of experiments: a handful of ids and seeds."""
    return [tuple(row) for row in experiments.select("experiment", "seed").collect()]


def _split(rows, seeds, by, strata, val_test_ratio, key):
    classes = [*by, strata] if strata else list(by)
    ids = settle_table(rows.select(key, *classes), "split-ids")
    cuts = _split_cuts(ids, seeds, by, strata, val_test_ratio, key)
    placed = _place(rows, _by_class(cuts, classes, *_CUTS), classes, key)
    return placed.withColumn(ORDER, frame_key(F.col("split"), F.col("_run.seed"), key)).drop("_run")


def stratified_split(rows: DataFrame, experiments: DataFrame, by=(), target="target", val_test_ratio=VAL_TEST_RATIO, key="row_id") -> DataFrame:
    """Each row once per experiment, with its ``split``; class shares are kept to the row.

    ``order_key`` is the row's place in the random order of its frame.

    A key that occurs twice in a group is an error, since it would shift the split.
    Sizes: val and test together take ceil(ratio * n), test the larger half of it; classes share a
    size by largest remainder. Small passes over ids run at once to fix the cuts.
    """
    return _split(rows, _seeds(experiments), list(by), target, val_test_ratio, key)


def plain_split(rows: DataFrame, by=(), seed=0, val_test_ratio=VAL_TEST_RATIO, key="row_id") -> DataFrame:
    """One split of the given sizes, blind to classes. ``big_train`` is every row not in test."""
    grouped = rows if by else rows.withColumn("_all", F.lit(0))
    placed = _split(grouped, [(0, seed)], list(by) or ["_all"], None, val_test_ratio, key)
    return placed.drop("experiment", "_all").withColumn("big_train", F.col("split") != "test")


def _class_sizes(counts, by, target):
    """Both class sizes beside each class row."""
    group = Window.partitionBy(*by)
    size = lambda value: F.coalesce(F.sum(F.when(F.col(target) == value, F.col("n_class"))).over(group), F.lit(0))
    return counts.where(F.col(target).isin(0, 1)).withColumn("_n0", size(0)).withColumn("_n1", size(1))


def resampling_plan(rows: DataFrame, by, target="target", seed=RESAMPLE_SEED, key="row_id", counts=None) -> DataFrame:
    """Per group and class: the cut for undersampling, and the class's part in oversampling.

    Oversampling keeps the larger class whole and redraws the smaller one; at a tie class 0 is
    redrawn.
    """
    by = list(by)
    if counts is None:
        counts = _class_sizes_of(rows, by, [*by, target], key)
    sizes = _class_sizes(counts, by, target)
    smaller = F.least("_n0", "_n1")
    redrawn = F.when(F.col("_n1") < F.col("_n0"), 1).otherwise(0)
    plan = sizes.withColumn("_take", smaller).withColumn(
        "_rank", F.when(smaller < F.col("n_class"), smaller).otherwise(F.lit(0))
    )
    keyed = rows.select(key, *by, target).withColumn("_key", draw_key("under", seed, F.col(key)))
    table = _cut_table(keyed, [*by, target], plan, {"_cut": "_rank"}, _largest(counts, "n_class"))
    whole = F.col("_take") == F.col("n_class")
    return table.select(
        *by,
        target,
        F.when(F.col("_take") == 0, F.lit(BEFORE_ALL)).when(whole, F.lit(AFTER_ALL)).otherwise(F.col("_cut")).alias("_under_cut"),
        (F.col(target) != redrawn).alias("_keep_over"),
        F.greatest("_n0", "_n1").alias("_n_major"),
        smaller.alias("_n_minor"),
    )


def _require_both_classes(plan, by):
    empty = plan.where((F.col("_n_minor") == 0) & (F.col("_n_major") > 0)).limit(1).collect()
    if empty:
        raise ValueError(f"oversampling needs rows of both classes; missing in {empty[0].asDict()}")


def _with_draws(ids, seed, key):
    """The number a row of the larger class draws; it picks a row of the smaller one."""
    return ids.withColumn("_draw", draw_int("over", seed, F.col(key)))


def redrawn_rows(rows: DataFrame, plan: DataFrame, by, target="target", seed=RESAMPLE_SEED, key="row_id", per_piece=COPIES_PER_PIECE, ids=None) -> DataFrame:
    """The smaller class of each group, redrawn with replacement to the size of the larger.

    ``rows`` must hold one row per group and key. Adds ``copy``, counting the copies of a row.
    ``ids`` may give key, group and class from a cheaper source: a pair of frames, one that has
    all rows of larger classes with their ``_draw``, and one that has all rows of smaller classes.

    The rows of the larger class act as the draws, so drawing is spread like the data, and draws
    of the same row are counted before they are shuffled. A row with very many copies is copied in
    pieces, each joined on its own, so no task copies one row without bound.
    """
    by = list(by)
    pieces = F.ceil(F.col("_n_major") / (F.col("_n_minor") * F.lit(per_piece))).cast("bigint")
    roles = plan.where(F.col("_n_minor") > 0).withColumn("_pieces", F.greatest(pieces, F.lit(1)))
    roles = settle(roles.select(*by, target, "_keep_over", "_n_minor", "_pieces"))

    fits = fits_broadcast(roles)
    narrow = rows.select(key, *by, target)
    larger, smaller = ids or (_with_draws(narrow, seed, key), narrow)
    keeps = roles.where("_keep_over").drop("_keep_over")
    redrawn = roles.where(~F.col("_keep_over")).drop("_keep_over", "_n_minor")
    piece = F.pmod(draw_int("piece", seed, F.col(key)), F.col("_pieces"))
    drawn = (
        lookup_join(larger, keeps, [*by, target], spread=key, fits=fits)
        .select(
            *by,
            (F.pmod("_draw", "_n_minor") + 1).alias("_rank"),
            F.when(F.col("_pieces") == 1, 0).otherwise(piece).alias("_piece"),
        )
        .groupBy(*by, "_rank", "_piece")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    minor = lookup_join(smaller.select(key, *by, target), redrawn, [*by, target], spread=key, fits=fits)
    minor = minor.withColumn("_key", draw_key("rank", seed, F.col(key)))
    digits = prefix_digits(_largest(roles, "_n_minor"))
    ranked = exact_rank(minor, by, "_key", name="_rank", digits=digits).select(*by, key, "_rank")
    copies = drawn.join(ranked, [*by, "_rank"]).drop("_rank")

    texts = lookup_join(rows, redrawn, [*by, target], spread=key, fits=fits).withColumn(
        "_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_pieces") - 1))
    )
    return (
        texts.join(copies, [*by, key, "_piece"])
        .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
        .withColumn("copy", F.col("_i") * F.col("_pieces") + F.col("_piece"))
        .drop("_i", "_n", "_piece", "_pieces")
    )


def undersample(rows: DataFrame, by=(), target="target", seed=RESAMPLE_SEED, key="row_id") -> DataFrame:
    """Both classes down to the smaller one's size, without replacement."""
    by = list(by)
    plan = resampling_plan(rows, by, target, seed, key).select(*by, target, "_under_cut")
    marked = lookup_join(rows, settle(plan), [*by, target], spread=key)
    return marked.where(draw_key("under", seed, F.col(key)) <= F.col("_under_cut")).drop("_under_cut")


def oversample(rows: DataFrame, by=(), target="target", seed=RESAMPLE_SEED, key="row_id", require_both=True, per_piece=COPIES_PER_PIECE) -> DataFrame:
    """The larger class whole, and the smaller one redrawn with replacement to its size.

    A group without rows of one class is an error; with ``require_both=False`` its rows are kept
    as they are.
    """
    by = list(by)
    plan = settle(resampling_plan(rows, by, target, seed, key))
    if require_both:
        _require_both_classes(plan, by)
    keep = plan.where(F.col("_keep_over") | (F.col("_n_minor") == 0)).select(*by, target)
    whole = lookup_join(rows, keep, [*by, target], spread=key).withColumn("copy", F.lit(0).cast("bigint"))
    return whole.unionByName(redrawn_rows(rows, plan, by, target, seed, key, per_piece).select(*whole.columns))


def experiments(rows: DataFrame, runs: DataFrame, by=("language", "configuration"), target="target", val_test_ratio=VAL_TEST_RATIO, seed=RESAMPLE_SEED, key="row_id", require_both=True, run_by_run=False) -> DataFrame:
    """All seven frames of every experiment as one long frame.

    Adds ``experiment``, ``variant``, ``copy`` (0 but for redrawn rows) and ``order_key``, which sorts
    the rows of each frame in a random order: by the experiment's seed in train, val and test, and by
    ``seed`` in resampled frames. Test is not resampled. The texts are read once for everything but
    the redrawn rows.

    With ``run_by_run`` the rows are stored once, group by group, and each experiment gets tasks of its
    own. Rows of a frame then lie together, and a writer need not move the many copies of a text.
    """
    by = list(by)
    seeds = _seeds(runs)
    if run_by_run:
        rows = settle_table(rows.hint("rebalance", *by) if by else rows, "experiment-rows")
    classes, groups = [*by, target], [*by, "experiment", "split"]
    ids = settle_table(_with_draws(rows.select(key, *classes), seed, key), "experiment-ids")
    cuts = _split_cuts(ids, seeds, by, target, val_test_ratio, key)

    sizes = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(f"n_{s}").alias("n_class")) for s in ("train", "val")]))
    counts = cuts.select(*classes, "experiment", sizes.alias("_s")).select(*classes, "experiment", "_s.*")
    fit_ids = _place(ids, _by_class(cuts, classes, *_CUTS), classes, key).drop("_run").where(F.col("split") != "test")
    plan = settle(resampling_plan(fit_ids, groups, target, seed, key, counts.where("n_class > 0")))
    if require_both:
        _require_both_classes(plan, groups)

    keep = F.col("_keep_over") | (F.col("_n_minor") == 0)
    of = lambda split, column: F.max(F.when(F.col("split") == split, column))
    marks = plan.groupBy(*classes, "experiment").agg(
        *[of(s, F.col("_under_cut")).alias(f"_{s}_under") for s in ("train", "val")],
        *[of(s, keep).alias(f"_{s}_whole") for s in ("train", "val")],
    )
    marked = cuts.join(marks, [*classes, "experiment"], "left")
    steering = _by_class(marked, classes, *_CUTS, *[c for c in marks.columns if c not in (*classes, "experiment")])
    keyed = rows.withColumn("_under_key", draw_key("under", seed, F.col(key)))
    placed = _place(keyed, steering, classes, key, len(seeds) if run_by_run else 0)

    split = F.col("split")
    mine = lambda mark: F.when(split == "train", F.col(f"_run._train_{mark}")).when(split == "val", F.col(f"_run._val_{mark}"))
    frames = F.array(
        split,
        F.when(F.col("_under_key") <= mine("under"), F.concat(split, F.lit("_undersampling"))),
        F.when(mine("whole"), F.concat(split, F.lit("_oversampling"))),
    )
    # A filter after explode() stays in generated code; array_compact() before it would not.
    once = (
        placed.withColumn("variant", F.explode(frames))
        .where(F.col("variant").isNotNull())
        .withColumn(ORDER, frame_key(F.col("variant"), F.when(F.col("variant") == split, F.col("_run.seed")).otherwise(F.lit(seed)), key))
        .drop("_under_key", "_run", "split")
        .withColumn("copy", F.lit(0).cast("bigint"))
    )

    def in_role(source, role):
        """Rows of the classes that have a role in some split, in the runs where they have it."""
        has_role = plan.where(role & (F.col("_n_minor") > 0)).select(*classes, "experiment").distinct()
        mine = cuts.join(has_role, [*classes, "experiment"], "left_semi")
        return _place(source, _by_class(mine, classes, *_CUTS), classes, key).drop("_run").where(split != "test")

    larger, smaller = F.col("_keep_over"), ~F.col("_keep_over")
    pair = in_role(ids, larger), in_role(ids.drop("_draw"), smaller)
    again = redrawn_rows(in_role(rows, smaller), plan, groups, target, seed, key, ids=pair)
    again = again.withColumn("variant", F.concat(split, F.lit("_oversampling"))).drop("split")
    again = again.withColumn(ORDER, frame_key(F.col("variant"), seed, key, F.col("copy")))
    return once.unionByName(again.select(*once.columns))


def shuffled(rows: DataFrame, by=(), seed=RESAMPLE_SEED, key="row_id", copy=None) -> DataFrame:
    """Add the seeded ``shuffle_key`` and the ``position`` it gives a row in its group. No group may be null, and no key twice in one."""
    parts = [F.col(key)] + ([F.col(copy)] if copy else [])
    keyed = rows.withColumn("shuffle_key", draw_key("order", seed, *parts))
    sizes = _class_sizes_of(keyed, list(by), list(by), "shuffle_key")
    return exact_rank(keyed, list(by), "shuffle_key", name="position", digits=prefix_digits(_largest(sizes, "n_class")))
