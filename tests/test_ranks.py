from pyspark.sql import Window
from pyspark.sql import functions as F

from funclab.functions.hashing import draw_int, draw_key
from funclab.plans import settle as settling
from funclab.plans.ranks import exact_rank, key_cuts, prefix_digits


def rows(spark, n=4000):
    return spark.range(n).select("id", (F.col("id") % 3 == 0).cast("int").alias("g"), draw_key("t", F.col("id")).alias("key"))


def test_exact_rank_equals_a_window(spark):
    df = rows(spark)
    plain = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("key")))
    for digits in (1, 3):
        mine = exact_rank(df, ["g"], "key", digits=digits).select("id", "rank")
        assert mine.exceptAll(plain.select("id", "rank")).count() == 0 and mine.count() == 4000


def test_key_cuts_are_order_statistics(spark):
    df = rows(spark)
    wanted = spark.createDataFrame([(0, 1), (0, 2666), (1, 700), (1, 701), (1, 999999)], "g int, rank long")
    got = {(r.g, r["rank"]): r.cut for r in key_cuts(df, ["g"], "key", wanted, digits=2).collect()}
    keys = {g: sorted(r.key for r in df.where(F.col("g") == g).collect()) for g in (0, 1)}
    assert got == {(g, k): keys[g][k - 1] for g, k in [(0, 1), (0, 2666), (1, 700), (1, 701)]}


def test_digits_follow_the_group_size():
    assert [prefix_digits(n) for n in (0, 131_072, 131_073, 10**9, 10**12)] == [1, 1, 2, 5, 5]


def test_draws_are_stable_and_not_negative(spark):
    got = spark.range(1000).select(draw_int("a", 1, F.col("id")).alias("d"))
    again = spark.range(1000).repartition(7).select(draw_int("a", 1, F.col("id")).alias("d"))
    assert got.exceptAll(again).count() == 0
    assert got.where("d < 0").count() == 0 and got.distinct().count() == 1000


def test_only_checked_tables_are_broadcast(spark, monkeypatch):
    big, small = rows(spark), settling.settle(rows(spark, 300).select("key", F.lit(1).alias("found")))
    assert settling.fits_broadcast(small)
    assert not settling.fits_broadcast(small, max_rows=299)
    assert not settling.fits_broadcast(small, max_bytes=300 * 32 - 1)
    plain = settling.lookup_join(big, small, ["key"], "left", spread="id")
    assert "BroadcastHashJoin" in plain._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(settling, "MAX_BROADCAST_ROWS", 10)
    for how in ("inner", "left", "left_semi", "left_anti"):
        salted = settling.lookup_join(big, small, ["key"], how, spread="id")
        assert "_salt" in salted._jdf.queryExecution().analyzed().toString()
        want = big.join(small, ["key"], how)
        assert salted.columns == want.columns
        assert salted.exceptAll(want).count() == 0 and salted.count() == want.count()


def test_a_repeated_table_is_never_broadcast(spark, monkeypatch):
    """Spark takes a table for as small as its file, though its rows are repeated for each salt."""
    monkeypatch.setattr(settling, "MAX_BROADCAST_ROWS", 10)
    small = settling.settle_table(rows(spark, 300).select("key", F.lit(1).alias("found")), "small")
    for how in ("inner", "left", "left_semi", "left_anti"):
        salted = settling.lookup_join(rows(spark), small, ["key"], how, spread="id")
        assert salted.count() == rows(spark).join(small, ["key"], how).count()
        plan = salted._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_a_table_with_a_row_for_each_key_is_not_repeated(spark, monkeypatch):
    monkeypatch.setattr(settling, "MAX_BROADCAST_ROWS", 10)
    small = settling.settle_table(rows(spark, 300).select("key", F.lit(1).alias("found")), "small")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got, want = settling.lookup_join(rows(spark), small, ["key"], how, once=True), rows(spark).join(small, ["key"], how)
        assert got.columns == want.columns and got.count() == want.count() and got.exceptAll(want).count() == 0
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Broadcast", "Generate", "_salt")) and "SortMergeJoin" in plan


def test_shared_folder_is_the_one_the_session_names(spark):
    assert settling.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert settling.scratch_path(spark, "x") != settling.scratch_path(spark, "x")


def test_a_lookup_keeps_columns_of_any_name(spark, monkeypatch):
    """Beyond the bound of a broadcast both sides are salted, by a column that neither has."""
    from funclab.plans import settle as settling

    monkeypatch.setattr(settling, "MAX_BROADCAST_ROWS", 1)
    rows = spark.createDataFrame([(i, i % 3, f"s{i}", i) for i in range(30)], "row_id long, k long, salt string, _SALT long")
    table = settling.settle(spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string"))
    got = settling.lookup_join(rows, table, ["k"], "left").collect()
    assert sorted((r.row_id, r.salt, r["_SALT"], r.v) for r in got) == [(i, f"s{i}", i, {0: "a", 1: "b"}.get(i % 3)) for i in range(30)]
