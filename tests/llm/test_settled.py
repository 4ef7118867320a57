"""What settled tables leave behind, and the size of lists that are looked up."""

import glob
import os

from pyspark.sql import functions as F

from funclab.llm import suffix_dedup as sd
from funclab.plans import settle


def shuffle_bytes(spark):
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(os.path.getsize(f) for d in top for f in glob.glob(f"{d}/*/shuffle_*.data"))


def test_a_settled_table_leaves_no_shuffle_files(spark):
    rows = spark.range(200_000).select(F.xxhash64("id").alias("k"))
    before, setting = shuffle_bytes(spark), "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(setting)
    assert settle.settle_table(rows.groupBy("k").count(), "counted", records=100).count() == 200_000
    # Files of earlier queries may go meanwhile; those of this one would be some 2 MB.
    assert shuffle_bytes(spark) < before + 500_000
    assert spark.conf.get(setting) == held


def test_a_run_is_one_span(spark):
    text = "".join(chr(97 + (i * i // 7 + i // 3) % 26) for i in range(3_000))
    docs = spark.createDataFrame([(1, text), (2, text + "!"), (3, "other")], "doc_id long, text string")
    found = sd.repeated(docs).select("spans").collect()
    assert [[(x["at"] - x["high"], x["at"] - x["low"] + sd.LENGTH) for x in r["spans"]] for r in found] == [[(0, 3_000)]] * 2


def test_lists_beyond_the_bounds_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(sd, "MAX_ROWS", 0)
    text = "".join(chr(97 + (i * i // 7 + i // 3) % 26) for i in range(1_000))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text + "!"), (3, None)], "doc_id long, text string")
    out = sd.summary(docs)
    assert "_salt" not in out._jdf.queryExecution().toString()
    assert sorted((r["doc_id"], r["n_removed"], r["n_spans"]) for r in out.collect()) == [(1, 1_000, 1), (1, 1_000, 1), (2, 1_000, 1), (3, 0, 0)]
