"""Row-wise operators run on a stream without change."""

from pyspark.sql import functions as F

from funclab.functions import comments, responses
from funclab.operators.finetune import fine_tuning_chats


def test_row_wise_operators_on_a_stream(spark, tmp_path):
    rows = [(i, "rust", f"a {i} // b\n/* c /* d */ */ e", i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "row_id int, language string, processed_func string, target int")
    df.repartition(4).write.parquet(f"{tmp_path}/in")

    def work(frame):
        chats = fine_tuning_chats(comments.strip_comments(frame))
        answer = F.col("messages")[2]["content"]
        return chats.withColumn("label", responses.response_label(answer)).select("row_id", "processed_func", "label", "messages")

    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = work(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    want = work(df)
    assert got.count() == 20 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.where(F.col("label") != F.col("row_id") % 2).count() == 0


def test_runs_take_new_files_and_a_repeated_batch_is_written_once(spark, tmp_path):
    from funclab.streaming.files import process_new_files

    def arrive(first):
        rows = [(i, "rust", f"a {i} // b") for i in range(first, first + 10)]
        spark.createDataFrame(rows, "row_id int, language string, processed_func string").repartition(2).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        return process_new_files(
            spark, f"{tmp_path}/in", "row_id int, language string, processed_func string", comments.strip_comments, f"{tmp_path}/out", f"{tmp_path}/cp", files_per_batch=1, timeout=120
        )

    arrive(0)
    assert sorted(r.row_id for r in run().collect()) == list(range(10))
    arrive(10)
    assert sorted((r.row_id, r.processed_func) for r in run().collect()) == [(i, f"a {i} ") for i in range(20)]
    # As if the last run had died between writing a batch and noting that it was done.
    commits = sorted(int(f.name) for f in (tmp_path / "cp" / "commits").iterdir() if f.name.isdigit())
    assert len(commits) >= 4
    for name in (f"{commits[-1]}", f".{commits[-1]}.crc"):
        (tmp_path / "cp" / "commits" / name).unlink(missing_ok=True)
    assert sorted(r.row_id for r in run().collect()) == list(range(20))
