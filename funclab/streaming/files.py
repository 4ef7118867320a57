"""Row-wise operators on files that keep arriving.

A run takes what has arrived since the last one, in micro-batches of a few files, and ends. Its
checkpoint holds which files a batch has taken, and the sink which batches it holds; so a batch that
is repeated after a failure takes the same files and is written once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new_files(spark: SparkSession, source: str, schema, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_batch: int = 1_000, timeout: int | None = None) -> DataFrame:
    """Apply ``work`` to new Parquet files of ``source`` and add the rows to the table at ``sink``; all of it is returned.

    ``work`` must be row-wise (``preprocess``, ``strip_comments``, ``fine_tuning_chats``, ``ask``, ...), as rows
    of different batches never meet. Sink and checkpoint belong together and to one ``work``; both lie in
    storage that all executors share. ``timeout`` is in seconds, beyond which the run is stopped and
    an error raised; the next one goes on where it ended.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = (
        work(stream)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    ended = query.awaitTermination(timeout) if timeout else query.awaitTermination() is None
    if not ended:
        query.stop()
        raise TimeoutError(f"files of {source} took more than {timeout} seconds")
    # The sink's own log tells which files are whole.
    return spark.read.parquet(sink)
