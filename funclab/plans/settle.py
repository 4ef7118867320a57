"""Small tables that steer a big pass: written once, checked for size, then broadcast.

A table of cuts, totals or prompt blocks has a row per group and experiment. It is nearly always
tiny, but nothing proves it, so it is counted before it is broadcast; when it is over the bound
the same join runs as a salted shuffle join.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# A listed run of an experiment: ids and a few 32-digit cuts.
BYTES_PER_LISTED = 256
SALTS = 64


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a new local folder. Any other master is an error, as its
    executors would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not _is_local(spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="funclab-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute a small table once and cut its lineage; a lost executor costs a re-read, not a re-run."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def set_for_now(spark: SparkSession, settings: dict[str, str]):
    """Settings of the session that hold inside the block."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_settled(df: DataFrame, path: str, by=(), records=None, compression=None) -> None:
    """Write a table as Parquet, and let go of the shuffle files of its query, which nothing reads again.

    ``records`` bounds the rows of an Arrow batch, for rows that hold texts or lists; a lower bound
    of the session holds.
    """
    spark, batch = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if records and not 0 < int(spark.conf.get(batch)) < records:
        settings[batch] = str(records)
    with set_for_now(spark, settings):
        df.write.partitionBy(*by).parquet(path, compression=compression)


def settle_table(df: DataFrame, name: str, records=None, compression=None) -> DataFrame:
    """The same for a table that grows with the data: written as Parquet in the shared folder.

    Later passes read only the columns they use. The folder is not removed here.
    """
    path = scratch_path(df.sparkSession, name)
    write_settled(df, path, records=records, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def each_number(stored: DataFrame, n: int, name: str) -> DataFrame:
    """Each row once for each number from 0 to n - 1, and each number in tasks of its own.

    Rows stay where they lie and are read once per number, so give a stored table. A task that writes
    its rows by number then holds one part of the table, not n times that.
    """
    numbers = stored.sparkSession.range(0, n, 1, n).select(F.col("id").cast("int").alias(name))
    return stored.crossJoin(numbers.hint("shuffle_replicate_nl"))


def fits_broadcast(settled: DataFrame, max_rows=None, max_bytes=None) -> bool:
    """True where the rows, and the texts and lists in them, are within the bounds."""
    widths = [F.octet_length(name) for name, kind in settled.dtypes if kind == "string"]
    widths += [F.size(name) * BYTES_PER_LISTED for name, kind in settled.dtypes if kind.startswith("array")]
    text = sum((F.coalesce(w, F.lit(0)).cast("bigint") for w in widths), F.lit(0).cast("bigint"))
    rows, size = settled.agg(F.count(F.lit(1)), F.coalesce(F.sum(text), F.lit(0))).first()
    return rows <= (max_rows or MAX_BROADCAST_ROWS) and size <= (max_bytes or MAX_BROADCAST_BYTES)


def free_name(name: str, *frames: DataFrame) -> str:
    """A column name like ``name`` that no frame has; Spark does not tell upper case from lower."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lookup_join(rows: DataFrame, settled: DataFrame, on, how="inner", spread="row_id", fits=None, once=False) -> DataFrame:
    """Join rows of any number with a settled table that is expected to be small.

    Within the bounds the table is broadcast and the rows stay where they are. Beyond them both
    sides are shuffled, and as one key may hold a third of all rows, each key is cut into
    ``SALTS`` parts by the ``spread`` column and the table is repeated for each part. Spark sizes
    the repeated table as if each row stood there once and may broadcast it, hence the hint. ``fits``
    tells the outcome of the check where the caller has it, as for a part of a checked table.

    With ``once`` the table has one row for each key, and is shuffled as it is: the rows of a key
    that very many share lie on one side alone, where a skewed join is split.
    """
    on = list(on)
    if fits_broadcast(settled) if fits is None else fits:
        return rows.join(F.broadcast(settled), on, how)
    if once:
        return rows.join(settled.hint("merge"), on, how)
    salt = free_name("_salt", rows, settled)
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    repeated = settled.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated.hint("merge"), [*on, salt], how).drop(salt)
