"""Packing of token ids into windows of fixed length, with a bounded number of open windows.

Each partition keeps ``open_windows`` windows open. A document's ids go to the window that they
fill best. Where none has room, the fullest window is topped up with the first part of the ids and
emitted, and the rest is placed in the same way; ids of a full window's length are a window by
themselves. What is still open at a partition's end is merged: groups of partitions fill windows
from each other's leftovers, then groups of groups, until one unfilled window is left over all.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funclab.llm.common import scratch_path
from funclab.llm.tokens import encoder
from funclab.plans.settle import write_settled

WINDOW = 4096
OPEN_WINDOWS = 32
#: Partitions, or groups of them, whose leftovers one task merges: at most 64 x 32 windows of ids.
MERGED = 64
#: Rows of an Arrow batch of texts.
RECORDS = 1_000
#: Parts of words that a worker keeps, at most twice. Workers share their executor with what earlier steps left in its JVM.
KEPT = 300_000
_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_HELD = f"{_OUT}, part long, ids binary"


class _Packer:
    """The open windows of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window, limit, first_id):
        self.window, self.limit, self.next_id = window, limit, first_id
        self.open: list[list] = []  # [used, pieces]
        self.rows: list[tuple] = []

    def emit(self, pieces, part=None):
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            kept = None if part is None else ids
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next_id, offset, part, kept))
            offset += n
        self.next_id += 1

    def place(self, doc_id, start, ids, total):
        full = 4 * self.window
        at = 0
        while len(ids) - at >= full:
            self.emit([(doc_id, start + at // 4, ids[at : at + full], total)])
            at += full
        while at < len(ids):
            n = (len(ids) - at) // 4
            best = min((w for w in self.open if self.window - w[0] >= n), key=lambda w: self.window - w[0], default=None)
            if best is None and len(self.open) < self.limit:
                best = [0, []]
                self.open.append(best)
            if best is None:
                best = max(self.open, key=lambda w: w[0])
                n = self.window - best[0]
            best[0] += n
            best[1].append((doc_id, start + at // 4, ids[at : at + 4 * n], total))
            at += 4 * n
            if best[0] == self.window:
                self.open.remove(best)
                self.emit(best[1])

    def taken(self):
        rows, self.rows = self.rows, []
        return rows


def _batch(rows):
    import pyarrow as pa

    kinds = [pa.int64()] * 8 + [pa.binary()]
    names = [c.split()[0] for c in _HELD.split(", ")]
    columns = list(zip(*rows)) or [()] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _first_id(level, part):
    return (level << 58) | (part << 30)


def _pack_partition(path, end_id, window, limit):
    end = int(end_id).to_bytes(4, "little")

    def pack(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc, packer = encoder(path, False, KEPT), _Packer(window, limit, _first_id(0, part))
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py()) + end
                packer.place(doc_id, 0, ids, len(ids) // 4)
                if len(packer.rows) >= 20_000:
                    yield _batch(packer.taken())
        for _, pieces in packer.open:
            packer.emit(pieces, part)
        yield _batch(packer.taken())

    return pack


def _merge_group(level, last, window):
    """Fill windows from the leftovers of a group, fullest first; the last one stays for the next level."""

    def merge(key, table):
        import pandas as pd

        part = int(key[0])
        packer = _Packer(window, 1, _first_id(level, part))
        table = table.assign(_used=table.groupby("sequence_id")["length"].transform("sum"))
        table = table.sort_values(["_used", "sequence_id", "offset"], ascending=[False, True, True])
        for row in table.itertuples(index=False):
            doc_id = None if pd.isna(row.doc_id) else int(row.doc_id)
            ids, start = row.ids, int(row.start)
            while ids:  # cut only where a window ends
                room = 4 * (window - (packer.open[0][0] if packer.open else 0))
                packer.place(doc_id, start, ids[:room], int(row.doc_tokens))
                start, ids = start + room // 4, ids[room:]
        for _, pieces in packer.open:
            packer.emit(pieces, None if last else part)
        return pd.DataFrame(packer.taken(), columns=[c.split()[0] for c in _HELD.split(", ")]).astype(
            {"doc_id": "Int64", "part": "Int64", **{c: "int64" for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}}
        )

    return merge


def pack(
    docs: DataFrame, vocabulary: str, end_id=2, window=WINDOW, open_windows=OPEN_WINDOWS, key="doc_id", text="text"
) -> DataFrame:
    """One row for each piece of a document in a window.

    ``start`` counts the document's ids before the piece, ``offset`` the window's. Only one window
    over all rows is not full. A null or empty text has the end id alone; rows with a null or
    repeated key are documents of their own; other columns are not read; an empty table gives no
    row. Texts are read in one pass without a shuffle, and only leftovers, a fixed number of
    windows for each partition, carry their ids on.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    where = scratch_path(spark, "packed")
    write_settled(rows.mapInArrow(_pack_partition(vocabulary, end_id, window, open_windows), _HELD), f"{where}/0", records=RECORDS)
    held = spark.read.schema(_HELD).parquet(f"{where}/0")
    done = [held.filter("part is null")]
    level, open_ = 0, held.filter("part is not null")
    parts = open_.agg(F.max("part")).first()[0]
    while parts is not None:
        level, last = level + 1, parts < MERGED
        grouped = open_.withColumn("part", F.expr(f"part div {MERGED}")).groupBy("part")
        grouped.applyInPandas(_merge_group(level, last, window), _HELD).write.parquet(f"{where}/{level}")
        held = spark.read.schema(_HELD).parquet(f"{where}/{level}")
        done.append(held.filter("part is null"))
        open_, parts = held.filter("part is not null"), None if last else parts // MERGED
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("part", "ids")
