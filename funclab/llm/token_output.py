"""Token ids as raw binary shards with a minimal perfect hash index over document keys.

Format. A shard is the ids of its documents one after the other, little-endian, unsigned 16-bit
where the vocabulary has at most 65,536 ids, else 32-bit; nothing else is in it. The index is cut
into buckets by a hash of the key. A bucket file holds a minimal perfect hash (levels of bit
arrays: a key's place is the rank of the first bit that it alone has set) and, at each place, a
32-bit fingerprint of the key, shard, first id in the shard and number of ids. Fetching a key
reads one place of one bucket and one range of one shard, whatever the number of documents.

Tasks write under names of their own and report them in a manifest that Spark commits, so files of
a lost or repeated task are never read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funclab.llm.common import new_name, scratch_path, store_at
from funclab.llm.tokens import encoder

MAGIC = b"TOKIDX01"
#: Keys of an index bucket, about.
BUCKET_KEYS = 100_000
#: Bits of a level for each key that it has to place.
GAMMA = 2.0
_ENTRIES = "shard int, file string, key long, copy long, hash long, first long, length long"
_SHARDS = "shard int, file string, n_docs long, n_ids long"
_BUCKETS = "bucket int, file string, n_keys long"
_ENTRY = np.dtype([("mark", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("length", "<u8")])


def mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of 64-bit integers (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hash(keys, copies) -> np.ndarray:
    """Hash of a key and its copy number; a null key has a value of its own."""
    raw = np.array([0 if k is None else k for k in keys], np.int64).astype(np.uint64)
    null = np.array([k is None for k in keys], bool)
    return mixed(mixed(raw, 1) ^ mixed(np.asarray(copies, np.uint64), 2) ^ np.where(null, np.uint64(0x5851F42D4C957F2D), np.uint64(0)), 3)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit hashes: ``place`` maps them onto 0 .. n-1."""

    def __init__(self, levels):
        self.levels = levels  # (number of bits, packed bits)
        self.words = [np.frombuffer(b.tobytes() + b"\0" * (-len(b) % 8), np.uint8) for _, b in levels]
        self.ranks, before = [], 0
        for packed in self.words:
            counts = np.bitwise_count(packed).astype(np.int64)
            self.ranks.append(before + np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts)
            before += int(counts.sum())
        self.size = before

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("keys of an index must be distinct")
        left, levels = hashes, []
        while len(left):
            n = max(64, int(GAMMA * len(left)))
            at = (mixed(left, 10 + len(levels)) % np.uint64(n)).astype(np.int64)
            alone = np.bincount(at, minlength=n) == 1
            levels.append((n, np.packbits(alone, bitorder="little")))
            left = left[~alone[at]]
        return cls(levels)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """A place for each hash; one that was not built in gets -1 or another's place."""
        out, open_ = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for k, (n, _) in enumerate(self.levels):
            at = (mixed(hashes[open_], 10 + k) % np.uint64(n)).astype(np.int64)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            cell = self.words[k][byte]
            hit = (cell >> bit) & 1 == 1
            below = np.bitwise_count(cell & ((np.uint8(1) << bit) - np.uint8(1))).astype(np.int64)
            out[open_[hit]] = (self.ranks[k][byte] + below)[hit]
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *(n for n, _ in self.levels)], "<u8").tobytes()
        return head + b"".join(b.tobytes() for _, b in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes, at: int):
        count = int(np.frombuffer(data, "<u8", 1, at)[0])
        sizes = np.frombuffer(data, "<u8", count, at + 8).astype(int)
        at, levels = at + 8 * (1 + count), []
        for n in sizes:
            packed = np.frombuffer(data, np.uint8, -(-n // 8), at)
            levels.append((n, packed))
            at += len(packed)
        return cls(levels), at


def bucket_bytes(hashes, shards, firsts, lengths) -> bytes:
    """An index bucket as it is written."""
    table, entries = PerfectHash.build(hashes), np.zeros(len(hashes), _ENTRY)
    at = table.place(hashes)
    entries["mark"][at] = (hashes >> np.uint64(32)).astype(np.uint32)
    entries["shard"][at], entries["first"][at], entries["length"][at] = shards, firsts, lengths
    return MAGIC + table.to_bytes() + entries.tobytes()


def look_up(data: bytes, hashes: np.ndarray):
    """Entries of the hashes in a bucket, and which of them are there."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not an index bucket")
    table, at = PerfectHash.from_bytes(data, len(MAGIC))
    entries = np.frombuffer(data, _ENTRY, table.size, at)
    place = table.place(hashes)
    if not table.size:
        return np.zeros(len(hashes), _ENTRY), np.zeros(len(hashes), bool)
    found = entries[np.maximum(place, 0)]
    return found, (place >= 0) & (found["mark"] == (hashes >> np.uint64(32)).astype(np.uint32))


def id_width(kind) -> int:
    return np.dtype(kind).itemsize


def _write_shard(path, spaced, end_id, where):
    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, part = encoder(path, spaced), TaskContext.get().partitionId()
        kind = "<u2" if enc.vocabulary <= 65536 else "<u4"
        end = np.array([end_id], kind).tobytes()
        store, folder = store_at(where)
        file = f"shard-{part:06d}-{new_name()}.bin"
        out, keys, lengths = None, [], []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(enc.encode(text.as_py()), "<u4").astype(kind).tobytes() + end
                if out is None:
                    out = store.open_output_stream(f"{folder}/{file}")
                out.write(ids)
                keys.append(key)
                lengths.append(len(ids) // id_width(kind))
        if out is None:
            return
        out.close()
        copies, seen = np.zeros(len(keys), np.int64), None
        for i, key in enumerate(keys):  # in key order, so copies are neighbours
            copies[i] = copies[i - 1] + 1 if i and key == seen else 0
            seen = key
        firsts = np.cumsum([0, *lengths[:-1]])
        n = len(keys)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part] * n, pa.int32()),
                pa.array([file] * n),
                pa.array(keys, pa.int64()),
                pa.array(copies),
                pa.array(key_hash(keys, copies).view(np.int64)),
                pa.array(firsts, pa.int64()),
                pa.array(lengths, pa.int64()),
            ],
            names=["shard", "file", "key", "copy", "hash", "first", "length"],
        )

    return write


def _write_bucket(where):
    def write(key, table):
        import pandas as pd

        store, folder = store_at(where)
        file = f"index-{int(key[0]):06d}-{new_name()}.idx"
        data = bucket_bytes(table["hash"].to_numpy().view(np.uint64), table["shard"], table["first"], table["length"])
        with store.open_output_stream(f"{folder}/{file}") as out:
            out.write(data)
        return pd.DataFrame({"bucket": [int(key[0])], "file": [file], "n_keys": [len(table)]})

    return write


class TokenStore:
    """A written store: ``write`` makes one, ``fetch`` reads documents of a table of keys."""

    def __init__(self, spark, where: str):
        self.spark, self.where = spark, where
        self.shards = spark.read.schema(_SHARDS).parquet(f"{where}/shards").orderBy("shard").collect()  # a row for each file
        self.buckets = spark.read.schema(_BUCKETS).parquet(f"{where}/buckets").collect()
        self.layout = spark.read.parquet(f"{where}/layout").first()

    @classmethod
    def write(cls, docs, vocabulary, end_id, where=None, spaced=True, key="doc_id", text="text") -> TokenStore:
        """Encode whole texts and write them in ascending key order, nulls first.

        A null text has the end id alone. A repeated key's documents stand side by side, ordered by
        a hash of their text, and are copies 0, 1, ... of the key. Other columns are not read.
        """
        spark = docs.sparkSession
        where = where or scratch_path(spark, "tokens")
        rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
        rows = rows.repartitionByRange("key").sortWithinPartitions("key", F.xxhash64("text"))
        store, folder = store_at(where)
        store.create_dir(folder, recursive=True)
        rows.mapInArrow(_write_shard(vocabulary, spaced, end_id, where), _ENTRIES).write.parquet(f"{where}/entries")
        entries = spark.read.schema(_ENTRIES).parquet(f"{where}/entries")
        shards = entries.groupBy("shard", "file").agg(F.count("*").alias("n_docs"), F.sum("length").alias("n_ids"))
        shards.coalesce(1).write.parquet(f"{where}/shards")
        counted = spark.read.schema(_SHARDS).parquet(f"{where}/shards").agg(F.sum("n_docs")).first()
        n_buckets = -(-(counted[0] or 0) // BUCKET_KEYS) or 1
        from tokenizers import Tokenizer

        wide = Tokenizer.from_file(vocabulary).get_vocab_size() > 65536
        layout = [(n_buckets, 4 if wide else 2)]
        spark.createDataFrame(layout, "n_buckets int, id_bytes int").coalesce(1).write.parquet(f"{where}/layout")
        bucket = F.pmod(F.shiftrightunsigned("hash", 7), F.lit(n_buckets)).cast("int")
        grouped = entries.select("hash", "shard", "first", "length", bucket.alias("bucket")).groupBy("bucket")
        made = grouped.applyInPandas(_write_bucket(where), _BUCKETS)
        made.write.parquet(f"{where}/buckets")
        return cls(spark, where)

    def fetch(self, keys: DataFrame, with_ids=False) -> DataFrame:
        """key, copy, start, n_tokens and ids_crc32 (with ``with_ids`` the ids) of each key and copy asked for.

        ``keys`` has columns key and copy. Keys that the store lacks give no row (a key whose
        32-bit fingerprint is met by chance could give another's).
        """
        where, n_buckets, width = self.where, self.layout["n_buckets"], self.layout["id_bytes"]
        files = {r["bucket"]: r["file"] for r in self.buckets}
        shards = {r["shard"]: r["file"] for r in self.shards}
        before, bases = 0, {}
        for r in self.shards:
            bases[r["shard"]], before = before, before + r["n_ids"]

        def hashed(batches):
            import pyarrow as pa

            for b in batches:
                h = key_hash(b.column(0).to_pylist(), b.column(1).to_pylist())
                at = ((h >> np.uint64(7)) % np.uint64(n_buckets)).astype(np.int32)
                arrays = [b.column(0), b.column(1), pa.array(h.view(np.int64)), pa.array(at)]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "copy", "hash", "bucket"])

        def found(batches):
            import pyarrow as pa

            store, folder = store_at(where)
            held = (None, None)
            for b in batches:
                h, bucket = b.column("hash").to_numpy().view(np.uint64), b.column("bucket").to_numpy()
                for k in np.unique(bucket):
                    if k not in files:
                        continue
                    if held[0] != k:
                        held = (k, store.open_input_stream(f"{folder}/{files[k]}").read())
                    mine = np.flatnonzero(bucket == k)
                    entries, there = look_up(held[1], h[mine])
                    entries, rows = entries[there], b.take(pa.array(mine[there]))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("key"), rows.column("copy"), *(pa.array(entries[c].astype(np.int64)) for c in ("shard", "first", "length"))],
                        names=["key", "copy", "shard", "first", "length"],
                    )

        def read(batches):
            import pyarrow as pa

            store, folder = store_at(where)
            shard, file = None, None
            for b in batches:
                out = []
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    key, copy, at, first, length = row
                    if shard != at:
                        shard, file = at, store.open_input_file(f"{folder}/{shards[at]}")
                    ids = np.frombuffer(file.read_at(length * width, first * width), f"<u{width}").astype("<u4").tobytes()
                    out.append((key, copy, bases[at] + first, length, zlib.crc32(ids), ids if with_ids else None))
                kinds = [pa.int64()] * 5 + [pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "copy", "start", "n_tokens", "ids_crc32", "ids"])

        asked = keys.select(F.col("key").cast("long"), F.col("copy").cast("long"))
        asked = asked.mapInArrow(hashed, "key long, copy long, hash long, bucket int").repartition("bucket").sortWithinPartitions("bucket")
        placed = asked.mapInArrow(found, "key long, copy long, shard long, first long, length long")
        placed = placed.repartition("shard").sortWithinPartitions("shard", "first")
        out = placed.mapInArrow(read, "key long, copy long, start long, n_tokens long, ids_crc32 long, ids binary")
        return out if with_ids else out.drop("ids")

    def keys(self) -> DataFrame:
        """All keys and copies that were written."""
        return self.spark.read.schema(_ENTRIES).parquet(f"{self.where}/entries").select("key", "copy")
