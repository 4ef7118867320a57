"""Removal of long repeated byte strings by bucket-pointer refinement over sampled suffixes.

A bucket is the set of positions that begin with one string, and its identifier is made from those
of two buckets at earlier depth: that of a position, and that of a later offset. Doubling gives
identifiers of 64-byte strings at every position; longer ones are made from them where needed.

Of the suffixes only a sample is sorted into buckets across documents. Every string of ``length``
bytes belongs to the suffix at its smallest 64-byte bucket (the last one, of equals), so that equal
strings belong to equal buckets at equal distance. Buckets are then refined until each holds whole
strings: first by the bytes that all strings of a suffix cover together, next by groups of 16
neighbouring strings, then one by one. After each step a bucket of one suffix is done, its strings
stand nowhere else, and a bucket whose strings are all repeated is done too; only what is mixed,
mostly at the ends of repeats, is refined further.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funclab.llm.common import free_name, settle_table, tidy

LENGTH = 400
GRAM = 64
STEP = 16
#: Bytes of texts that a task looks at together.
TOGETHER = 1 << 18
#: Rows of an Arrow batch of texts.
RECORDS = 1_000
#: A list by document is broadcast within these bounds, else joined by a shuffle.
MAX_ROWS, MAX_SPANS = 200_000, 3_000_000
_NODES = "row long, at int, low int, high int, core long, whole long"
_SPANS = "array<struct<at:int,low:int,high:int>>"
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


def _join(first, later):
    """Identifier of two neighbouring or overlapping strings from theirs."""
    with np.errstate(over="ignore"):
        x = first * _A + (later ^ (later >> np.uint64(29))) * _B
        return (x ^ (x >> np.uint64(32))) * _C


def gram_ids(data: np.ndarray) -> np.ndarray:
    """Identifier of the 64 bytes from each position; none for the last 63."""
    with np.errstate(over="ignore"):
        ids = (data.astype(np.uint64) + np.uint64(1)) * _C
    size = 1
    while size < GRAM:
        ids = _join(ids[:-size], ids[size:])
        size *= 2
    return ids


def string_ids(grams: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Identifiers of strings of ``length`` bytes, at least 64, at the starts."""
    out = np.empty(len(start), np.uint64)
    depth = GRAM
    left = np.arange(len(start))

    def at(where, size):
        return grams[where] if size == GRAM else _join(at(where, size // 2), at(where + size // 2, size // 2))

    while len(left):
        mine = left[length[left] < 2 * depth]
        s, n = start[mine], length[mine]
        with np.errstate(over="ignore"):
            out[mine] = _join(_join(at(s, depth), at(s + n - depth, depth)), n.astype(np.uint64) * _A)
        left, depth = left[length[left] >= 2 * depth], 2 * depth
    return out


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        keys, size = np.minimum(keys[:-size], keys[size:]), 2 * size
    return np.minimum(keys[: len(keys) - (width - size)], keys[width - size :]) if width > size else keys


def sampled(grams: np.ndarray, ends: np.ndarray, starts: np.ndarray, length=LENGTH):
    """Suffixes that strings belong to: position, and first and last start of its strings."""
    low32 = np.uint64(0xFFFFFFFF)
    keys = (grams & ~low32) | (low32 - np.arange(len(grams), dtype=np.uint64))
    width = length - GRAM + 1
    if len(keys) < width:
        return (np.zeros(0, np.int64),) * 3
    at = (low32 - (_least(keys, width) & low32)).astype(np.int64)
    inside = np.zeros(len(at), bool)
    for s, e in zip(starts, ends):  # strings that leave their document are none
        inside[s : max(s, e - length + 1)] = True
    p = np.flatnonzero(inside)
    if not len(p):
        return (np.zeros(0, np.int64),) * 3
    new = np.flatnonzero((np.diff(at[p], prepend=-1) != 0) | (np.diff(p, prepend=-2) != 1))
    return at[p][new], p[new], p[np.append(new[1:], len(p)) - 1]


def _grouped(batches, key, text, extra=None):
    """Documents of a task, some at a time: their rows, bytes and lists."""
    rows, parts, lists, held = [], [], [], 0
    for b in batches:
        more = b.column(extra).to_pylist() if extra is not None else [None] * b.num_rows
        for r, t, x in zip(b.column(key).to_pylist(), b.column(text), more):
            data = t.as_py()
            data = data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data or b""
            rows.append(r)
            parts.append(data)
            lists.append(x)
            held += len(data)
            if held >= TOGETHER:
                yield rows, parts, lists
                rows, parts, lists, held = [], [], [], 0
    if rows:
        yield rows, parts, lists


def _laid_out(parts):
    data = np.frombuffer(b"".join(parts) + b"\0" * GRAM, np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    return gram_ids(data), ends - [len(p) for p in parts], ends


def _node_batch(row, at, low, high, core, whole):
    import pyarrow as pa

    arrays = [pa.array(row, pa.int64()), pa.array(at, pa.int32()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64))]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _NODES.split(", ")])


def _whole(grams, core, at, low, high, length):
    """Identifier of all strings of a suffix that start ``low`` to ``high`` bytes before it."""
    with np.errstate(over="ignore"):
        span = low.astype(np.uint64) * np.uint64(4096) + high.astype(np.uint64)
    return _join(_join(core, string_ids(grams, at - high, high - low + length)), span)


def _suffixes(length):
    def run(batches):
        for rows, parts, _ in _grouped(batches, 0, 1):
            grams, starts, ends = _laid_out(parts)
            at, first, last = sampled(grams, ends, starts, length)
            if len(at):
                doc = np.searchsorted(ends, at, side="right")
                low, high, core = at - last, at - first, grams[at]
                yield _node_batch(np.array(rows)[doc], at - starts[doc], low, high, core, _whole(grams, core, at, low, high, length))

    return run


def _refine(length, step):
    """Strings of the suffixes still open, ``step`` neighbours at a time."""

    def run(batches):
        for rows, parts, lists in _grouped(batches, 0, 1, 2):
            grams, starts, ends = _laid_out(parts)
            flat = np.array([(i, x["at"], x["low"], x["high"]) for i, xs in enumerate(lists) for x in xs], np.int64).reshape(-1, 4)
            doc, at, low, high = flat.T
            count = high // step - low // step + 1
            each = np.repeat(np.arange(len(doc)), count)
            cell = (low // step)[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            doc, at = doc[each], at[each]
            a = at + starts[doc]
            lo, hi = np.maximum(low[each], cell * step), np.minimum(high[each], cell * step + step - 1)
            # What strings of a full cell have in common, whether or not all of them are here.
            s, e = np.maximum(a - cell * step, 0), a - (cell * step + step - 1) + length
            s, e = np.minimum(s, a), np.maximum(e, a + GRAM)
            inside = (s >= starts[doc]) & (e <= ends[doc])
            with np.errstate(over="ignore"):
                mark = (cell * 2).astype(np.uint64) * _B
            core = grams[a] ^ mark
            core[inside] = _join(string_ids(grams, s[inside], (e - s)[inside]), mark[inside])
            yield _node_batch(np.array(rows)[doc], at, lo, hi, core, _whole(grams, core, a, lo, hi, length))

    return run


def _settled(nodes: DataFrame):
    """Nodes whose strings are all repeated, and what is refined further.

    That is, of every bucket that several suffixes share and that is not all repeats, each suffix
    that is alone with its strings and one of those that are alike: the others may meet it there.
    """
    nodes = settle_table(nodes, "suffixes", RECORDS)
    alike = nodes.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "at", "low", "high")).alias("node"))
    mixed = alike.groupBy("core").agg(F.sum("n").alias("all"), F.min("n").alias("least")).filter("all > 1 and least = 1")
    open_ = settle_table(alike.join(mixed, "core").select("node.*"), "open")
    # One row for each bucket meets its many suffixes: a skewed join that can be split.
    repeats = alike.filter("n > 1").select("core", "whole")
    return settle_table(nodes.join(repeats, ["core", "whole"]).select("row", "at", "low", "high"), "repeats"), open_


def _merged(length):
    """Lists in which a maximal run of bytes is one span."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [runs(x.as_py(), length) for x in b.column(1)]
            spans = [[{"at": e - length, "low": 0, "high": e - length - s} for s, e in xs] for xs in found]
            kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("at", "low", "high")]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=["row", "spans"])

    return run


def _lists(nodes: DataFrame, length=None) -> DataFrame:
    found = nodes.distinct().groupBy("row").agg(F.collect_list(F.struct("at", "low", "high")).alias("spans"))
    return settle_table(found.mapInArrow(tidy(_merged(length)), f"row long, spans {_SPANS}") if length else found, "spans")


def _with_lists(texts, lists, how, key="row", spans="spans"):
    """Texts with the one list of their row, broadcast within the bounds.

    Beyond them each list is shuffled once: rows that repeat one key are on the side of the texts,
    where a skewed join is split.
    """
    rows, held = lists.agg(F.count(F.lit(1)), F.sum(F.size(spans))).first()
    fits = rows <= MAX_ROWS and (held or 0) <= MAX_SPANS
    return texts.join(F.broadcast(lists) if fits else lists.hint("merge"), key, how)


def row_key():
    return F.xxhash64("doc_id", "text")


def repeated(docs: DataFrame, length=LENGTH) -> DataFrame:
    """row and spans of every document that holds repeated strings.

    A span (at, low, high) is a maximal run of the bytes of strings that start ``low`` to ``high`` bytes before ``at``.
    """
    if length < 4 * GRAM:
        raise ValueError(f"strings must have at least {4 * GRAM} bytes")
    texts = docs.select(row_key().alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    done, open_ = _settled(texts.select("row", "text").mapInArrow(tidy(_suffixes(length)), _NODES))
    for step in (STEP, 1):
        near = _with_lists(texts, _lists(open_), "inner").select("row", "text", "spans")
        # A row that is repeated as it is counts as often as it stands there.
        more, open_ = _settled(near.mapInArrow(tidy(_refine(length, step)), _NODES))
        done = done.unionByName(more)
    return _lists(done, length)


def runs(spans, length=LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes that are covered by a document's spans."""
    out = []
    for s, e in sorted((x["at"] - x["high"], x["at"] - x["low"] + length) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _kept(data: bytes, found) -> bytes:
    at, parts = 0, []
    for s, e in found:
        parts.append(data[at:s])
        at = e
    return b"".join([*parts, data[at:]])


def _digest(length):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for doc_id, text, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                data, found = text.as_py() or b"", runs(spans.as_py(), length)
                kept = hashlib.sha256(_kept(data, found)).hexdigest()
                out.append((doc_id, len(data), sum(e - s for s, e in found), len(found), kept))
            kinds = [pa.int64()] * 4 + [pa.string()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)], names=names)

    return run


def summary(docs: DataFrame, length=LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    A null text is empty, rows that repeat an id or a whole row are documents of their own (so a
    repeated text of ``length`` bytes is removed from all of them), other columns are not read.
    """
    texts = docs.select(row_key().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    rows = _with_lists(texts, repeated(docs, length), "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(tidy(_digest(length)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, length=LENGTH) -> DataFrame:
    """``docs`` without the repeated bytes of column text. Bytes of a character that is cut go with the cut.

    A null text stays null, an empty table gives no rows, and other columns are kept, whatever their names.
    """
    import pyarrow as pa

    columns, at = docs.columns, docs.columns.index("text")
    key, listed = free_name("row", docs), free_name("spans", docs)
    texts = docs.withColumn(key, row_key())
    lists = repeated(docs, length).withColumnsRenamed({"row": key, "spans": listed})
    joined = _with_lists(texts, lists, "left", key, listed).select(*columns, listed)

    def run(batches):
        for b in batches:
            out = []
            for text, found in zip(b.column(at), b.column(len(columns))):
                text, found = text.as_py(), found.as_py()
                out.append(_kept(text.encode("utf-8", "surrogatepass"), runs(found, length)).decode("utf-8", "ignore") if found else text)
            arrays = [pa.array(out, pa.string()) if i == at else b.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return joined.mapInArrow(tidy(run), docs.schema)
