"""A trie of conversations that begin alike, with prefixes of one conversation screened out.

A prefix is named by a digest: the XOR of a hash of each turn together with its place, so that
digests of all prefixes of a conversation are running XORs. Digests are counted in a count-min
sketch. Where its estimate is one, no other conversation has the prefix: such a node is emitted
where its row lies. Only prefixes that may be shared are shuffled and grouped by their digests.

What a subtree sums up needs no walk from the leaves to the root. Each node leaves its values with
one of its members, the smallest; a node's subtree is then what its members hold at its depth and
below, a running sum in each conversation and one sum over members. Turns are ordered and summed
within segments of a conversation, and totals of segments after that, so a conversation may be long.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funclab.llm.common import keyed_join, settle_table
from funclab.llm.katz import mixed

#: Rows of the sketch, cells of a row for each prefix at least, and at most in all (a bit each is broadcast).
HASHES, CELLS, MOST_CELLS = 4, 4, 1 << 26
#: Cells that are merged together, and prefixes that a task counts before it hands on their cells.
SLICE, COUNTED = 1 << 16, 1_000_000
#: Turns of a conversation, about, that are ordered together.
SEGMENT = 4_096
#: Conversations of which one row lists the ids.
LISTED = 8_192
_WORD = r"[^\x20\x09-\x0D]+"
_NODE = ["depth", "a", "b"]
_PREFIX = "conv_id long, total long, depth long, a long, b long, pa long, pb long, words long"
_OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _running(rows: DataFrame, columns, total, join, descending=False) -> DataFrame:
    """Totals of columns over the rows of a conversation up to each depth, or down to it from the deepest."""
    rows = rows.withColumn("segment", F.expr(f"depth div {SEGMENT}"))
    order = (lambda c: F.col(c).desc()) if descending else F.col
    within = Window.partitionBy("conv_id", "segment").orderBy(order("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy(order("segment")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "segment").agg(*(total(c).alias(c) for c in columns))
    sums = sums.select("conv_id", "segment", *(F.coalesce(total(c).over(before), F.lit(0)).alias(f"before_{c}") for c in columns))
    rows = rows.withColumns({c: total(c).over(within) for c in columns}).join(sums, ["conv_id", "segment"])
    return rows.withColumns({c: join(F.col(c), F.col(f"before_{c}")) for c in columns}).drop("segment", *(f"before_{c}" for c in columns))


def numbered_turns(conversations: DataFrame):
    """Turns with their place, and a row for each conversation and segment with what is known of it.

    Turns keep two hashes and a number of words in place of their text.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    place = F.coalesce(F.expr(f"turn div {SEGMENT}"), F.lit(-(1 << 62)))  # null first
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"))
    turns = turns.filter("conv_id is not null").select(
        "conv_id",
        "turn",
        place.alias("segment"),
        F.xxhash64("role", "text").alias("x"),
        F.xxhash64(F.lit("second"), "text", "role").alias("y"),
        F.regexp_count("text", F.lit(_WORD)).cast("long").alias("words"),
    )
    turns = settle_table(turns, "turns")
    segments = turns.groupBy("conv_id", "segment").agg(F.count(F.lit(1)).alias("n"))
    conv = Window.partitionBy("conv_id")
    before = F.sum("n").over(conv.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    segments = segments.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("own", F.sum("n").over(conv)).drop("n")
    order = Window.partitionBy("conv_id", "segment").orderBy(F.col("turn").asc_nulls_first(), "x", "y")
    return turns.withColumn("n", F.row_number().over(order)), settle_table(segments, "segments")


def rebuilt_prefixes(conversations: DataFrame, family=20, heads=4) -> DataFrame:
    """A row for each rebuilt conversation and depth, with the digest of the turns up to there.

    A conversation takes its first turns from the one that its id, less the remainder by
    ``family``, names, crc32 modulo ``heads`` of them, and then has its own after as many.
    """
    turns, segments = numbered_turns(conversations)
    base = F.col("conv_id") - F.col("conv_id") % family
    segments = segments.withColumn("base", base).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % heads)
    known = segments.filter("before = 0 and conv_id = base").select("base", "own")
    known = known.withColumnRenamed("own", "held")
    head = F.least("h", F.coalesce("held", F.lit(0)))
    total = head + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    segments = segments.join(known, "base", "left").withColumn("head", head).withColumn("total", total)
    segments = settle_table(segments.select("conv_id", "segment", "before", "base", "h", "head", "total"), "rebuilding")
    turns = turns.join(segments, ["conv_id", "segment"]).withColumn("place", F.col("before") + F.col("n"))
    turns = settle_table(turns.select("conv_id", "base", "place", "h", "head", "total", "x", "y", "words"), "numbered")
    convs = segments.filter("before = 0")
    lent = turns.filter(F.col("conv_id") == F.col("base")).filter(F.col("place") < heads).select("base", F.col("place").alias("depth"), "x", "y", "words")
    lent = convs.join(lent, "base").filter("depth <= h").select("conv_id", "total", "depth", "x", "y", "words")
    own = turns.filter("place > h").select("conv_id", "total", (F.col("place") - F.col("h") + F.col("head")).alias("depth"), "x", "y", "words")
    turn = lambda *c: F.xxhash64("depth", *c)
    rows = lent.unionByName(own).withColumn("a", turn("x", "y")).withColumn("b", turn("y", "x")).drop("x", "y")
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", "total", *(zero.alias(c) for c in ("depth", "a", "b", "words")))
    rows = rows.unionByName(root).withColumn("last_a", F.col("a")).withColumn("last_b", F.col("b"))
    rows = _running(rows, ["a", "b"], F.bit_xor, lambda x, y: x.bitwiseXOR(y))
    parent = {"pa": F.col("a").bitwiseXOR(F.col("last_a")), "pb": F.col("b").bitwiseXOR(F.col("last_b"))}
    return settle_table(rows.withColumns(parent).select(*(c.split()[0] for c in _PREFIX.split(", "))), "prefixes")


def cells_of(digests: np.ndarray, row: int, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed(digests.view(np.uint64) + np.uint64(row) * np.uint64(0xA24BAED4963EE407)) % np.uint64(width)).astype(np.int64)


def _count(width, size):
    """Cells of prefixes, by slices of the sketch; counts go up to two."""

    def run(batches):
        import pyarrow as pa

        def cells(digests):
            for row in range(HASHES):
                at, n = np.unique(cells_of(digests, row, width) + row * width, return_counts=True)
                starts = np.flatnonzero(np.diff(at // size, prepend=-1))
                for i, j in zip(starts, [*starts[1:], len(at)]):
                    yield int(at[i] // size), (at[i:j] % size).astype(np.uint32).tobytes(), np.minimum(n[i:j], 2).astype(np.uint8).tobytes()

        held, n = [], 0

        def batch():
            rows = list(cells(np.concatenate(held)))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["slice", "cells", "counts"])

        for b in batches:
            if b.num_rows:
                held.append(np.ascontiguousarray(b.column(0).to_numpy()))
                n += b.num_rows
            if n > COUNTED:
                yield batch()
                held, n = [], 0
        if held:
            yield batch()

    return run


def _merge(size):
    """Bits of the cells that were counted twice or more, a row for each slice; slices come in order."""

    def run(batches):
        import pyarrow as pa

        now, counts = None, None

        def row():
            bits = np.packbits(counts > 1, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([bits], pa.binary())], names=["slice", "bits"])

        for b in batches:
            for k, at, n in zip(*(c.to_pylist() for c in b.columns)):
                if k != now:
                    if now is not None:
                        yield row()
                    now, counts = k, np.zeros(size, np.uint8)
                at = np.frombuffer(at, np.uint32)
                counts[at] = np.minimum(counts[at] + np.frombuffer(n, np.uint8), 2)
        if now is not None:
            yield row()

    return run


def sketch(prefixes: DataFrame):
    """Bits of the count-min sketch, a row of bytes for each hash: cells that two prefixes or more fall into."""
    rows = prefixes.filter("depth > 0").select("a")
    n, width = rows.count(), SLICE
    while width < min(CELLS * n, MOST_CELLS):
        width *= 2
    cells = rows.mapInArrow(_count(width, SLICE), "slice long, cells binary, counts binary")
    merged = cells.repartition("slice").sortWithinPartitions("slice").mapInArrow(_merge(SLICE), "slice long, bits binary")
    bits = np.zeros(HASHES * width // 8, np.uint8)
    for r in merged.collect():  # HASHES * MOST_CELLS bits at most
        bits[r["slice"] * SLICE // 8 : (r["slice"] + 1) * SLICE // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits.reshape(HASHES, width // 8)


def _screen(bits):
    """Whether a prefix, and the one before its last turn, may be shared; the empty one may."""

    def run(batches):
        import pyarrow as pa

        width = bits.value.shape[1] * 8

        def shared(digests, depth):
            out = np.ones(len(digests), bool)
            for row in range(HASHES):
                at = cells_of(digests, row, width)
                out &= (bits.value[row][at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            return out | (depth <= 0)

        for b in batches:
            depth, a, pa_ = (np.ascontiguousarray(b.column(k).to_numpy()) for k in (2, 3, 5))
            flags = [pa.array(shared(a, depth)), pa.array(shared(pa_, depth - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns, *flags], names=[*b.schema.names, "shared", "parent_shared"])

    return run


def _hash_lists(batches):
    """SHA-256 of the lists of ids of a node; its rows come together and in order, and none is kept."""
    import hashlib

    import pyarrow as pa

    now, state = None, None
    for b in batches:
        done = []
        for *key, ids in zip(*(c.to_pylist() for c in b.columns)):
            if key != now:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256()
                state.update(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*_NODE, "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], names=[*_NODE, "ends_sha256"])


def ends_of(rows: DataFrame) -> DataFrame:
    """ends_sha256 of the conversations that end in each node, by ascending id."""
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    lists = rows.withColumn("part", F.expr(f"conv_id div {LISTED}")).groupBy(*_NODE, "part").agg(F.concat_ws(",", ids).alias("ids"))
    # A row holds LISTED ids, so those of a node that many share are few; its hash takes them one by one.
    lists = lists.repartition(*_NODE).sortWithinPartitions(*_NODE, "part").select(*_NODE, "ids")
    return lists.mapInArrow(_hash_lists, "depth long, a long, b long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of rebuilt conversations (see ``rebuilt_prefixes``), a row each.

    ``conversations`` has conv_id, turn, role and text; a null role or text counts as empty. Turns
    are ordered by turn, null first, and turns that are equal there by hashes of role and text;
    repeated rows are turns of their own. Rows without conv_id are left out. Other columns are not
    read; an empty table has no node, not even the root. Turns and prefixes are compared by two
    64-bit hashes.
    """
    spark = conversations.sparkSession
    prefixes = rebuilt_prefixes(conversations)
    bits = spark.sparkContext.broadcast(sketch(prefixes))
    screened = settle_table(prefixes.mapInArrow(_screen(bits), f"{_PREFIX}, shared boolean, parent_shared boolean"), "screened")
    none, one, zero = F.sha2(F.lit("").cast("binary"), 256), F.lit(1).cast("long"), F.lit(0).cast("long")
    is_end = F.col("depth") == F.col("total")

    # Nodes of one conversation: all is known where the row lies but, at the first, the parent.
    alone = screened.filter("not shared").select(
        "conv_id",
        "depth",
        "pa",
        "pb",
        "parent_shared",
        one.alias("n_convs"),
        F.when(is_end, zero).otherwise(one).alias("n_children"),
        one.alias("n_leaves"),
        zero.alias("saved_tokens"),
        F.when(is_end, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(none).alias("ends_sha256"),
    )

    crowd = screened.filter("shared")
    nodes = crowd.groupBy(*_NODE).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("words").alias("words"), F.min("pa").alias("pa"), F.min("pb").alias("pb")
    )
    nodes = settle_table(nodes, "nodes")
    above = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    children = nodes.filter("depth > 0").select(*above).union(alone.filter("parent_shared").select(*above))
    children = children.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = settle_table(nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)), "nodes")

    # What each node adds to those above it lies with its smallest member.
    member = crowd.select("conv_id", *_NODE, zero.alias("saved_tokens"), zero.alias("n_leaves"), F.lit(True).alias("member"))
    saved = ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")
    leaf = F.when(F.col("n_children") == 0, one).otherwise(zero).alias("n_leaves")
    adds = nodes.select("conv_id", *_NODE, saved, leaf, F.lit(False).alias("member"))
    ends = screened.filter(~F.col("shared") & is_end).select("conv_id", *_NODE, zero.alias("saved_tokens"), one.alias("n_leaves"), F.lit(False).alias("member"))
    sums = _running(member.unionByName(adds).unionByName(ends), ["saved_tokens", "n_leaves"], F.sum, lambda x, y: x + y, descending=True)
    sums = sums.filter("member").groupBy(*_NODE).agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    full = nodes.join(sums, _NODE).join(ends_of(crowd.filter(is_end).select("conv_id", *_NODE)), _NODE, "left")
    full = full.withColumn("ends_sha256", F.coalesce("ends_sha256", none))

    kept = ["conv_id", "depth", "pa", "pb", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below = settle_table(full.select(*kept).unionByName(alone.filter("parent_shared").select(*kept)), "below")
    parents = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    parents = settle_table(parents.withColumnRenamed("n_children", "rows"), "parents")
    out = keyed_join(below, parents, ["depth", "pa", "pb"], "rows", spread="conv_id")
    # A node whose parent is known to be of one conversation has that conversation's.
    own = F.coalesce("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    tails = alone.filter("not parent_shared").withColumn("parent_conv_id", F.col("conv_id"))
    return out.withColumn("parent_conv_id", own).select(*_OUT).unionByName(tails.select(*_OUT))
