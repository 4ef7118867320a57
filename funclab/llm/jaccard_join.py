"""Exact join of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A set is hashed into blocks, and each block holds the XOR of its shingles' hashes: blocks of two
sets that differ are at most as many as the shingles in which the sets differ. Two linked sets of
which the smaller has a members differ in at most a/4 shingles; so with more blocks in use than
that, one block in use at least is the same in both. Sets meet on such blocks, within bands of the
smaller set's size, and pairs that meet are verified on their full sets.

A set with too few blocks in use for its band tries again with more blocks, and its partners that
do not need to are met on what both have tried. A block that very many sets share is not needed by
a set that still has enough others; only sets that depend on it are paired there. In each group the
set with most company is compared with the others first, and sets that are connected by then are
not paired again; two others are, if they meet on as many blocks as linked ones must. This gives the
components; then all sets of a component are compared, by pairs of blocks of them, for all links.

Before sets are compared, so are bit sketches, in which each shingle turns one bit: their Hamming
distance is at most the number of shingles in which the sets differ.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funclab.llm.common import free_name, let_go, scratch_path, settle_table, tidy
from funclab.llm.katz import _Hashes, _spread, _squeeze, mixed, tokens
from funclab.plans.settle import lookup_join, write_settled

WORDS = 5
#: Similarity as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: A block that more sets than this share is left to the sets that depend on it.
SHARED = 16
#: Members of keys, about, whose pairs one task counts.
OPENED = 200_000
#: Meetings of pairs that a task holds before it counts them, or half as many as it has counted.
COUNTED = 250_000
#: Sets of a block, about, of which a task compares two.
BLOCK = 512
#: Bits of a sketch.
SKETCH = 2048
#: Keys of one bucket, about, and shingles that a task gathers before it deals out their keys.
BUCKET, GATHERED = 1_500_000, 1_000_000
#: Rows of an Arrow batch that hold a text or sets.
RECORDS = 1_000
_DEALT = "bucket long, ids array<long>, rows array<long>, classes binary, sizes array<int>, keys binary, owners binary, trials array<array<int>>, spares array<array<int>>"
_FOUND = "kind string, row long, doc_id long, class long, size int, key long, trial int, trials array<int>, spares array<int>"


def shingles(text: str | None, hashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; fewer words are one shingle."""
    found = tokens(text)
    w = np.fromiter((hashes[x] for x in found), np.uint64, len(found))
    if not len(w):
        return w
    with np.errstate(over="ignore"):
        if len(w) < WORDS:
            w = np.concatenate([w, np.full(WORDS - len(w), 3, np.uint64) * np.uint64(0xA24BAED4963EE407)])
        n, out = len(w) - WORDS + 1, np.zeros(len(w) - WORDS + 1, np.uint64)
        for k in range(WORDS):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) + w[k : k + n]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def _edges():
    """Lower ends of the bands of set sizes: each is a quarter longer than the one before."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return out


EDGES = _edges()


def band(size: int) -> int:
    return bisect.bisect_right(EDGES, size) - 1


def bands(size: int) -> list[int]:
    """Bands in which a set of this size has partners: that of the smaller of the two."""
    least = -(-size * NUMERATOR // DENOMINATOR)
    return list(range(band(max(1, least)), band(size) + 1))


def _differing(band_: int) -> int:
    """Shingles in which two linked sets differ at most, the smaller being of this band."""
    a = EDGES[band_ + 1] - 1
    b = a * DENOMINATOR // NUMERATOR
    return (a + b) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def keys_of(set_: np.ndarray):
    """Keys of a set, and its (trial, spare) pairs.

    A key is a hash of a block in use whose last ten bits are the trial: a band and how often the
    number of blocks was raised. Spare is how many blocks in use the set can do without, below
    zero where they were too few.
    """
    keys, trials, spares = [], [], []
    for b in bands(len(set_)):
        d = _differing(b)
        if d == 0:  # only equal sets are linked
            continue
        n, tried = d + d // 4 + 6, 0
        while True:
            trial = b * 8 + tried
            at = (mixed(set_ + np.uint64(trial)) % np.uint64(n)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.diff(at[order], prepend=-1))
            held = np.bitwise_xor.reduceat(set_[order], starts)
            with np.errstate(over="ignore"):
                key = mixed(held ^ (at[order][starts].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(trial << 40)) << np.uint64(8)
            keys.append((key & ~np.uint64(1023)) | np.uint64(trial))
            trials.append(trial)
            spares.append(len(starts) - d - 1)
            # At the last trial the blocks are so many that hardly two shingles share one.
            if spares[-1] >= 0 or tried == 7:
                break
            n, tried = n * (4 if tried else 2), tried + 1
    return (np.concatenate(keys) if keys else np.zeros(0, np.uint64)), trials, spares


def _deal(bits):
    def run(batches):
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        names = [c.split()[0] for c in _DEALT.split(", ")]
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        kinds = [pa.int64(), longs, longs, pa.binary(), ints, pa.binary(), pa.binary(), pa.list_(ints), pa.list_(ints)]
        hashes = _Hashes()  # of one task: words of a part are few
        part, made = TaskContext.get().partitionId(), 0

        def row(*values):
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        def deal(docs):
            classes = np.array([d[2] for d in docs], np.uint64)
            # The documents themselves travel as a bucket of their own.
            yield row(-1 - ((part << 20) | made), [d[0] for d in docs], [d[1] for d in docs], classes.tobytes(), [d[3] for d in docs], None, None, [d[5] for d in docs], [d[6] for d in docs])
            first = np.unique(classes, return_index=True)[1]  # a class once
            keys = np.concatenate([docs[i][4] for i in first])
            owners = np.repeat(np.arange(len(first)), [len(docs[i][4]) for i in first])
            order = np.argsort(keys)
            keys, owners = keys[order], owners[order]
            cuts = np.searchsorted(keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64), np.arange((1 << bits) + 1, dtype=np.uint64))
            for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
                if j > i:
                    held, at = np.unique(owners[i:j], return_inverse=True)
                    yield row(k, None, None, classes[first][held].tobytes(), None, _squeeze(np.diff(keys[i:j], prepend=np.uint64(0)), np.uint64), _squeeze(at, np.uint32), None, None)

        docs, held = [], 0
        for b in batches:
            for row_, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                s = shingles(text.as_py(), hashes)
                cls = xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0
                docs.append((doc_id, row_, cls, len(s), *keys_of(s)))
                held += len(s)
                if held >= GATHERED:
                    yield from deal(docs)
                    docs, held, made = [], 0, made + 1
        if docs:
            yield from deal(docs)

    return run


def _meet(key, table):
    """Members of keys that several classes have; rows of documents are passed on."""
    import pyarrow as pa

    names = [c.split()[0] for c in _FOUND.split(", ")]
    longs, ints = pa.int64(), pa.list_(pa.int32())
    kinds = [pa.string(), longs, longs, longs, pa.int32(), longs, pa.int32(), ints, ints]
    column = lambda c: table.column(c).to_pylist()

    def rows(n, **columns):
        return pa.Table.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds)], names=names)

    if key[0].as_py() < 0:
        flat = lambda c: [x for part in column(c) for x in part]
        ids, classes = flat("ids"), np.concatenate([np.frombuffer(c, np.int64) for c in column("classes")])
        return rows(len(ids), **{"kind": ["doc"] * len(ids), "row": flat("rows"), "doc_id": ids, "class": classes, "size": flat("sizes"), "trials": flat("trials"), "spares": flat("spares")})
    keys = np.concatenate([np.cumsum(_spread(k, np.uint64), dtype=np.uint64) for k in column("keys")])
    classes = np.concatenate([np.frombuffer(c, np.int64)[_spread(o, np.uint32)] for c, o in zip(column("classes"), column("owners"))])
    order = np.lexsort((classes, keys))
    keys, classes = keys[order], classes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])
    keys, classes = keys[new], classes[new]
    counts = np.diff(np.flatnonzero(np.append(np.diff(keys, prepend=keys[:1] - np.uint64(1)), 1)))
    counts = np.repeat(counts, counts)
    many = counts > 1
    keys, classes, counts = keys[many], classes[many], counts[many]
    kind = np.where(counts > SHARED, "shared", "member").tolist()
    return rows(len(keys), **{"kind": kind, "class": classes, "size": counts.astype(np.int32), "key": keys.view(np.int64), "trial": (keys & np.uint64(1023)).astype(np.int32)})


def _meet_tidied(key, table):
    out = _meet(key, table)
    let_go()
    return out


def sketch(set_: np.ndarray) -> bytes:
    bits = np.bincount((mixed(set_) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _sets(batches):
    import pyarrow as pa

    hashes = _Hashes()
    for b in batches:
        found = [shingles(t.as_py(), hashes) for t in b.column(1)]
        arrays = [pa.array([len(x) for x in found], pa.int32()), pa.array([sketch(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["class", "n", "sketch", "held"])


def may_link(n_x, x, n_y, y) -> np.ndarray:
    """Where sketches (a row each) differ in no more bits than linked sets of these sizes may in shingles."""
    n_x, n_y = n_x.astype(np.int64), n_y.astype(np.int64)
    most = (n_x + n_y) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)
    apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return (apart <= most) & (DENOMINATOR * np.minimum(n_x, n_y) >= NUMERATOR * np.maximum(n_x, n_y))


def _sketches(column) -> np.ndarray:
    """The sketches of a column, a row each, where they lie."""
    parts = [c for c in getattr(column, "chunks", [column]) if len(c)]
    wide = {"binary": np.dtype(np.int32), "large_binary": np.dtype(np.int64)}
    at = [np.frombuffer(c.buffers()[1], wide[str(c.type)], 1, wide[str(c.type)].itemsize * c.offset)[0] for c in parts]
    found = [np.frombuffer(c.buffers()[2], np.uint8, len(c) * SKETCH // 8, i).reshape(len(c), -1) for c, i in zip(parts, at)]
    return found[0] if len(found) == 1 else np.concatenate([np.zeros((0, SKETCH // 8), np.uint8), *found])


def _near(batches):
    """Pairs that may be linked, by their sketches."""
    import pyarrow as pa

    for b in batches:
        fine = may_link(b.column(2).to_numpy(), _sketches(b.column(3)), b.column(4).to_numpy(), _sketches(b.column(5)))
        yield b.select([0, 1]).filter(pa.array(fine, pa.bool_()))


def _cross(parts):
    """Pairs of sets of different components that meet on as many keys of a part as linked sets must in one.

    Of a group, all but its largest component are paired with the rest, some at a time, so that a
    pair is a row once for all keys here. Keys of large groups count where both sets depend on such.
    Only pairs that may be linked by their sketches leave the task; ``sets`` has those, a row per set.
    """

    def run(key, table, sets):
        import pyarrow as pa

        keys, trial = table.column("key").to_numpy(), table.column("trial").to_numpy()
        names, at = np.unique(table.column("class").to_numpy(), return_inverse=True)
        label = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order], prepend=keys[order][:1] - 1)) if len(keys) else []
        found, held, n = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], np.uint64(len(names))

        def merged():
            codes = np.concatenate([found[0], *held])
            codes, back = np.unique(codes, return_inverse=True)
            ones = np.ones(len(back) - len(found[1]), np.int64)
            return codes, np.bincount(back, np.concatenate([found[1], ones]), len(codes)).astype(np.int64)

        size = 0
        for i, j in zip(cuts, [*cuts[1:], len(keys)]):
            mine = order[i:j]
            c, own, t = at[mine].astype(np.uint64), label[mine], np.uint64(trial[mine[0]])
            kinds, which, counts = np.unique(own, return_inverse=True, return_counts=True)
            big = which == counts.argmax()
            for x in np.flatnonzero(~big):  # with the largest component, and with later ones of others
                other = np.flatnonzero((own != own[x]) & (big | (np.arange(len(mine)) > x)))
                low, high = np.minimum(c[x], c[other]), np.maximum(c[x], c[other])
                held.append((t * n + low) * n + high)
                size += len(other)
            if size > max(COUNTED, len(found[0]) // 2):
                found, held, size = merged(), [], 0
        codes, counts = merged()
        found, held = None, None
        # What a set can do without, by set and trial.
        column = lambda c: table.column(c).to_numpy()
        pairs, first = np.unique(trial.astype(np.uint64) * n + at.astype(np.uint64), return_index=True)
        left, spare = column("left")[first], column("spare")[first]
        t = codes // (n * n)
        a, b = codes // n % n, codes % n
        ia, ib = np.searchsorted(pairs, t * n + a), np.searchsorted(pairs, t * n + b)
        both = (left[ia] < 0) & (left[ib] < 0)
        least = np.where(both, np.maximum(spare[ia], spare[ib]), np.maximum(left[ia], left[ib])) + 1
        fine = counts * parts >= least
        a, b = a[fine].astype(np.int64), b[fine].astype(np.int64)
        by = np.argsort(sets.column("set").to_numpy())
        sizes, bits = sets.column("n").to_numpy(), _sketches(sets.column("sketch"))
        steps = [(by[a[i : i + 10_000]], by[b[i : i + 10_000]]) for i in range(0, len(a), 10_000)]
        fine = np.concatenate([np.zeros(0, bool), *[may_link(sizes[x], bits[x], sizes[y], bits[y]) for x, y in steps]])
        a, b = names[a[fine]], names[b[fine]]
        return pa.Table.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def tidied(key, table, sets):
        out = run(key, table, sets)
        let_go()
        return out

    return tidied


def _verify(batches):
    import pyarrow as pa

    for b in batches:
        linked = []
        for x, y in zip(b.column(2), b.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both))
        yield b.select([0, 1]).filter(pa.array(linked, pa.bool_()))


def _links_within(a, sets_a, n_a, bits_a, b, sets_b, n_b, bits_b, step=64):
    """Places in ``a`` and ``b`` of the linked pairs of two blocks, a pair of one block once."""
    words = np.unique(np.concatenate([*sets_a, *sets_b]))
    owner = np.repeat(np.arange(len(b)), n_b)
    at = np.searchsorted(words, np.concatenate(sets_b))
    order = np.argsort(at, kind="stable")
    owner, starts = owner[order], np.searchsorted(at[order], np.arange(len(words) + 1))
    for i in range(0, len(a), step):
        x, y = np.meshgrid(np.arange(i, min(i + step, len(a))), np.arange(len(b)), indexing="ij")
        x, y = x.ravel(), y.ravel()
        fine = DENOMINATOR * np.minimum(n_a[x], n_b[y]) >= NUMERATOR * np.maximum(n_a[x], n_b[y])
        if a is b:
            fine &= x < y
        x, y = x[fine], y[fine]
        fine = may_link(n_a[x], bits_a[x], n_b[y], bits_b[y])
        x, y = x[fine], y[fine]
        for k in np.unique(x):
            other = y[x == k]
            mine = np.searchsorted(words, sets_a[k])
            # Members of the other block that have each shingle of this set.
            low, many = starts[mine], starts[mine + 1] - starts[mine]
            every = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            both = np.bincount(owner[every], minlength=len(b))[other]
            linked = other[DENOMINATOR * both >= NUMERATOR * (n_a[k] + n_b[other] - both)]
            yield k, linked


def _block_links(count):
    """Verified pairs of classes of two blocks of a component, or the rows that each class is linked with there."""

    def run(key, table):
        import pyarrow as pa

        low, high = key[1].as_py(), key[2].as_py()
        table = table.sort_by("class")
        block, names, weight = (table.column(c).to_numpy() for c in ("block", "class", "rows"))
        n, bits = table.column("n").to_numpy().astype(np.int64), _sketches(table.column("sketch"))
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("held")]
        side = lambda at: (at, [held[i] for i in at], n[at], bits[at])
        a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
        first = side(a)
        found = _links_within(*first, *(first if low == high else side(b))) if len(a) and len(b) else ()
        b = a if low == high else b
        if count:
            total = np.zeros(len(names), np.int64)
            for k, linked in found:
                total[a[k]] += weight[b[linked]].sum()
                total[b[linked]] += weight[a[k]]
            return pa.table({"class": names, "linked": total})
        pairs = [(names[a[k]], names[b[i]]) for k, linked in found for i in linked]
        x, y = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return run


def components(links: DataFrame) -> DataFrame:
    """class and label (the smallest class that links lead to) of the classes in ``links`` (a, b)."""
    both = links.select("a", "b").union(links.select("b", "a"))
    labels = both.groupBy(F.col("a").alias("class")).agg(F.least(F.min("b"), F.first("a")).alias("label")).checkpoint()
    while True:
        # The smallest label of the neighbours, then the label of that label.
        near = both.join(labels.select(F.col("class").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "class"), "class").select("class", "label", F.least("label", "near").alias("next"))
        onward = labels.select(F.col("class").alias("next"), F.col("label").alias("far"))
        step = step.join(onward, "next").select("class", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("moved")).checkpoint()
        labels = step.select("class", "label")
        if step.filter("moved").isEmpty():
            return labels


def row_key():
    return F.xxhash64("doc_id", "text")


class Join:
    """``docs`` (row, doc_id, class, size) and verified ``links`` between classes of different sets.

    ``links`` are as many as connect each component, and not all: sets that are connected by then
    are not paired again. As no link leaves a component, ``pairs`` and ``linked_rows`` have all of
    them, by comparing the sets within each one.
    """

    def __init__(self, documents: DataFrame):
        spark = documents.sparkSession
        texts = documents.select(row_key().alias("row"), F.col("doc_id").cast("long"), "text")
        # About 0.65 keys for a shingle, and a shingle for six bytes.
        size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = max(0, int(np.ceil(np.log2(max(1, size / 9 / BUCKET)))))
        path = scratch_path(spark, "join")
        dealt = texts.mapInArrow(tidy(_deal(bits)), _DEALT)
        write_settled(dealt.groupBy("bucket").applyInArrow(_meet_tidied, _FOUND), path, ["kind"], RECORDS)
        found = spark.read.schema(_FOUND).option("basePath", path).parquet(path)
        docs = found.filter("kind = 'doc'")
        self.docs = docs.select("row", "doc_id", "class", "size")
        members = found.filter("kind = 'member'").select("key", "class", "size", "trial")
        shared = found.filter("kind = 'shared'").select("key", "class", "size", "trial")
        # How many blocks a set can do without, and how many it has in groups that are too large.
        spare = docs.select("class", F.explode(F.arrays_zip("trials", "spares")).alias("t")).select("class", F.col("t.trials").alias("trial"), F.col("t.spares").alias("spare")).distinct()
        # Spark takes the exploded rows for as few as their documents, and might broadcast them.
        lost = shared.groupBy("class", "trial").count().join(spare.hint("merge"), ["class", "trial"]).select("class", "trial", (F.col("spare") - F.col("count")).alias("left"))
        lost = settle_table(lost, "lost")
        # Sets that cannot do without those are paired on them.
        members = members.unionByName(shared.join(lost.filter("left < 0").select("class", "trial"), ["class", "trial"]))
        self.members = settle_table(members, "members")
        self.texts = texts
        self.sets = self._sets_of(self.members)
        # The set that shares most, in all, is the likely origin of the others.
        company = self.members.groupBy("class").agg(F.sum("size").alias("company"))
        known = settle_table(self.members.join(company, "class").select("key", "class", "trial", "company"), "members")
        first = known.groupBy("key").agg(F.max(F.struct("company", "class"))["class"].alias("a"))
        star = self._pairs(known.join(first, "key").select("a", F.col("class").alias("b")))
        star = settle_table(self._near(star), "star", RECORDS)
        self.links = self._linked(star)
        # Then members that are not connected yet: sets that meet on as many blocks as they must.
        labels = components(self.links)
        known = known.join(labels, "class", "left").select("key", "class", "trial", F.coalesce("label", "class").alias("label"))
        open_ = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
        known = settle_table(known.join(open_.select("key"), "key"), "open")
        parts = known.count() // OPENED + 1
        left = spare.join(lost, ["class", "trial"], "left").select("class", "trial", "spare", F.coalesce("left", "spare").alias("left"))
        known = settle_table(known.join(left, ["class", "trial"]).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))), "dealt")
        # Linked sets meet as often as they must in all parts together, so in one of them as often on average.
        bits = known.select(F.col("part").alias("dealt"), F.col("class").alias("set")).distinct()
        bits = bits.join(self.sets.select(F.col("class").alias("set"), "n", "sketch"), "set").select("dealt", "set", "n", "sketch")
        met = known.groupBy("part").cogroup(bits.groupBy("dealt")).applyInArrow(_cross(parts), "a long, b long")
        met = settle_table(self._pairs(met), "met", RECORDS)
        more = self._linked(met.join(star, ["a", "b"], "left_anti"))
        self.links, self._labels = settle_table(self.links.unionByName(more), "links"), None

    def labels(self):
        """class and label of the classes that have links."""
        if self._labels is None:
            self._labels = components(self.links)
        return self._labels

    def _blocks(self):
        """The sets of each component, dealt over pairs of blocks."""
        labels = settle_table(self.labels(), "labels")
        blocks = labels.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        rows = self.docs.groupBy("class").agg(F.count(F.lit(1)).alias("rows"))
        rows = lookup_join(labels, settle_table(blocks, "blocks"), ["label"], spread="class").join(rows, "class")
        rows = rows.withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
        rows = rows.join(self.sets, "class").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return rows.select("label", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "class", "rows", "n", "sketch", "held").groupBy("label", "low", "high")

    def pairs(self) -> DataFrame:
        """a and b of all linked classes of different sets, the smaller first."""
        return self._blocks().applyInArrow(_block_links(False), "a long, b long")

    def linked_rows(self) -> DataFrame:
        """class and linked: the rows in all classes that the class is linked with. Pairs do not leave their tasks."""
        found = self._blocks().applyInArrow(_block_links(True), "class long, linked long")
        return found.groupBy("class").agg(F.sum("linked").alias("linked"))

    def _sets_of(self, members):
        wanted = members.select("class").distinct()
        rows = self.docs.groupBy("class").agg(F.min("row").alias("row")).join(wanted, "class")
        rows = settle_table(rows.select("row", "class"), "wanted")
        texts = lookup_join(self.texts, rows, ["row"], once=True).select("class", "text")
        made = texts.mapInArrow(tidy(_sets), "class long, n int, sketch binary, held binary")
        return settle_table(made.dropDuplicates(["class"]), "sets", RECORDS)

    def _pairs(self, pairs):
        """Distinct pairs of different classes, the smaller first."""
        return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def _near(self, pairs):
        side = lambda k: self.sets.select(F.col("class").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"{DENOMINATOR} * least(n_a, n_b) >= {NUMERATOR} * greatest(n_a, n_b)")
        return both.select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b").mapInArrow(tidy(_near), "a long, b long")

    def _linked(self, pairs):
        held = lambda k: self.sets.select(F.col("class").alias(k), F.col("held").alias(f"set_{k}"))
        both = pairs.join(held("a"), "a").join(held("b"), "b").select("a", "b", "set_a", "set_b")
        return settle_table(both.mapInArrow(tidy(_verify), "a long, b long"), "links", RECORDS)


def near_groups(documents: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles and component_id of every document.

    A null or empty text, or one without words, is linked with nothing. Rows that repeat an id are
    documents of their own; component_id is the smallest id that links lead to, and null where all
    of these are null. Other columns are not read. Sets are compared by 64-bit hashes of shingles.
    """
    return _groups(Join(documents)).drop("class")


def linked_groups(documents: DataFrame) -> DataFrame:
    """The same, and n_links: the number of other rows whose similarity with the row is 0.8 or more, equal ones too."""
    join = Join(documents)
    docs = _groups(join)
    copies = docs.filter("n_shingles > 0").groupBy("class").agg(F.count(F.lit(1)).alias("rows"))
    links = copies.join(join.linked_rows(), "class", "left").select("class", (F.col("rows") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = docs.join(settle_table(links, "n_links"), "class", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long")
    return out.select("row", "doc_id", "n_shingles", "component_id", own.alias("n_links"))


def _groups(join: Join) -> DataFrame:
    docs = join.docs.join(join.labels(), "class", "left").withColumn("label", F.coalesce("label", "class"))
    lowest = docs.filter("size > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    # A label that many rows have is one row on the other side, and a skewed join is split.
    out = docs.join(lowest, "label", "left")
    own = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("row", "doc_id", F.col("size").cast("long").alias("n_shingles"), own.alias("component_id"), "class")


def keep_first(documents: DataFrame) -> DataFrame:
    """One document of each group of linked ones, that with the smallest id, with all its columns.

    Documents without words are all kept. Of rows that repeat id and text, and of rows of a group
    that has no id but null, one stays.
    """
    groups, key = near_groups(documents), free_name("row", documents)
    copies = groups.filter("n_shingles > 0").groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("row")).alias("alone"))
    first = copies.agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias(key))
    empty = groups.filter("n_shingles = 0").select(F.col("row").alias(key))
    kept = settle_table(first.select(key).union(empty).distinct(), "kept")
    rows = documents.withColumn(key, row_key())
    out = lookup_join(rows, kept, [key], once=True)
    has_words = F.col("text").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.filter(has_words).dropDuplicates([key]).select(*documents.columns).unionByName(out.filter(~F.coalesce(has_words, F.lit(False))).select(*documents.columns))
