"""Near duplicates by SimHash fingerprints, joined by the generalised pigeonhole principle.

Bits of a fingerprint are grouped into parts, correlated bits together, so that the values of
different parts tell as much as they can independently. If the thresholds of the parts, each with
one added, sum up to one more than the distance searched, two fingerprints within that distance
agree in one part at least up to its threshold. So each fingerprint may choose its own thresholds:
it spends them where few others have values near its own, and may leave out a part in which it
stands in a crowd. The choice is a dynamic programme on numbers of candidates, which come from
counts of the values of all fingerprints.

A fingerprint is indexed once for each part and probes the values that its thresholds allow.
Indexed and probing ones meet on a part's value and are verified there in full; a value that very
many have is cut into tiles. What leaves a task is a forest that connects linked fingerprints.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funclab.llm.common import keyed_join, settle_table
from funclab.llm.jaccard_join import components
from funclab.plans.settle import lookup_join

WORDS, SEED, BITS, DISTANCE = 3, 42, 64, 3
#: Bits of the pieces whose values are counted, at most, and numbers of parts to choose from.
PIECE, PARTS = 16, (4, 3, 2)
#: Comparisons that cost as much as moving one more probe.
PROBE = 200
#: Rows with one value of a part that a task compares at once; values of more are cut into tiles.
TILE = 4_096
#: Links that a task holds before it reduces them to a forest, and fingerprints hashed at once.
HELD, HASHED = 1_000_000, 1 << 16
_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LINKS, _MEETING = "a long, b long", "part int, value long, fp long, role int"


def fingerprint(text: bytes | None) -> int:
    """A bit is set where over half the hashes of three-word shingles have it; no words give zero."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    n, last = max(1, len(words) - WORDS + 1), min(WORDS, len(words)) - 1
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts, joined = np.concatenate([[0], ends[:-1] + 1]), b" ".join(words)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, HASHED):
        j = min(n, i + HASHED)
        spans = zip(starts[i:j].tolist(), ends[i + last : j + last].tolist())
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans), "<u8", j - i).view(np.uint8).reshape(-1, 8)
        counts += np.concatenate([np.bincount(hashes[:, k], minlength=256) @ _OF_BYTE for k in range(8)])
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    import pyarrow as pa

    for b in batches:
        found = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])


def _together(batches):
    """How often two bits are set together."""
    import pyarrow as pa

    total = np.zeros((BITS, BITS), np.int64)
    for b in batches:
        held = np.ascontiguousarray(b.column(0).to_numpy()).astype("<i8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(held, axis=1, bitorder="little").astype(np.float64)
        total += (bits.T @ bits).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS, dtype=np.int32)), pa.array(total.ravel())], names=["at", "together"])


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits dealt into parts of equal size, each grown by the bit that correlates most with it.

    ``together[i, j]`` is how many of the n fingerprints have both bits.
    """
    share = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    alike = np.abs(together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(alike, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        own = [left.pop(int(alike[np.ix_(left, left)].max(axis=1).argmax()))]
        while len(own) < size:
            own.append(left.pop(int(alike[np.ix_(left, own)].sum(axis=1).argmax())))
        out.append(sorted(own))
    return out


def taken(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of fingerprints, as numbers."""
    out = np.zeros(len(fps), np.int64)
    for k, bit in enumerate(bits):
        out |= ((fps.view(np.uint64) >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
    return out


def pieces_of(part: list[int]) -> list[list[int]]:
    cuts = -(-len(part) // PIECE)
    return [part[len(part) * k // cuts : len(part) * (k + 1) // cuts] for k in range(cuts)]


def near_counts(counts: np.ndarray) -> np.ndarray:
    """For each value, how many fingerprints have one that differs in exactly 0 .. DISTANCE bits."""
    out = np.zeros((DISTANCE + 1, len(counts)))
    out[0] = counts
    at, bit = np.arange(len(counts)), 1
    while bit < len(counts):
        out[1:] += out[:-1, at ^ bit]
        bit *= 2
    return out


def _ball(width: int, radius: int) -> list[int]:
    """All differences of a value of so many bits that turn exactly ``radius`` of them."""
    return [sum(1 << k for k in chosen) for chosen in itertools.combinations(range(width), radius)]


def allocate(candidates: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Thresholds plus one, a row for each fingerprint and a column for each part, of least cost.

    ``candidates[i, :, t]`` are the numbers of candidates of part i at threshold t, ``probes[i, t]``
    the values probed. The columns sum up to DISTANCE + 1; zero leaves the part out.
    """
    parts, n, _ = candidates.shape
    cost = np.concatenate([np.zeros((parts, n, 1)), candidates + PROBE * probes[:, None, :]], axis=2)
    best = np.full((n, DISTANCE + 2), np.inf)
    best[:, 0] = 0
    choices = []
    for i in range(parts):
        options = np.full((n, DISTANCE + 2, DISTANCE + 2), np.inf)  # what is spent so far, of it here
        for here in range(DISTANCE + 2):
            options[:, here:, here] = best[:, : DISTANCE + 2 - here] + cost[i][:, here, None]
        choices.append(options.argmin(axis=2))
        best = options.min(axis=2)
    spent, out = np.full(n, DISTANCE + 1), np.zeros((n, parts), np.int64)
    for i in reversed(range(parts)):
        out[:, i] = choices[i][np.arange(n), spent]
        spent = spent - out[:, i]
    return out


def _probes(widths) -> np.ndarray:
    return np.array([np.cumsum([len(_ball(w, t)) for t in range(DISTANCE + 1)]) for w in widths], float)


def parts_for(n: int) -> int:
    """How many parts cost least for n fingerprints with evenly spread values."""

    def cost(parts):
        widths = [BITS * (k + 1) // parts - BITS * k // parts for k in range(parts)]
        probes = _probes(widths)
        even = probes * n / 2.0 ** np.array(widths)[:, None]
        chosen = allocate(even[:, None, :], probes)[0]
        return sum(even[i, t - 1] + PROBE * probes[i, t - 1] for i, t in enumerate(chosen) if t)

    return min(PARTS, key=cost)


def _values(pieces):
    """Counted values of each piece, a row for each that occurs in the task."""

    def run(batches):
        import pyarrow as pa

        held = [np.zeros(1 << len(p), np.int64) for p in pieces]
        for b in batches:
            fps = np.ascontiguousarray(b.column(0).to_numpy())
            for total, bits in zip(held, pieces):
                total += np.bincount(taken(fps, bits), minlength=len(total))
        for k, total in enumerate(held):
            at = np.flatnonzero(total)
            arrays = [pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[at])]
            yield pa.RecordBatch.from_arrays(arrays, names=["piece", "value", "n"])

    return run


def candidates(fps: np.ndarray, parts, near, n: int) -> np.ndarray:
    """Estimated numbers of candidates by part, fingerprint and threshold; exact for parts of one piece."""
    out, k = np.zeros((len(parts), len(fps), DISTANCE + 1)), 0
    for i, part in enumerate(parts):
        exact = None
        for bits in pieces_of(part):
            one = near[k][:, taken(fps, bits)]
            if exact is None:
                exact = one
            else:  # pieces taken as independent
                exact = np.stack([sum(exact[e] * one[t - e] for e in range(t + 1)) for t in range(DISTANCE + 1)]) / max(n, 1)
            k += 1
        out[i] = np.cumsum(exact, axis=0).T
    return out


def _meetings(parts, near, n):
    """Rows by which fingerprints meet; role 1 is indexed, 2 probes, 3 both."""

    def run(batches):
        import pyarrow as pa

        balls = [[np.array(_ball(len(p), t), np.int64) for t in range(DISTANCE + 1)] for p in parts]
        probes = _probes([len(p) for p in parts])
        for b in batches:
            whole = np.ascontiguousarray(b.column(0).to_numpy())
            for at in range(0, len(whole), TILE):
                fps = whole[at : at + TILE]
                chosen = allocate(candidates(fps, parts, near.value, n), probes)
                for i, part in enumerate(parts):
                    values = taken(fps, part)
                    made = [(values, fps, np.where(chosen[:, i] > 0, 3, 1))]
                    for t in range(1, DISTANCE + 1):
                        who = chosen[:, i] > t
                        v = (values[who][:, None] ^ balls[i][t]).ravel()
                        made.append((v, np.repeat(fps[who], len(balls[i][t])), np.full(len(v), 2)))
                    v, f, role = (np.concatenate(x) for x in zip(*made))
                    arrays = [pa.array(np.full(len(v), i, np.int32)), pa.array(v), pa.array(f), pa.array(role.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _MEETING.split(", ")])

    return run


def forest(a: np.ndarray, b: np.ndarray):
    """Links that connect the same as links between ``a`` and ``b``, fewer than there are members."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        low, onward = np.minimum(label[x], label[y]), label.copy()
        np.minimum.at(onward, label[x], low)
        np.minimum.at(onward, label[y], low)
        while not np.array_equal(onward, further := onward[onward]):
            onward = further
        if np.array_equal(onward, label):
            moved = label != np.arange(len(names))
            return names[label[moved]], names[moved]
        label = onward


def _linked(f, g, role_f, role_g):
    """Where one is indexed and the other probes, and they differ in few bits."""
    fine = ((role_f & 1) & (role_g >> 1)) | ((role_g & 1) & (role_f >> 1))
    return (fine > 0) & (np.bitwise_count(f.view(np.uint64) ^ g.view(np.uint64)) <= DISTANCE)


class _Links:
    """Links found so far, reduced to a forest when they are many."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, a, b):
        if len(a):
            self.held.append((a, b))
            self.size += len(a)
        if self.size > HELD:
            self.held = [self.reduced()]
            self.size = len(self.held[0][0])

    def reduced(self):
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*self.held) if self.held else ((), ())))
        return forest(a, b)

    def batch(self):
        import pyarrow as pa

        out = pa.RecordBatch.from_arrays([pa.array(x) for x in self.reduced()], names=["a", "b"])
        self.held, self.size = [], 0
        return out


def _small(batches):
    """Links within the values of parts; rows come in the order of part and value."""
    rest, links = [np.zeros(0, np.int64)] * 4, _Links()

    def match(columns):
        part, value, fps, role = columns
        new = np.ones(len(part), bool)
        new[1:] = (part[1:] != part[:-1]) | (value[1:] != value[:-1])
        starts = np.flatnonzero(new)
        after = np.repeat(np.diff(np.append(starts, len(part))), np.diff(np.append(starts, len(part)))) - (np.arange(len(part)) - np.repeat(starts, np.diff(np.append(starts, len(part))))) - 1
        x, step = np.arange(len(part)), 1
        while len(x := x[after[x] >= step]):  # members with another one so many places on
            y = x + step
            fine = _linked(fps[x], fps[y], role[x], role[y])
            links.add(fps[x[fine]], fps[y[fine]])
            step += 1

    for b in batches:
        columns = [np.concatenate([r, b.column(k).to_numpy().astype(np.int64)]) for k, r in enumerate(rest)]
        # The last value may go on in the next batch.
        last = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1]) if len(columns[0]) else np.zeros(0, bool)
        cut = len(last) - int(last.sum())
        match([c[:cut] for c in columns])
        rest = [c[cut:] for c in columns]
        if links.size > HELD // 2:
            yield links.batch()
    match(rest)
    yield links.batch()


def _tile(key, table):
    """Links between two blocks of those that meet on one value."""
    import pyarrow as pa

    block, fps, role = (table.column(c).to_numpy().astype(np.int64) for c in ("block", "fp", "role"))
    low, high = (np.flatnonzero(block == key[k].as_py()) for k in (2, 3))
    links = _Links()
    for i in range(0, len(low), 256):
        x, y = (m.ravel() for m in np.meshgrid(low[i : i + 256], high, indexing="ij"))
        fine = _linked(fps[x], fps[y], role[x], role[y]) & (fps[x] != fps[y])
        links.add(fps[x[fine]], fps[y[fine]])
    return pa.Table.from_batches([links.batch()])


def links(fps: DataFrame, parts: int | None = None) -> DataFrame:
    """a and b: links that connect all fingerprints within DISTANCE bits of each other.

    ``fps`` has each fingerprint once, as fp, and is stored.
    """
    spark, only = fps.sparkSession, fps.select("fp")
    n = only.count()
    counted = only.mapInArrow(_together, "at int, together long").groupBy("at").agg(F.sum("together").alias("together"))
    together = np.zeros(BITS * BITS, np.int64)
    for r in counted.collect():  # 64 x 64 numbers
        together[r["at"]] = r["together"]
    groups = group_bits(together.reshape(BITS, BITS), n, parts or parts_for(n))
    pieces = [p for part in groups for p in pieces_of(part)]
    seen = only.mapInArrow(_values(pieces), "piece int, value int, n long").groupBy("piece", "value").agg(F.sum("n").alias("n")).toArrow()
    near = []
    for k, bits in enumerate(pieces):  # at most 65,536 values each
        mine, counts = seen.column("piece").to_numpy() == k, np.zeros(1 << len(bits))
        counts[seen.column("value").to_numpy()[mine]] = seen.column("n").to_numpy()[mine]
        near.append(near_counts(counts).astype(np.float32))
    tables = spark.sparkContext.broadcast(near)
    rows = settle_table(only.mapInArrow(_meetings(groups, tables, n), _MEETING), "meetings")

    large = rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > TILE)
    large = settle_table(large.withColumn("blocks", F.ceil(F.col("rows") / TILE).cast("int")).drop("rows"), "large")
    marked = lookup_join(rows, large, ["part", "value"], "left", spread="fp")
    cold = marked.filter("blocks is null").select(*rows.columns).repartition("part", "value").sortWithinPartitions("part", "value")
    hot = marked.filter("blocks is not null").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    hot = hot.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    found = cold.mapInArrow(_small, _LINKS).unionByName(hot.groupBy("part", "value", "low", "high").applyInArrow(_tile, _LINKS))
    return settle_table(found.distinct(), "links")


def near_groups(documents: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    A null or empty text, or one without words, has the fingerprint zero, which is linked like any
    other. Equal fingerprints are linked, and so are those that differ in at most DISTANCE bits.
    component_id is the smallest doc_id that links lead to, the row's own included; null ids are
    the smallest only where there is no other. Rows that repeat an id are rows of their own. Other
    columns are not read; an empty table gives no rows. ``parts`` is chosen by the number of
    fingerprints unless it is given; it changes no result.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = settle_table(docs.mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    fps = settle_table(docs.groupBy("fp").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("least")), "distinct")
    labels = components(links(fps, parts)).select(F.col("class").alias("fp"), "label")
    labelled = settle_table(fps.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labelled")
    sums = settle_table(labelled.groupBy("label").agg(F.count(F.lit(1)).alias("fps"), F.min("least").alias("component_id")), "components")
    named = keyed_join(labelled.select("fp", "rows", "label"), sums, ["label"], "fps", spread="fp")
    named = settle_table(named.select("fp", "rows", "component_id"), "named")
    out = keyed_join(docs, named, ["fp"], "rows", spread="doc_id")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
