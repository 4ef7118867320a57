"""The trie of conversations against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from funclab.llm import common, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    own, rebuilt, nodes, children, out = {}, {}, {}, {}, {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
        for d in range(len(rebuilt[c]) + 1):
            nodes.setdefault(tuple(rebuilt[c][:d]), []).append(c)
    for node in nodes:
        if node:
            children.setdefault(node[:-1], []).append(node)
    for node in sorted(nodes, key=len, reverse=True):
        members, below = nodes[node], children.get(node, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(node))))
        out[node] = (
            min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(below),
            sum(out[b][5] for b in below) or 1, (len(members) - 1) * words + sum(out[b][6] for b in below), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(out.values(), key=str)


def talks(seed):
    rng = random.Random(seed)
    places = {(rng.randrange(-60, 60), rng.randrange(1000)) for _ in range(150)}
    rows = [(c, t, rng.choice(["u", "a", None]), rng.choice(["", "x", "x y", None, "z  w\tq"])) for c, t in sorted(places)]
    rows += [(c, t, "u", f"long {t % 7}") for c, n in ((200, 40), (220, 45), (221, 1)) for t in range(n)]
    return [*rows, (40, None, "u", "before all"), (None, 1, "u", "nobody's"), (300, None, None, None)]


def same(spark, rows):
    seen = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((tuple(r) for r in seen), key=str) == plain_trie(rows)


def test_trie(spark):
    same(spark, talks(1))


def test_segments_hot_keys_and_a_full_sketch(spark, monkeypatch):
    """Long conversations are cut, hot nodes looked up, and where the sketch proves nothing all is grouped."""
    monkeypatch.setattr(prefix_trie, "SEGMENT", 5)
    monkeypatch.setattr(prefix_trie, "SLICE", 64)
    monkeypatch.setattr(prefix_trie, "MOST_CELLS", 64)
    monkeypatch.setattr(prefix_trie, "LISTED", 3)
    monkeypatch.setattr(common, "HOT_KEY", 3)
    same(spark, talks(2))


@pytest.mark.parametrize("rows", [[], [(None, 0, "u", "a")], [(7, 0, "u", "a b")], [(20, 0, "u", "a"), (20, 0, "u", "a")]])
def test_few_rows(spark, rows):
    same(spark, rows)


def test_clashing_names(spark):
    rows = [(c, t, "u", f"{c % 2} {t}", 5, "x") for c in range(30) for t in range(3)]
    source = spark.createDataFrame(rows, SCHEMA + ", depth int, shared string")
    seen = prefix_trie.trie(source).collect()
    assert sorted((tuple(r) for r in seen), key=str) == plain_trie([r[:4] for r in rows])


def test_sketch_never_takes_a_shared_prefix_for_single(spark):
    rng = np.random.default_rng(3)
    digests = rng.integers(-(1 << 62), 1 << 62, 3_000)
    rows = [(1, int(d)) for d in np.concatenate([digests, digests[:500]])]
    bits = prefix_trie.sketch(spark.createDataFrame(rows, "depth long, a long").repartition(4))
    held = [bits[k][(at := prefix_trie.cells_of(digests, k, bits.shape[1] * 8)) >> 3] >> (at & 7).astype(np.uint8) & 1 for k in range(prefix_trie.HASHES)]
    shared = np.all(held, axis=0)
    assert shared[:500].all() and shared[500:].mean() < 0.01
