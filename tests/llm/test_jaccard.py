"""The similarity join against all pairs."""

import random

import numpy as np
import pytest

from funclab.llm import jaccard_join as jj
from funclab.llm.katz import _Hashes, tokens


def sets(rows):
    out = []
    for _, t in rows:
        w = tokens(t)
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def brute(rows):
    s = sets(rows)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    ids = [min((r[0] for r, x in zip(rows, label) if x == label[i] and r[0] is not None), default=None) for i in range(len(rows))]
    return [(r[0], len(x), ids[i] if x else r[0]) for i, (r, x) in enumerate(zip(rows, s))]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, passage = [], text(12)
    for n in [1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14, 17, 20, 30, 45, 60, 90, 150, 400, 1500]:
        base = text(n)
        for _ in range(7):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + n // 25 + (n > 8))):
                t[rng.randrange(len(t))] = f"x{rng.randrange(99)}"
            t = t[: len(t) - rng.randrange(1 + n // 12)] + text(rng.randrange(1 + n // 12))
            rows.append(" ".join(t))
    for _ in range(70):  # many texts share a passage and are no copies
        rows.append(" ".join(text(20) + passage + text(20)))
    chain = text(60)
    for k in range(30):  # each is like the next one only
        chain[2 * k] = f"y{k}"
        rows.append(" ".join(chain))
    rows += ["", " \n", "\x1f", rows[0], rows[0].upper(), rows[40], "a b c d", "A  b\tc d", "a b c", "same " * 300, "same " * 200]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [*zip(ids, rows), (900, None), (None, rows[60]), (None, "lone null id here now and then"), (ids[3], rows[3]), (ids[3], "other text under one id")]


@pytest.mark.parametrize("shared", [16, 3])
def test_groups(spark, rows, monkeypatch, shared):
    monkeypatch.setattr(jj, "SHARED", shared)
    monkeypatch.setattr(jj, "BUCKET", 500)
    monkeypatch.setattr(jj, "OPENED", 150)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, class string, size int").repartition(3)
    got = [tuple(r) for r in jj.near_groups(docs).drop("row").collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))


def test_all_links(spark, rows, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    s = sets(rows)
    link = lambda x, y: bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)
    want = [(r[0], len(x), c, sum(link(x, y) for y in s) - bool(x)) for r, x, (_, _, c) in zip(rows, s, brute(rows))]
    assert sorted(map(str, (tuple(r) for r in jj.linked_groups(docs).drop("row").collect()))) == sorted(map(str, want))
    different = list(set(s))
    n = sum(link(x, y) for i, x in enumerate(different) for y in different[:i])
    got = [tuple(r) for r in jj.Join(docs).pairs().collect()]
    assert len(got) == len(set(got)) == n and all(a < b for a, b in got)


def test_one_of_each_group_stays(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string")
    kept = jj.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted(str(r["doc_id"]) for r in kept.collect())
    want = {(c, i if n == 0 else None) for i, n, c in brute(rows) if n and c is not None or n == 0}
    lone = 1  # a text of its own with a null id
    assert len(got) == len(want) + lone
    assert jj.near_groups(docs.filter("false")).count() == 0 and jj.keep_first(docs.filter("false")).count() == 0


def test_linked_sets_always_share_a_key():
    rng = np.random.default_rng(1)
    for n in [*range(1, 60), 100, 333, 1000]:
        for _ in range(30):
            a = rng.integers(0, 1 << 62, n).astype(np.uint64)
            gone, new = rng.integers(0, 1 + n // 5), rng.integers(0, 1 + n // 4)
            b = np.concatenate([a[gone:], rng.integers(0, 1 << 62, new).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if len(b) and 5 * both >= 4 * (len(a) + len(b) - both) and set(a) != set(b):
                assert set(jj.keys_of(a)[0]) & set(jj.keys_of(b)[0])


def test_a_short_text_is_one_shingle():
    h = _Hashes()
    assert len(jj.shingles("a b c", h)) == 1 and len(jj.shingles("a b c d e f", h)) == 2 and len(jj.shingles(None, h)) == 0
    assert jj.shingles("a b c", h)[0] != jj.shingles("a b", h)[0]


def test_sketches_are_read_where_they_lie():
    import pyarrow as pa

    made = [jj.sketch(np.arange(n, n * n, dtype=np.uint64)) for n in range(2, 9)]
    want = np.stack([np.frombuffer(x, np.uint8) for x in made])
    whole = pa.array(made, pa.binary())
    for column in (whole, pa.chunked_array([whole[:2], whole[2:2], whole[2:]]), pa.array(made, pa.large_binary())):
        assert (jj._sketches(column) == want).all() and (jj._sketches(column[3:]) == want[3:]).all()
    assert jj._sketches(whole[:0]).shape == (0, want.shape[1])


def test_a_task_leaves_nothing_in_the_worker():
    """Words that a task has hashed, and what an operator before it kept, are let go."""
    import pyarrow as pa

    from funclab.llm import common

    common.worker_store("other")["held"] = "x"
    batch = pa.record_batch({"class": pa.array([1], pa.int64()), "text": pa.array(["some words of a text"])})
    assert [b.num_rows for b in common.tidy(jj._sets)(iter([batch]))] == [1]
    assert common.worker_store("") == {}
