"""Repeated strings against a table of all strings."""

import collections
import hashlib
import random

import pytest

from funclab.llm import suffix_dedup as sd


def brute(rows, n=sd.LENGTH):
    seen = collections.Counter(t[i : i + n] for _, t in rows for i in range(len(t) - n + 1))
    out = []
    for doc_id, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((-1 if doc_id is None else doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abé d") for _ in range(n))
    passages = [text(n) for n in (395, 399, 400, 401, 450, 700, 1500, 3000)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            s = rng.randrange(1 + len(p) // 3)
            parts += [text(rng.randrange(300)), p[s : len(p) - rng.randrange(1 + len(p) // 3)]]
        rows.append("".join([*parts, text(rng.randrange(200))]))
    rows += [rows[3], rows[3], None, "", "x" * 399, "y" * 400, "z" * 401, "ab" * 900, "q" * 3000, text(500) * 2, passages[2], passages[3][1:]]
    rows += ["héllo " * 2000, text(20_000) + passages[6], text(900)[:400] + text(10)]
    return [*enumerate(rows), (None, rows[5]), (3, rows[3]), (3, text(450))]


@pytest.mark.parametrize("broadcast", [True, False])
def test_spans(spark, rows, monkeypatch, broadcast):
    monkeypatch.setattr(sd, "MAX_ROWS", 10**6 if broadcast else 0)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row int, spans int").repartition(4)
    got = sd.summary(docs).collect()
    want = brute([(i, (t or "").encode()) for i, t in rows])
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == want


def test_texts_without_repeats(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sd.remove(docs)
    assert out.schema == docs.schema and out.count() == len(rows)
    want = brute([(i, (t or "").encode()) for i, t in rows])
    left = sorted((-1 if r["doc_id"] is None else r["doc_id"], len((r["text"] or "").encode())) for r in out.collect())
    for (i, n), (j, size, gone, *_) in zip(left, sorted((a, b, c) for a, b, c, *_ in want)):
        assert i == j
    assert sum(n for _, n in left) <= sum(w[1] - w[2] for w in want)
    clashing = docs.withColumn("row", docs.doc_id)
    assert sd.remove(clashing).columns == clashing.columns
    assert sd.remove(docs.filter("false")).count() == 0 and sd.summary(docs.filter("false")).count() == 0


def test_documents_looked_at_together_do_not_matter(spark, rows, monkeypatch):
    monkeypatch.setattr(sd, "TOGETHER", 1000)
    docs = spark.createDataFrame(rows[:30], "doc_id long, text string")
    assert sorted(map(tuple, sd.summary(docs).collect())) == brute([(i, (t or "").encode()) for i, t in rows[:30]])
