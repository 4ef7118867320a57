"""Katz scores against a plain evaluation, token by token."""

import collections
import math
import random
import re

import pytest

from funclab.llm import katz


def plain(rows):
    """rows: (doc_id, text, train). The model word by word, from its definition."""
    sents = [(i, re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None], tr) for i, t, tr in rows]
    one, two, own = collections.Counter(), collections.Counter(), collections.Counter()
    for _, s, train in sents:
        if train:
            for h, w in zip(["<s>", *s], s):
                one[w] += 1
                two[h, w] += 1
                own[h] += 1
    hist = lambda c: [0] + [sum(x == r for x in c.values()) for r in range(1, 7)]

    def disc(h):
        d = {}
        over = 6 * h[6] / h[1] if h[1] else 1
        for r in range(1, 6):
            x = ((r + 1) * h[r + 1] / (r * h[r]) - over) / (1 - over) if h[r] and over < 1 else 1
            d[r] = x if 0 < x <= 1 else 1
        return d

    d1, d2, n, v = disc(hist(one)), disc(hist(two)), sum(one.values()), len(one)
    left = n - sum(c * d1.get(c, 1) for c in one.values())
    over = n if left > 1e-9 else n + 1
    unknown = (left if left > 1e-9 else 1) / over
    p1 = lambda w: one[w] * d1.get(one[w], 1) / over if one[w] else unknown
    follow = collections.defaultdict(list)
    for (h, w), c in two.items():
        follow[h].append((w, c))

    def p2(h, w):
        if not own[h]:
            return p1(w)
        lost = own[h] - sum(c * d2.get(c, 1) for _, c in follow[h])
        total, lost = (own[h], lost) if lost > 1e-9 else (own[h] + 1, 1)
        if two[h, w]:
            return two[h, w] * d2.get(two[h, w], 1) / total
        return lost / total / (1 - sum(p1(x) for x, _ in follow[h])) * p1(w)

    for h in [*list(own)[:20], "<s>"]:  # exactly normalised, with all words never seen as one
        assert math.isclose(sum(p2(h, w) for w in [*one, "never seen"]), 1, rel_tol=1e-9)
    return {
        (i, tuple(s)): (len(s), sum(one[w] > 0 for w in s), n, sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in s), sum(math.log10(p2(h, w)) for h, w in zip(["<s>", *s], s)))
        for i, s, _ in sents
    }


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    word = lambda: rng.choice(["The", "the", "a"]) if rng.random() < 0.5 else f"w{int(rng.expovariate(0.02))}"
    rows = [(i, " ".join(word() for _ in range(rng.randrange(60))), i % 5 != 1) for i in range(200)]
    return [*rows, (300, None, True), (301, "", False), (302, "\x1f é É\x85x\tthe", True), (None, "never met words", False), (5, rows[5][1], True), (303, "the w1 " * 5000, True)]


@pytest.mark.parametrize("block,bucket,hot", [(10**6, 10**6, 10**6), (700, 900, 10**6), (700, 500, 300)])
def test_scores(spark, rows, monkeypatch, block, bucket, hot):
    monkeypatch.setattr(katz, "HOT", hot)
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, t boolean, score string").repartition(3)
    got = katz.score(docs, F.col("t"), ~F.col("t"), block, bucket).collect()
    want = plain(rows)
    by_id = {}
    for (i, _), w in want.items():
        by_id.setdefault(i, w)
    assert len(got) == len(rows)
    for r in got:
        w = by_id[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
        assert math.isclose(r["base_score"], w[3], rel_tol=1e-9) and math.isclose(r["score"], w[4], rel_tol=1e-5), (r, w)


def test_nothing_to_learn_from(spark, rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string, t boolean")
    assert katz.score(docs.filter("false"), F.lit(True), F.lit(False)).count() == 0
    got = katz.score(docs, F.lit(False), F.lit(None).cast("boolean")).collect()
    assert len(got) == len(rows) and {r["train_tokens"] for r in got} == {0} and all(math.isfinite(r["score"]) for r in got)
