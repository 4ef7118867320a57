"""SimHash fingerprints and their components against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from funclab.llm import common, simhash

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_groups(docs):
    prints = [plain_fingerprint(text) for _, text in docs]
    group = list(range(len(docs)))
    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {g: min(doc_id for (doc_id, _), h in zip(docs, group) if h == g) for g in set(group)}
    return {doc_id: (format(p, "016x"), first[g]) for (doc_id, _), p, g in zip(docs, prints, group)}


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)]
    long = [word() for _ in range(400)]
    for _ in range(120):
        copy = list(long)
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    texts += [None, "", " \t\n", "one", "One", "two words", "TWO words", *texts[:5], *texts[70:75]]
    return list(enumerate(texts, start=10))


@pytest.mark.parametrize("parts", [None, 3, 2])
def test_groups(spark, parts):
    docs = corpus()
    seen = simhash.near_groups(spark.createDataFrame(docs, SCHEMA).repartition(3), parts).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in seen} == plain_groups(docs)


def test_crowds(spark, monkeypatch):
    """Values and keys that many share go another way, with the same groups."""
    monkeypatch.setattr(simhash, "TILE", 20)
    monkeypatch.setattr(simhash, "HELD", 30)
    monkeypatch.setattr(common, "HOT_KEY", 3)
    docs = corpus(4)
    seen = simhash.near_groups(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in seen} == plain_groups(docs)


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, " ", 0), (3, "a b", 0), (3, "A  B", 0), (None, "q", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    seen = sorted((tuple(r) for r in simhash.near_groups(docs).collect()), key=str)
    ab, q = format(plain_fingerprint("a b"), "016x"), format(plain_fingerprint("q"), "016x")
    zero = "0" * 16
    assert seen == sorted([(1, zero, 1), (2, zero, 1), (None, zero, 1), (3, ab, 3), (3, ab, 3), (None, q, None)], key=str)
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_long_text():
    text = " ".join(f"w{k % 977}" for k in range(3 * simhash.HASHED // 2))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_allocation():
    """Thresholds sum up as the principle needs and cost the least of all ways."""
    rng = np.random.default_rng(1)
    probes = simhash._probes([16] * 4)
    found = rng.integers(0, 100_000, (4, 50, 4)).astype(float).cumsum(axis=2)
    chosen = simhash.allocate(found, probes)
    assert (chosen.sum(axis=1) == 4).all()
    cost = lambda q, way: sum(found[i, q, t - 1] + simhash.PROBE * probes[i, t - 1] for i, t in enumerate(way) if t)
    ways = [w for w in np.ndindex(5, 5, 5, 5) if sum(w) == 4]
    for q in range(50):
        assert cost(q, chosen[q]) == pytest.approx(min(cost(q, w) for w in ways))


def test_parts_hold_all_bits_and_correlated_ones_meet():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (5_000, 64))
    bits[:, 40] = bits[:, 3]
    parts = simhash.group_bits(bits.T @ bits, len(bits), 4)
    assert sorted(b for p in parts for b in p) == list(range(64)) and {len(p) for p in parts} == {16}
    assert any({3, 40} <= set(p) for p in parts)
    assert simhash.parts_for(1_000) == 4 and simhash.parts_for(10**11) == 2
