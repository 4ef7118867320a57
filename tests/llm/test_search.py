"""Benchmark passages, neighbours and languages on small tables with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from funclab.llm import decontamination, language, neighbours


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, tests, n=13):
    out = []
    for doc_id, text in docs:
        w, hit, items = words(text), set(), set()
        for item, body in tests:
            b = words(body)
            size = min(n, len(b))
            grams = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if b else set()
            for i in range(len(w) - size + 1):
                if size and tuple(w[i : i + size]) in grams:
                    hit |= set(range(i, i + size))
                    items.add("" if item is None else str(item))
        names = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc_id or -1, len(w), len(hit), len(items), names, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "c", "De", "É", "ΑΣ", "x9"])
    tests = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 12, 13, 14, 20])))) for i in range(25)]
    tests += [(99, None), (98, " ,. "), (None, "q r s t u v w x y z q r s t u"), (3, tests[3][1]), (97, "ΑΣ.Α kk")]
    docs = [(i, ", ".join(word() for _ in range(rng.randrange(60)))) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "..."), (None, "--Q R s t U v w x y z Q r s t u"), (7, docs[7][1]), (7, "other " + docs[8][1]), (53, "ΑΣ,Α KK")]
    docs += [(54, "filler words " * 3000 + tests[5][1] + " . " + tests[7][1]), (55, "A b " * 2000)]
    return docs, tests


def test_passages(spark, texts):
    docs, tests = texts
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item string, row int").repartition(4)
    t = spark.createDataFrame(tests, "item_id long, text string")
    got = decontamination.contamination(d, t).drop("row").collect()
    assert sorted((r[0] or -1, *r[1:]) for r in got) == brute(docs, tests)
    kept = decontamination.clean(d, t)
    bad = {(r[0]) for r in brute(docs, tests) if r[5]}
    assert kept.columns == d.columns and {r["doc_id"] or -1 for r in kept.collect()} >= {i or -1 for i, _ in docs} - bad
    assert decontamination.contamination(d.filter("false"), t).count() == 0
    assert decontamination.contamination(d, t.filter("false")).agg({"n_hit": "sum"}).first()[0] == 0


def test_two_texts_under_one_id(spark):
    rng = random.Random(9)
    bodies = [[f"{k}{i}" for i in range(13)] for k in ("p", "q", "r", "s")]
    # The terms of one text at each id are rarer than all of the other's.
    docs = [(i, " ".join(body)) for i, body in enumerate(bodies)] + [(10 + i, " ".join(rng.sample(body, 13))) for i in range(5) for body in bodies[::2]]
    tests = [(4, docs[0][1]), (4, docs[1][1]), (None, docs[2][1]), (None, docs[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame(tests, "item_id long, text string")
    got = decontamination.contamination(d, t).drop("row").collect()
    # As in brute, an id of 0 is -1.
    assert sorted((r[0] or -1, *r[1:]) for r in got) == brute(docs, tests) and sum(r[-1] for r in got) == 4
    assert not {0, 1, 2, 3} & {r["doc_id"] for r in decontamination.clean(d, t).collect()}


def test_passages_without_broadcast(spark, texts, monkeypatch):
    from funclab.plans import settle

    monkeypatch.setattr(settle, "MAX_BROADCAST_ROWS", 1)
    docs, tests = texts[0][:45], texts[1]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontamination.contamination(d, spark.createDataFrame(tests, "item_id long, text string")).drop("row").collect()
    assert sorted((r[0] or -1, *r[1:]) for r in got) == brute(docs, tests)


def test_proximity(spark):
    item = " ".join(f"w{i}" for i in range(13))
    d = spark.createDataFrame([(1, item.replace("w3", "zz w3")), (2, "w2 " + "x " * 40 + "w3"), (3, "nothing"), (4, " w0 w1 w4 w5 w6 w7 w8 w9 w10 w11 w12" * 3)], "doc_id long, text string")
    index = decontamination.Index(d, spark.createDataFrame([(9, item)], "item_id long, text string"))
    rows = {r["row"] for r in index.proximity(5).collect()}
    ids = {r["doc_id"] for r in index.docs.collect() if r["row"] in rows}
    assert 1 in ids and 2 not in ids and 3 not in ids
    assert not [h for r in index.phrases().collect() for h in r["hits"] or []]


def test_passage_plan_is_native(spark, texts):
    d, t = (spark.createDataFrame(x, s) for x, s in zip(texts, ("doc_id long, text string", "item_id long, text string")))
    plan = decontamination.contamination(d, t)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(600)]
    rows += [(1000 + i, rows[100][1]) for i in range(200)] + [(2000, None), (2050, []), (2100, [0.0] * 8), (2150, [float("nan")] * 8), (2200, [1.0, None])]
    rows += [(None, rows[1][1]), (2250, [1.0]), (2300, [float("inf")] * 8), rows[100], (2350, [2 * x for x in rows[50][1]])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in neighbours.nearest(table, fit_rows=150, n_trees=8, probes=400, leaf=16).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    fine = [(i, np.pad(v, (0, 8 - len(v)))) for i, v in dict((i, v) for i, v in rows if i is not None and v and None not in v).items() if np.isfinite(v).all() and any(v)]
    hit = all_ = 0
    for i, v in fine:
        if i % 50:
            continue
        scores = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12), j) for j, w in fine if j != i)[:5]
        mine = sorted(got[i])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5] and i not in {j for _, j, _ in mine}
        hit, all_ = hit + len({j for _, j, _ in mine} & {j for _, j in scores}), all_ + 5
    assert set(got) == {i for i, _ in fine if i % 50 == 0} and hit / all_ > 0.9
    assert [j for _, j, _ in sorted(got[1050])] == [100, 1000, 1001, 1002, 1003]
    assert neighbours.nearest(table.filter("false")).count() == 0
    assert neighbours.nearest(table.filter("vec_id in (50, 51)")).count() == 1


def test_forest_cuts_leaves_evenly():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    f = neighbours.Forest.fit(x[:1000], 3, 32, extra=2)
    at = f.leaves(x.astype(np.float32))
    assert np.bincount(at[0]).max() < 200
    own = [(t, int(at[t, 5])) for t in range(3)]
    assert set(own) <= set(f.search(x[5].astype(np.float32), 60))


def test_neighbours_of_a_table_several_times_the_sample(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((8000, 32))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in neighbours.nearest(table, every=200, fit_rows=1000, n_trees=8, probes=60, leaf=16).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = {q: set(np.argsort(-(x @ x[q]))[1:6].tolist()) for q in range(0, 8000, 200)}
    assert sum(len(got[q] & want[q]) for q in want) / (5 * len(want)) > 0.9


def test_language(spark):
    rng = random.Random(8)
    kinds = {"aa": "the of and in house river green", "bb": "der die und haus fluss grün", "cc": "le la et maison rivière vert"}
    rows = [(i, " ".join(rng.choice(kinds[k].split()) for _ in range(rng.randrange(4, 80))), k) for i in range(600) for k in [rng.choice("aab ccc bb".replace(" ", "")) * 2]]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !", "cc"), (903, "the river", None), (None, "the green river", "zz"), (904, "der fluss " * 20_000, "bb")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = language.LanguageModel.train(docs.filter(~language.held_out()))
    assert model.classes == ["aa", "bb", "cc"]
    got = model.predict(docs.withColumn("held_out", language.held_out()))
    assert got.columns == ["doc_id", "text", "lang", "held_out", "lang_pred", "score"]
    got = got.collect()
    held = [r for r in got if r["held_out"] and r["lang"] in kinds and r["text"] and len(r["text"]) > 9]
    assert len(held) > 100 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {900, 901, 902}
    again = language.LanguageModel.train(docs.filter(~language.held_out()))
    assert (again.weights == model.weights).all() and again.temperature == model.temperature
    none = language.LanguageModel.train(docs.filter("lang is null"))
    assert none.scores("text") == ("und", 0.0) and none.predict(docs.filter("false")).count() == 0
    assert language.LanguageModel.train(docs.filter("lang = 'aa'")).scores("le") == ("aa", 1.0)
