"""The pipeline stage by stage on planted cases."""

import random

import corpus_pipeline as cp

from funclab.llm.queries import QUERIES


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abdefghiklmnoprstu") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(30) for _ in range(5)]
    clean = [text(rng.randrange(60, 200)) for _ in range(120)]
    passage = text(90)
    rows = [*clean, clean[0], " ".join([*clean[1].split()[:-2], "zz", "yy"]), f"{text(40)} {passage} {text(40)}", f"{text(50)} {passage} {text(30)}"]
    rows += [f"{text(20)} {items[2]} {text(20)}", "12 34 !!", "", None, f"{text(400)} {items[1][:60]}"]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "xx", "s", len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path)
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    kept, n = docs, len(clean)
    left = []
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
        left.append({r["doc_id"]: r["text"] for r in kept.collect()})
    assert not {n + 5, n + 6, n + 7} & set(left[0]) and len(left[0]) > 80  # two languages that cannot be told apart
    same = lambda a, b: a in left[0] and b in left[0]
    assert set(left[0]) - set(left[1]) == {b for a, b in ((0, n), (1, n + 1)) if same(a, b)}
    if same(n + 2, n + 3):
        assert passage[5:-5] not in left[2][n + 2] and passage[5:-5] not in left[2][n + 3] and len(left[2][n + 2]) > 300
    assert all(left[2][i] == left[1][i] for i in left[1] if i not in (n + 2, n + 3))
    assert set(left[2]) - set(left[3]) == {n + 4} & set(left[2])
    packed = cp.STAGES[-1][1](spark, kept, sf)
    assert {r["doc_id"] for r in packed.collect()} == set(left[3])
    whole = cp.run(spark, sf)
    assert whole.agg({"length": "sum"}).first() == packed.agg({"length": "sum"}).first()


def test_a_query_for_each_operator():
    assert [name.split("_")[0] for name in sorted(QUERIES, key=lambda x: int(x[2:].split("_")[0]))] == [f"op{n}" for n in range(1, 14)]
    assert [s[0] for s in cp.STAGES] == ["language", "near duplicates", "repeats", "benchmarks", "packing"]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Names that operators work with are the document's own; null ids and repeated rows are fine."""
    extra = ["row", "_row", "bad", "_bad", "spans", "_spans", "salt", "_language", "_share", "class", "label", "size", "key"]
    rows = [(1, "ein kleiner Satz mit Worten und noch mehr davon", "de"), (2, "a small sentence with words and some more of them", "en"), (2, "a small sentence with words and some more of them", "en"), (None, None, None), (4, "", "en")]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame([(*r, *[f"{c} {i}" for c in extra]) for i, r in enumerate(rows)], schema)
    spark.createDataFrame([(1, "nothing of that")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = {str(sorted(r.asDict().items(), key=str)) for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        assert {str(sorted(r.asDict().items(), key=str)) for r in kept.collect()} <= given, name


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of that")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
