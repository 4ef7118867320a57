"""Stored sketches, merged, against exact figures; and token counts against the library."""

import os

import pytest
from pyspark.sql import functions as F

from funclab.functions.tokens import vocabulary_counter
from funclab.operators import stats
from funclab.operators.finetune import chat_facts


def table(spark, n=40_000):
    return spark.range(n).selectExpr(
        "if(id % 3 = 0, 'rust', 'swift') AS language",
        "if(id % 50 = 7, null, concat('repo', pmod(xxhash64(id), 9000))) AS repo_url",
        "repeat('a\\n', int(pmod(xxhash64(id, 1), 700))) AS code",
        "if(id % 4 = 0, '1,2', null) AS mod_lines",
    )


def test_merged_sketches_stay_within_their_errors(spark, tmp_path):
    raw = table(spark)
    stats.dataset_sketches(raw).write.parquet(f"{tmp_path}/s")
    # A later portion is sketched alone and added to what is stored.
    more = table(spark, 6_000).withColumn("repo_url", F.concat("repo_url", F.lit("-new")))
    stats.dataset_sketches(more).write.mode("append").parquet(f"{tmp_path}/s")
    stored = spark.read.parquet(f"{tmp_path}/s")
    every = raw.unionByName(more)
    for by in ([], ["language"]):
        told = stats.sketched_stats(stats.merged_sketches(stored, by), by, (0.1, 0.5, 0.9)).collect()
        exact = {tuple(r[k] for k in by): r for r in stats.dataset_stats(every, by).collect()}
        assert len(told) == len(exact)
        for r in told:
            mine = every.where(F.col("language") == r["language"]) if by else every
            want = exact[tuple(r[k] for k in by)]
            assert (r.n_lines, r.n_vul_lines) == (want.n_lines, want.n_vul_lines)
            assert abs(r.n_projects - want.n_projects) <= 0.05 * want.n_projects
            lengths = sorted(x[0] for x in mine.select(F.length("code") / 2 + 1).collect())
            for q, cut in zip((0.1, 0.5, 0.9), r.length_quantiles):
                below, upto = (sum(test(x) for x in lengths) / len(lengths) for test in (lambda x: x < cut, lambda x: x <= cut))
                assert below <= q + 0.02 and upto >= q - 0.02
    twice = stats.merged_sketches(stats.merged_sketches(stored, ["language"]))
    assert abs(stats.sketched_stats(twice).first().n_projects - exact_projects(every)) <= 0.05 * exact_projects(every)


def exact_projects(df):
    return df.agg(F.count_distinct("repo_url")).first()[0]


def test_null_projects_count_for_nothing(spark):
    raw = spark.createDataFrame([("a", None, None, None), ("a", "r", "x", "")], "language string, repo_url string, code string, mod_lines string")
    row = stats.sketched_stats(stats.dataset_sketches(raw), ["language"]).first()
    assert (row.n_records, row.n_lines, row.n_projects, row.length_quantiles) == (2, 1, 1, [1, 1, 1])


def test_vocabulary_counts_are_the_library_s(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    read = Tokenizer.from_file(path)
    read.encode_special_tokens = True
    texts = ["", "let x = 1;\n", "naïve café 日本", " <|endoftext|> ", "a" * 5_000, None]
    rows = [(1, texts), (2, None), (3, [])]
    df = spark.createDataFrame(rows, "row_id int, t array<string>").repartition(2)
    got = dict(map(tuple, df.select("row_id", vocabulary_counter(path)(F.col("t"))).collect()))
    count = lambda t: 0 if t is None else len(read.encode(t, add_special_tokens=False).ids)
    assert got == {1: [count(t) for t in texts], 2: None, 3: []}

    chats = spark.createDataFrame([(5, [("user", "hello there", "bob"), ("assistant", "yes", None)])], "row_id int, messages array<struct<role:string,content:string,name:string>>")
    facts = chat_facts(chats, counter=vocabulary_counter(path)).first()
    said = [count(t) for t in ("user", "hello there", "bob", "assistant", "yes")]
    assert (facts.n_tokens, facts.n_assistant_tokens) == (sum(said) + 2 * 3 + 3 + 1, count("yes"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query_without_sql(spark):
    from suite import views
    from suite.queries import NO_SQL

    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    read = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    read.encode_special_tokens = True
    count = lambda t: len(read.encode(t, add_special_tokens=False).ids)
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in views.v_chats(spark, sf).select("row_id", "messages").collect():
        want[r.row_id] = sum(count(m.role) + count(m.content) + 3 for m in r.messages) + 3
    assert {r.row_id: r.n_tokens for r in NO_SQL["chat_tokens_vocabulary"](spark, sf).collect()} == want
