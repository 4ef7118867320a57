"""WARC round trips and page texts."""

import hashlib
import random

import pytest

from funclab.llm import page_text, warc


@pytest.fixture
def pages(spark):
    long_ = "<p>" + "wörd " * 40_000
    copy = "x" * 150
    rows = [(1, "http://a.org/x", copy), (2, "http://a.org/y", copy), (None, "http://a.org/z", copy), (1, "http://a.org/x", copy)]
    rows += [(3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "http://b.org/\r\nq", long_), (8, "c", long_), (9, "c", "0\r\n\r\nWARC/1.1\r\n\r\n" * 20)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def test_round_trip_with_segments_over_files(spark, pages):
    where, files = warc.write_archives(pages, segment=1000, file_bytes=3000)
    assert files.count() > 3
    rows = warc.read_archives(where, files).collect()
    assert len(rows) == pages.count()
    texts = {(r["page_id"], r["html"]) for r in pages.collect()}
    for r in rows:
        if r["record_type"] == "response":
            assert (r["page_id"], r["payload"].decode() or None) in texts or (r["page_id"], r["payload"].decode()) in texts
            assert hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"]
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in rows)
    assert kinds == [
        (0, "revisit", 1), (1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "response", None),
        (5, "response", None), (6, "response", None), (7, "response", None), (8, "revisit", 7), (9, "response", None),
    ]


def test_each_file_is_read_by_a_task_of_its_own(spark, pages):
    where, files = warc.write_archives(pages.repartition(6), segment=1000, file_bytes=3000)
    n = files.count()
    dealt = files.select("file").repartitionByRange(n, "file")
    assert n > 5 and dealt.rdd.glom().map(len).collect() == [1] * n
    tasks = warc.read_archives(where, files).inputFiles()  # a part file for each task that read archives
    assert len(tasks) >= n


def test_no_pages(spark, pages):
    where, files = warc.write_archives(pages.filter("false"))
    assert warc.read_archives(where, files).count() == 0


def test_damage_is_noticed():
    payload = b"z" * 5000
    made = list(warc.records(1, "u", payload, hashlib.sha256(payload).hexdigest(), None, None, segment=1000))
    import io

    parts = []
    for head, block in warc.parse(io.BytesIO(b"".join(made))):
        total = head.get("warc-segment-total-length")
        parts.append((int(head["warc-segment-number"]), total and int(total), head, block))
    random.Random(1).shuffle(parts)
    assert warc.assemble(parts)[5] == payload
    with pytest.raises(ValueError):
        warc.assemble(parts[1:])
    with pytest.raises(ValueError):
        warc.assemble([(n, t, h, b + b"q") for n, t, h, b in parts])
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc")
    for size in (0, 1, 8191, 8192, 20000):
        assert warc.unchunked(warc.chunked(b"q" * size)) == b"q" * size


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav><div class="ad box">Buy</div><div id="cookie-notice">We use</div>
<article class="post"><header><h1>Head &amp;  line</h1></header><p title="a>b">One <b>two</b>
three<p>Four &lt;five&gt; 5 < 6<br>six<!-- hid --><aside>Side</aside><form><input><button>Send</button></form>
<div style="display: none">Hidden</div><blockquote>Quote</blockquote><section class="comments"><p>First!</p></section></article>
<footer>&copy; all</footer>"""


def test_blocks():
    assert page_text.blocks(PAGE) == ["Head & line", "One two three", "Four <five> 5 < 6 six", "Quote"]
    assert page_text.blocks(None) == page_text.blocks("") == []
    assert page_text.blocks("just text") == ["just text"]
    assert page_text.blocks("<p>cut off <b") == ["cut off"] and page_text.blocks('<p class="x>y') == ["y"]
    assert page_text.blocks("<article>  </article><p>a") == ["a"]
    assert page_text.blocks("<p>" + "a<b>" * 30_000)[0].startswith("aaa")


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines():
    rng = random.Random(3)
    for _ in range(2000):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(10))] for _ in range(2))
        for most in (1 << 29, 6):
            got = page_text._common(a, b, list(range(len(a))), most)
            rest = iter(b)
            assert len(got) == longest(a, b) and got == sorted(set(got)) and all(a[i] in rest for i in got)
    assert page_text.common(["x", "s", "t"], ["s", "q", "t"]) == [1, 2]
    assert page_text.shared_lines([1, 2, 3], [5, 5, 100], [1, 2, 9]) == [0, 1] and page_text.shared_lines([1, 2], [5, 5], [1, 2]) == []


def test_neighbours_on_any_partitioning(spark):
    body = "<p>Top story of the day<p>{}<p>All rights"
    rows = [(i, f"http://h.org/news/{i:03d}", body.format(f"Text number {i} " * 9)) for i in range(40)]
    rows += [(40, "http://h.org/other", body.format("Text number 3 " * 9)), (41, "http://lone.org/a", body.format("z")), (42, None, None), (43, "", "<p>n")]
    rows += [rows[5], (44, "http://h.org/news/005", rows[5][2]), (None, "http://lone.org/b", "<p>q")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    answers = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        answers.append(sorted((r["page_id"] or -1, r["text"], r["n_chars"]) for r in page_text.main_text(pages).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert answers[0] == answers[1] and len(answers[0]) == len(rows)
    got = {k: text for k, text, _ in answers[0]}
    assert got[7] == ("Text number 7 " * 9).strip() and all(n == len(t) for _, t, n in answers[0])
    assert got[41] == "Top story of the day\nz\nAll rights" and got[42] == "" and got[43] == "n"
    assert "Text number 5" in got[5] and "Text number 5" in got[44]
    assert page_text.main_text(pages.filter("false")).count() == 0


def test_lines_of_a_marked_article_stay(spark):
    """Whoever else has them: quotes, licence lines and near copies are the article's own."""
    site = "<p>Menu line</p><article><h1>Story {0}</h1><p>{1}</p><p>He said: it will be fine.</p><p>This work is licensed.</p></article><p>Site line</p>"
    plain = "<p>Menu line</p><p>{1}</p><p>Site line</p>"
    rows = [(i, f"http://h.org/n/{i:03d}", site.format(i, f"Words of story {i // 2}. " * 5)) for i in range(20)]
    rows += [(100 + i, f"http://h.org/m/{i:03d}", plain.format(i, f"Other words {i}. " * 5)) for i in range(20)]
    out = {r["page_id"]: r["text"] for r in page_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(20):
        story = (f"Words of story {i // 2}. " * 5).strip()
        assert out[i] == f"Story {i}\n{story}\nHe said: it will be fine.\nThis work is licensed."
        assert out[100 + i] == (f"Other words {i}. " * 5).strip()
