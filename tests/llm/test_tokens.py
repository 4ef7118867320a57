"""Token ids, packing and token files against the plain library."""

import functools
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from funclab.llm import packing, token_output, tokens
from funclab.llm.queries import vocabulary

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
ODD = [
    "", " ", "\n", "a", " a", "a ", "a  b", "a \n b", "x\x1cy", "x!\x1c y", "  two", "don't stop <|endoftext|> now", "é́ x",
    "tab\tand nbsp 　 wide", "İstanbul ΣΑΣ", "😀 😀\n\n\nq", "a b ́c", "9 99 999", "it's 'tis we'll\r\n",
    "a\n\nb", "I'M don't'll'x", "~^!! 12a3 A1B2", "\x00\x01 \x7f", "a\x0bb\x0c",
]


@functools.cache
def library(path):
    tk = Tokenizer.from_file(path)
    tk.encode_special_tokens = True
    return tk


def plain(path, text):
    return library(path).encode(text, add_special_tokens=False).ids


def words(data):
    return list(struct.unpack(f"<{len(data) // 4}I", data))


@pytest.mark.parametrize("path,spaced", [(BYTE, True), (WORD, False)])
def test_ids_are_the_librarys(path, spaced):
    enc = tokens.TextEncoder(path, spaced)
    for text in ODD + [a + b for a in ODD for b in ODD]:
        assert words(enc.encode(text)) == plain(path, text), repr(text)
    assert enc.encode(None) == b""


ENC = tokens.TextEncoder(BYTE, True), tokens.TextEncoder(WORD, False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sé. \n\t \x1ćΣ1")), max_size=25))
def test_ids_of_any_text(text):
    assert words(ENC[0].encode(text)) == ENC[0].tokenizer.encode(text, add_special_tokens=False).ids
    assert words(ENC[1].encode(text)) == ENC[1].tokenizer.encode(text, add_special_tokens=False).ids


def test_kept_words_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 3)
    kept = tokens._Kept(lambda w: w.encode())
    assert [kept[w] for w in "abcabdefgab"] == [w.encode() for w in "abcabdefgab"]
    assert len(kept) <= 3 and len(kept.older) <= 3


@pytest.fixture
def docs(spark):
    rows = [(i, ("word%d " % i) * (1 + 37 * i % 900), "x", i) for i in range(60)]
    rows += [(60, None, None, 1), (61, "", "x", 2), (None, "null id", "x", 3), (7, rows[7][1], "x", 4), (62, "long text " * 9000, "x", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, start long").repartition(5)


def test_packing(spark, docs):
    rows = [r.asDict() for r in packing.pack(docs, WORD, window=512, open_windows=4).collect()]
    total = sum(r["length"] for r in rows)
    by_window, by_doc = {}, {}
    for r in rows:
        by_window.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    for pieces in by_window.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 512
    assert sum(sum(p["length"] for p in w) < 512 for w in by_window.values()) <= 1
    want = 0
    for r in docs.collect():
        ids = plain(WORD, r["text"] or "") + [2]
        want += len(ids)
        pieces = sorted(by_doc[r["doc_id"]], key=lambda p: p["start"])
        assert {p["doc_tokens"] for p in pieces} == {len(ids)}
        for p in pieces:
            part = ids[p["start"] : p["start"] + p["length"]]
            assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == p["ids_crc32"]
        assert sum(p["length"] for p in pieces) == len(ids) * (2 if r["doc_id"] == 7 else 1)
    assert total == want


def test_merging_goes_on_over_groups(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "MERGED", 2)
    rows = packing.pack(docs, WORD, window=512, open_windows=4).groupBy("sequence_id").sum("length").collect()
    assert sum(r[1] < 512 for r in rows) <= 1
    assert sum(r[1] for r in rows) == sum(len(plain(WORD, r["text"] or "")) + 1 for r in docs.collect())


def test_empty_tables(spark, docs):
    none = docs.filter("false")
    assert packing.pack(none, WORD).count() == 0
    store = token_output.TokenStore.write(none, BYTE, 0)
    assert store.fetch(store.keys()).count() == 0


def test_perfect_hash():
    hashes = token_output.mixed(np.arange(5000, dtype=np.uint64), 9)
    table = token_output.PerfectHash.build(hashes)
    assert sorted(table.place(hashes)) == list(range(5000))
    back, _ = token_output.PerfectHash.from_bytes(b"xx" + table.to_bytes(), 2)
    assert (back.place(hashes) == table.place(hashes)).all()
    data = token_output.bucket_bytes(hashes, np.zeros(5000), np.arange(5000), np.arange(5000) * 2)
    entries, there = token_output.look_up(data, hashes)
    assert there.all() and (entries["first"] == np.arange(5000)).all() and (entries["length"] == 2 * np.arange(5000)).all()
    assert token_output.look_up(data, token_output.mixed(np.arange(5000, 9000, dtype=np.uint64), 9))[1].sum() == 0
    with pytest.raises(ValueError):
        token_output.PerfectHash.build(np.array([3, 3], np.uint64))


def test_token_files(spark, docs):
    store = token_output.TokenStore.write(docs, BYTE, 0)
    rows = store.fetch(store.keys(), with_ids=True).collect()
    want = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    at = 0
    got = {(r["key"], r["copy"]): r for r in rows}
    assert len(got) == len(rows) == len(want) and (7, 1) in got
    seen = {}
    for r in want:
        copy = seen[r["doc_id"]] = seen.get(r["doc_id"], -1) + 1
        ids = plain(BYTE, r["text"] or "") + [0]
        row = got[r["doc_id"], copy]
        assert words(row["ids"]) == ids and row["start"] == at and row["n_tokens"] == len(ids)
        assert row["ids_crc32"] == zlib.crc32(row["ids"])
        at += len(ids)
    asked = spark.createDataFrame([(7, 0), (7, 5), (999, 0)], "key long, copy long")
    assert [(r["key"], r["copy"]) for r in store.fetch(asked).collect()] == [(7, 0)]


def test_latin_words_are_cut_as_the_library_does():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from funclab.llm import tokens

    path = public.path("byte_bpe_50k.json")
    read, own = Tokenizer.from_file(path), tokens.TextEncoder(path, True)
    read.encode_special_tokens = True
    rng = random.Random(4)
    latin = [chr(c) for c in range(0xC0, 0x250)]
    signs = [*"abcXYZ'019 .,-!", *latin, "\u0301", "ß", "ı", "İ", "×", "÷", "µ", "ª", "日", "\u00a0"]
    texts = ["".join(rng.choice(signs if k % 2 else latin + list("aeiou ' 1.")) for _ in range(rng.randint(1, 30))) for k in range(4000)]
    texts += ["".join(latin), " ".join(latin), "l'été d'où", "naïve'll", "Größe2x", "São-Paulo"]
    for text in texts:
        ids = read.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids, text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aZ'séÉßÑçŸİıſǅǰÿƻǃ ,.$9İ")), max_size=25))
def test_ids_of_latin_words(text):
    assert words(ENC[1].encode(text)) == ENC[1].tokenizer.encode(text, add_special_tokens=False).ids


def test_latin_words_are_cut_here(monkeypatch):
    """A call of the whole library for each new word took most of the time."""
    for path, spaced in ((BYTE, True), (WORD, False)):
        enc = tokens.TextEncoder(path, spaced)
        monkeypatch.setattr(enc, "_whole", None)
        assert words(enc.encode("Größe, l'Été d'ÿ $ñ9")) == plain(path, "Größe, l'Été d'ÿ $ñ9")


def test_a_text_is_cut_at_once():
    """Words with their marks and line ends, which are nearly all new, took most of the time and memory."""
    texts = [f"wörd{k},\nÉté{k}. and\u00a0{k}!\n\n" for k in range(30)]
    for path, spaced in ((BYTE, True), (WORD, False)):
        enc = tokens.TextEncoder(path, spaced)
        for text in texts:
            assert words(enc.encode(text)) == plain(path, text)
        assert not enc.words and len(enc.parts) <= 50


def test_odd_texts_are_cut_at_once_as_the_library_does():
    rng = random.Random(8)
    signs = [*"abSTst019''  \n\n\t\r_.,-!", "\x0b", "\x1c", "\x00", "\x85", "\xa0", "\u3000", "é", "Ñ", "İ", "Ⱥ", "Ʉ", "ǅ", "ß"]
    for path, spaced in ((BYTE, True), (WORD, False)):
        enc = tokens.TextEncoder(path, spaced)
        for _ in range(4000):
            text = "".join(rng.choices(signs, k=rng.randint(1, 14)))
            assert words(enc.encode(text)) == plain(path, text), repr(text)


def test_packing_keeps_few_parts(spark, docs, monkeypatch):
    """Beside the JVM that the pipeline's stages before leave, its workers took more memory than an executor has."""
    import types

    import pyarrow as pa

    monkeypatch.setattr(packing, "KEPT", 5)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: types.SimpleNamespace(partitionId=lambda: 0))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [" ".join(f"{a}{b}" for a in "abcdefgh" for b in "ijkl")]})
    list(packing._pack_partition(WORD, 2, 512, 4)([batch]))
    parts = next(iter(tokens.worker_store("encoders").values())).parts
    assert 0 < len(parts) <= 5 and len(parts.older) <= 5
    monkeypatch.undo()
    bounds = []
    write = packing.write_settled
    monkeypatch.setattr(packing, "write_settled", lambda *a, **b: bounds.append(b["records"]) or write(*a, **b))
    assert packing.pack(docs, WORD).count() and max(bounds) <= 1000


def test_what_an_earlier_operator_kept_is_freed_at_once():
    """An encoder and its caches refer to each other."""
    import gc
    import weakref

    from funclab.llm import common

    class Encoder:
        def __init__(self):
            self.encode = self.part

        def part(self):
            return self

    gc.disable()
    try:
        held = Encoder()
        freed = weakref.ref(held)
        common.worker_store("encoders")["held"] = held
        del held
        assert common.worker_store("encoders")["held"] is freed()
        assert common.worker_store("") == {} and freed() is None
    finally:
        gc.enable()
