"""Python workers hold the objects of a slice of a batch at a time, not of the whole batch."""

import sys
import types

import pyarrow as pa

from funclab.functions import comments, tokens
from funclab.functions.batches import SLICE_ROWS, slices
from funclab.operators import inference


def test_slices_lose_nothing():
    texts = pa.array(["aa", None, "b" * 9, "", "cc", None, "é"])
    rows = pa.array([["aa", None], None, ["b" * 9], [], ["cc", "dd"], ["e"], [None]])
    numbers = pa.array(range(7))
    for column in (texts, rows, texts.slice(2), rows.slice(2), rows.slice(7)):
        cut = list(slices([(column, numbers.slice(7 - len(column)))] * 2, 4))
        assert [x for c, _ in cut for x in c.to_pylist()] == 2 * column.to_pylist()
        assert [x for _, n in cut for x in n.to_pylist()] == 2 * list(range(7 - len(column), 7))
    assert [c.to_pylist() for c, in slices([(texts,)], 4)] == [["aa", None], ["b" * 9], ["", "cc", None, "é"]]
    assert [len(c) for c, in slices([(pa.nulls(SLICE_ROWS + 5, pa.string()),)], 4)] == [SLICE_ROWS, 5]


def test_a_vocabulary_encodes_slices(spark, monkeypatch):
    given = []

    class Vocabulary:
        def encode_batch_fast(self, texts, add_special_tokens):
            given.append(sum(map(len, texts)))
            return [t.split() for t in texts]

    held = types.ModuleType("_funclab_vocabularies")
    vars(held)["v"] = Vocabulary()
    monkeypatch.setitem(sys.modules, "_funclab_vocabularies", held)
    row = ["x y " * 5_000, None]
    out = list(tokens.vocabulary_counter("v").func(iter([pa.array([row] * 60 + [None])])))
    assert [n for part in out for n in part.to_pylist()] == [[10_000, 0]] * 60 + [None]
    assert len(given) > 1 and max(given) <= tokens.SLICE_BYTES


def test_tokens_of_comments_leave_in_slices(spark):
    code = "/* a /* b */ */ x\n" * 5_000
    out = list(comments._deep_tokens_udf.func(iter([(pa.array([code] * 40), pa.array(["rust"] * 40))])))
    assert sum(map(len, out)) == 40 and all("".join(t) == code for part in out for t in part.to_pylist())
    assert len(out) > 1 and max(map(len, out)) * len(code) <= comments.SLICE_BYTES


def test_questions_are_held_in_slices(monkeypatch):
    held, plain = [], inference._answer_all

    def counted(sent, *rest):
        held.append(sum(map(len, sent)))
        return plain(sent, *rest)

    monkeypatch.setattr(inference, "_answer_all", counted)
    asked = '[{"role": "user", "content": "%s"}]' % ("x" * 300_000)
    made = {}
    monkeypatch.setattr(inference.F, "arrow_udf", lambda kind: lambda f: made.setdefault("f", f) and types.SimpleNamespace(asNondeterministic=lambda: lambda *_: None))
    monkeypatch.setattr(inference.F, "to_json", lambda c: c)
    inference.ask("messages", "model", lambda turns, name: f"{name} {len(turns)}", at_once=2)
    out = list(made["f"](iter([(pa.array([asked] * 10), pa.array(["m"] * 10))])))
    assert [x for part in out for x in part.to_pylist()] == [{"ok": True, "text": "m 1", "error": None}] * 10
    assert len(held) > 1 and max(held) <= inference.SLICE_BYTES
