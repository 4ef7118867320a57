"""Token counts, with a counter the caller can replace.

A counter maps an array of texts to an array of counts. The default counts word pieces and
punctuation in the JVM; ``vocabulary_counter`` counts the tokens of a vocabulary file, and
``python_counter`` wraps any other Python function.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from funclab.functions.batches import slices

TOKENS_PER_MESSAGE = 3
TOKENS_PER_NAME = 1
TOKENS_PER_REPLY = 3

PIECES = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r\f\x0b]"


def count_pieces(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.coalesce(F.regexp_count(t, F.lit(PIECES)), F.lit(0)))


def python_counter(count):
    """Turn ``count(text) -> int`` into a counter; it runs on Arrow batches."""

    @F.pandas_udf("array<int>")
    def counter(texts: pd.Series) -> pd.Series:
        return texts.map(lambda row: None if row is None else [0 if t is None else int(count(t)) for t in row])

    return counter


#: Bytes of text that are encoded in one call, unless one row has more.
SLICE_BYTES = 1 << 18


def _vocabulary(path: str):
    """The vocabulary at a path, read once by a Python worker.

    Functions may reach workers by value, and then their globals last one task; what is kept among the
    modules lasts as long as the worker, so tasks do not leave a vocabulary each.
    """
    kept = vars(sys.modules.setdefault("_funclab_vocabularies", types.ModuleType("_funclab_vocabularies")))
    if path not in kept:
        from tokenizers import Tokenizer

        read = Tokenizer.from_file(path)
        read.encode_special_tokens = True  # their names in a text are ordinary text
        kept[path] = read
    return kept[path]


def vocabulary_counter(path: str):
    """A counter of the tokens that a vocabulary in the tokenizers library's JSON format gives.

    ``path`` must be there for every executor. Slices of about ``SLICE_BYTES`` are encoded in one call
    each, as an encoding takes many times the memory of its text, and only numbers come back. Null
    texts have no tokens.
    """

    @F.arrow_udf("array<int>")
    def counter(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (texts,) in slices(((batch,) for batch in batches), SLICE_BYTES):
            rows = texts.to_pylist()
            flat = [t for row in rows if row is not None for t in row if t is not None]
            sizes = iter([len(e) for e in _vocabulary(path).encode_batch_fast(flat, add_special_tokens=False)])
            counts = [None if row is None else [0 if t is None else next(sizes) for t in row] for row in rows]
            yield pa.array(counts, pa.list_(pa.int32()))

    return counter
