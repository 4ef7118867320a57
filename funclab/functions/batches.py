"""Arrow batches for Python workers, cut into slices that hold few texts at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Rows of a slice at most.
SLICE_ROWS = 1024


def _row_bytes(column: pa.Array):
    """About the bytes of text in each row of a column of texts or of lists of texts, as numbers without nulls."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        # Offsets count texts; bytes of a row are what the texts before its end have more than those before its start.
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(column.values), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
        at = column.offsets.to_numpy(zero_copy_only=False)
        upto = [int(ends[i - 1]) if i else 0 for i in at]
        return [b - a for a, b in zip(upto, upto[1:])]
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def slices(batches: Iterable[tuple[pa.Array, ...]], most: int, sized: int = 0) -> Iterator[tuple[pa.Array, ...]]:
    """Slices of batches of columns, in order and without a row left out.

    A slice has about ``most`` bytes of text in the column numbered ``sized``, unless one row has more, and no more
    than ``SLICE_ROWS`` rows. What Python makes of a slice is let go with it, so a worker needs no
    memory for more, however large the batches are.
    """
    for batch in batches:
        start, held = 0, 0
        for i, size in enumerate(_row_bytes(batch[sized])):
            if i > start and (held + size > most or i - start >= SLICE_ROWS):
                yield tuple(column.slice(start, i - start) for column in batch)
                start, held = i, 0
            held += size
        yield tuple(column.slice(start) for column in batch)
