"""Blocks of Arrow rows with a bound on their text, and the words of a block as flat arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in order, in blocks of at most ``most`` bytes of ``column``, or of one row."""
    now: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        upto = np.concatenate(([0], np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(upto, upto[begin] + most - held, "right")) - 1
            if end <= begin and now:
                yield _joined(now)
                now, held = [], 0
                continue
            end = min(max(end, begin + 1), batch.num_rows)
            now.append(batch.slice(begin, end - begin))
            held += int(upto[end] - upto[begin])
            begin = end
    if now:
        yield _joined(now)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def split_words(texts: pa.Array, separators: str) -> tuple[pa.Array, np.ndarray]:
    """The texts' words end to end (what stands between matches of the RE2 pattern, without the empty ones), and how
    many each text has."""
    parts = pc.split_pattern_regex(texts, pattern=separators)
    row, flat = pc.list_parent_indices(parts), pc.list_flatten(parts)
    full = pc.greater(pc.binary_length(flat), 0)
    row = row.filter(full).to_numpy(zero_copy_only=False)
    return flat.filter(full), np.bincount(row, minlength=len(texts)).astype(np.int64)
