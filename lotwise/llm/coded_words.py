"""Words of many texts as numbers, split and coded in bulk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

AT_ONCE = 4_000_000  # bytes of text coded at once; a longer text is a chunk of its own


def chunks(batch: pa.RecordBatch, column: int = 1, at_once: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `at_once` bytes of text each, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + at_once, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of every word, word offsets of the texts, words by code); words are split at ASCII white space."""
    rows = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    words = rows.values.slice(rows.offsets[0].as_py(), rows.offsets[-1].as_py() - rows.offsets[0].as_py())
    encoded = words.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = rows.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets -= offsets[0]
    empty = pc.index(encoded.dictionary, pa.scalar("", encoded.dictionary.type)).as_py()
    if empty >= 0:  # beside white space at either end of a text
        real = codes != empty
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    return codes, offsets, encoded.dictionary
