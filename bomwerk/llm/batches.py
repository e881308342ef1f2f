"""Texts of Arrow batches as flat arrays of words.

Spark hands a task its rows batch by batch; these helpers go through a batch in slices
of bounded size, so memory does not follow the batch or the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20  # a longer text is a slice of its own


def slices(batch: pa.RecordBatch, *columns: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each with about ``size`` bytes of text in ``columns``."""
    if not batch.num_rows:
        return
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in columns or ("text",):
        sizes += pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // size
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for low, high in zip(edges, edges[1:], strict=False):
        if high > low:
            yield batch.slice(low, high - low)


def plain(texts: pa.Array, keep: str = r"\p{L}") -> pa.Array:
    """Lower-case texts with a space for every run of other characters; a null is empty."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(lower, f"[^{keep}]+", " "))


def split(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words by ASCII white space: code of each word, the distinct words, and where each text's words start.

    The last array has one entry more than there are texts.
    """
    words = pc.ascii_split_whitespace(texts)
    flat = words.flatten()
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))])
    # leading and trailing white space gives empty words
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        starts = np.concatenate([[0], np.cumsum(full)])[starts]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist(), starts
