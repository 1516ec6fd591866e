"""Words of whole batches of texts as numbers, for operators that compare word sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes of the texts that are split at a time.
SLICE = 500_000


def sliced(batch: pa.RecordBatch, name: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about so many bytes of text; a longer text comes alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield batch.take(pa.array(np.arange(at, to)))  # a copy: pyarrow's text kernels misread some slices
        at = to


def words(column: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word in order, start of each text's words and the end of the last).

    Words are split at the six ASCII white-space characters; lower brings only A-Z to lower case; null has no words.
    """
    text = pc.fill_null(column.cast(pa.large_string()), "")
    found = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    flat, starts = found.flatten(), found.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    full = pc.binary_length(flat).to_numpy() > 0  # white space at either end of a text leaves an empty word there
    if not full.all():
        flat = flat.filter(pa.array(full))
        starts = np.concatenate(([0], np.cumsum(full)))[starts]
    named = flat.dictionary_encode()
    return named.dictionary, named.indices.to_numpy(), starts
