"""Words of Arrow batches, cut and counted in columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text and rows that are cut at a time.
BYTES, ROWS = 8_000_000, 32_768


def folding(kept: str) -> np.ndarray:
    """A table of bytes: A-Z become lower case, ASCII outside ``kept`` becomes a space, bytes of other characters stay."""
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        table[b] = ord(chr(b).lower()) if chr(b) in kept else 32
    return table


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Terms of letters and non-ASCII characters, with and without digits.
WORDS, WORDS_AND_DIGITS = folding(LETTERS), folding(LETTERS + "0123456789")
#: Words are all that isn't white space.
SPACED = np.arange(256, dtype=np.uint8)
SPACED[ord("A") : ord("Z") + 1] += 32
SPACED[9:14] = 32


def words(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The row and the text of each word, in order; null texts have none."""
    texts = texts.cast(pa.string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = texts.buffers()[2]
    folded = table[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.zeros(0, np.uint8)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(folded))
    lists = pc.ascii_split_whitespace(plain)
    flat, row = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    return row.filter(full).to_numpy(), flat.filter(full)


def gathered(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``BYTES`` of text and at most ``ROWS`` rows; one longer text is a batch of its own."""
    held, size, rows = [], 0, 0
    for batch in batches:
        column = batch.column(text)
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            before = int(ends[at - 1]) if at else 0
            fit = int(np.searchsorted(ends, before + BYTES - size, "right"))
            end = min(max(fit, at if held else at + 1), at + ROWS - rows)
            if end > at:
                held.append(batch.slice(at, end - at))
                size, rows, at = size + int(ends[end - 1]) - before, rows + end - at, end
            if at < len(ends) or size >= BYTES or rows >= ROWS:
                yield pa.concat_batches(held)
                held, size, rows = [], 0, 0
    if held:
        yield pa.concat_batches(held)
