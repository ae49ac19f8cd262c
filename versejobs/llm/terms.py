"""Terms of whole texts inside tasks: all bytes that part them become blanks at once, and Arrow tells the terms apart."""

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
SLICE = 12 << 20
BLANK = ord(" ")


def folding(kept: str) -> bytes:
    """A table for bytes.translate(): A-Z become a-z, characters of `kept` and bytes beyond ASCII stay, all others become blanks."""
    own = set(kept.encode())
    table = bytearray(x if x > 127 or x in own else BLANK for x in range(256))
    for upper, lower in zip(string.ascii_uppercase.encode(), string.ascii_lowercase.encode(), strict=True):
        table[upper] = lower
    return bytes(table)


def distinct(keys: np.ndarray) -> np.ndarray:
    """The values of an array once each, in order, by sorting."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def folded(texts: pa.Array, table: bytes) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """First row, offsets and folded bytes of texts, by slices that hold whole texts; null is empty."""
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
    sizes = np.cumsum(pc.binary_length(raw).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(raw):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + SLICE, side="right")))
        yield start, np.concatenate([[0], sizes[start:end] - before]).astype(np.int64), b"".join(raw[start:end].to_pylist()).translate(table)
        start = end


def numbers(texts: pa.Array, table: bytes) -> np.ndarray:
    """How many terms each text has."""
    found = np.zeros(len(texts), np.int64)
    for start, offsets, data in folded(texts, table):
        on = np.frombuffer(data, np.uint8) != BLANK
        begins = on.copy()
        begins[1:] &= ~on[:-1]
        firsts = offsets[:-1][offsets[:-1] < len(on)]
        begins[firsts] = on[firsts]
        upto = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
        found[start : start + len(offsets) - 1] = np.diff(upto[offsets])
    return found


def sliced(texts: pa.Array, table: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Row number, term number and terms (as names without the empty one) of texts, by slices; null has none.

    A byte is never part of two characters in UTF-8, so what is left between the blanks is whole characters.
    """
    for start, offsets, data in folded(texts, table):
        whole = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        parts = pc.ascii_split_whitespace(whole)
        coded = parts.flatten().dictionary_encode()
        rows, codes = pc.list_parent_indices(parts).to_numpy() + start, coded.indices.to_numpy().astype(np.int64)
        names = coded.dictionary
        empty = pc.index(names, pa.scalar("", pa.large_string())).as_py()
        if empty >= 0:
            rows, codes = rows[codes != empty], codes[codes != empty]
            codes -= codes > empty
            names = names.filter(pc.not_equal(names, ""))
        yield rows, codes, names
