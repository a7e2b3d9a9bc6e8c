"""Runs of bytes of an alphabet, cut out of whole batches of UTF-8 texts at once.

An alphabet names the ASCII characters of its words; every byte from 0x80 on belongs to it as well, so a run of bytes is a run of
characters. Only A-Z are lower-cased. Rows never share a run.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from gleanery.llm.common import buffers

SLICE_BYTES = 16 << 20  # bytes of text taken up at a time; one longer text is a slice of its own

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32


def alphabet(ascii_chars: str) -> np.ndarray:
    keep = np.zeros(256, bool)
    keep[[ord(c) for c in ascii_chars]] = True
    keep[128:] = True
    return keep


LETTERS = alphabet(string.ascii_letters)
WORD_CHARS = alphabet(string.ascii_letters + string.digits)


@dataclass
class Words:
    """Lower-cased words of some rows: ``first`` row of the slice, ``per_row`` words in each row, words in order."""

    first: int
    per_row: np.ndarray
    words: pa.BinaryArray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.per_row)), self.per_row)


def binary_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values)])


def word_runs(texts: pa.Array, keep: np.ndarray, slice_bytes: int = SLICE_BYTES, longer_than: int = 0) -> Iterator[Words]:
    """All rows of ``texts`` (no nulls), slice after slice; only their words of more than ``longer_than`` bytes."""
    data, offs = buffers(texts)
    offs = offs.astype(np.int64)
    whole = np.frombuffer(data, np.uint8)
    row = 0
    while row < len(offs) - 1:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + slice_bytes, "right")) - 1)
        part, starts = whole[offs[row]: offs[end]], offs[row: end + 1] - offs[row]
        inside = keep[part]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = starts[(starts > 0) & (starts < len(part))]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        at = np.flatnonzero(begins)
        sizes = np.flatnonzero(ends) + 1 - at
        if longer_than:
            long = sizes > longer_than
            inside[inside] = np.repeat(long, sizes)
            at, sizes = at[long], sizes[long]
        offsets = np.zeros(len(at) + 1, np.int64)
        np.cumsum(sizes, out=offsets[1:])
        yield Words(row, np.diff(np.searchsorted(at, starts)), binary_array(LOWER[part[inside]], offsets))
        row = end


def lengths_of(values: pa.Array) -> np.ndarray:
    return np.diff(buffers(values)[1]) if len(values) else np.zeros(0, np.int64)
