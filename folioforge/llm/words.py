"""A vectorised scanner for words in Arrow string columns.

Separators are ASCII in every word definition used here, so UTF-8 can be scanned byte by byte and
no text is decoded. A word is known by a 64-bit tabulation hash of its bytes: two given words
collide with probability 2**-64. Texts are scanned in slices of a few megabytes, so memory is
bounded by the slice or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 256 << 10
_ROWS = 64
TABLE = np.random.default_rng(20240229).integers(1, 2**64, size=(_ROWS, 256), dtype=np.uint64)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x20\x09-\x0D]+
SPACED = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower case
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Scan:
    """Texts ``first`` to ``first + rows`` of a column. ``offsets`` bounds their bytes in ``data``;
    word w covers data[starts[w]:ends[w]] and words bounds[d]:bounds[d + 1] are those of text d."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows, from 0) and bytes; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    kind, step = (np.int64, 8) if wide else (np.int32, 4)
    offsets = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * step).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def scans(column: pa.Array, word: np.ndarray = SPACED, fold: np.ndarray = LOWER, slice_bytes: int = SLICE_BYTES) -> Iterator[Scan]:
    """Slices of the column with their words; ``fold`` maps bytes before ``word`` is asked."""
    offsets, data = buffers(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + slice_bytes, "right")) - 1)
        last = min(last, rows, first + 20_000)
        part = fold[data[offsets[first] : offsets[last]]]
        bounds = offsets[first : last + 1] - offsets[first]
        inside = word[part]
        cut = np.zeros(len(part) + 1, bool)
        cut[bounds] = True
        before = np.zeros(len(part) + 1, bool)
        before[1:] = inside
        after = np.zeros(len(part) + 1, bool)
        after[:-1] = inside
        starts = np.flatnonzero(after & (~before | cut))
        ends = np.flatnonzero(before & (~after | cut))
        yield Scan(first, last - first, part, bounds, starts, ends, np.searchsorted(starts, bounds))
        first = last


def hashes(scan: Scan, keep: np.ndarray | None = None, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word; ``keep`` leaves other bytes of a word out, ``fold`` maps them first."""
    if not len(scan.starts):
        return np.zeros(0, np.uint64)
    lens = scan.ends - scan.starts
    begin = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=begin[1:])
    where = np.arange(int(lens.sum())) + np.repeat(scan.starts - begin, lens)
    byte = scan.data[where]
    if fold is not None:
        byte = fold[byte]
    if keep is None:
        place = np.arange(len(byte)) - np.repeat(begin, lens)
        value = TABLE[place & (_ROWS - 1), byte]
    else:
        kept = keep[byte]
        seen = np.cumsum(kept)
        place = seen - kept - np.repeat(seen[begin] - kept[begin], lens)
        value = TABLE[place & (_ROWS - 1), byte]
        value[~kept] = 0
    if lens.max() > _ROWS:
        value = value * (2 * (place // _ROWS) + 1).astype(np.uint64)
    return mix(np.add.reduceat(value, begin))


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes that :func:`hashes` gives to these words."""
    return np.concatenate([hashes(s) for s in scans(pa.array(words, pa.string()), np.ones(256, bool), np.arange(256, dtype=np.uint8))] or [np.zeros(0, np.uint64)])


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between ``bounds``."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
