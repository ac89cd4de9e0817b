"""Hashes of the words of many texts at once, without a Python object for each word.

A word is a run of bytes other than ASCII white space, A-Z lower-cased. Its hash is a polynomial in a fixed odd base over fixed
values of its bytes, modulo 2^64, taken from one running sum over the bytes of all texts, and then mixed with its length. Two
of n different words share a hash with a chance of about n squared / 2^65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0xD1342543DE82EF95
#: Bytes after which the powers of the base begin again; a word across that border is hashed by itself.
PERIOD = 1 << 20
#: Texts are worked on in pieces of so many bytes, or one by one if longer.
PIECE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Called with an Arrow array of texts; null texts have no words."""

    def __init__(self) -> None:
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        low = np.arange(256)
        low[65:91] += 32
        self.value = mix((low.astype(np.uint64) + np.uint64(1)) * M1) | np.uint64(1)
        self.value[self.space] = 0
        self.power = self._powers(BASE)
        self.back = self._powers(pow(BASE, -1, 1 << 64))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.full(PERIOD, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, in order, and the number of words of each text."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if len(texts) == 0 or bounds[-1] == bounds[0]:
            return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        return self._hash(data, bounds - bounds[0])

    def _hash(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = ~self.space[raw]
        edge = np.zeros(len(raw) + 1, bool)  # a text begins here
        edge[bounds] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(raw) + 1, np.uint64)
        for at in range(0, len(raw), PERIOD):
            part = self.value[raw[at : at + PERIOD]]
            sums[at + 1 : at + 1 + len(part)] = part * self.power[: len(part)]
        np.cumsum(sums, out=sums)
        h = (sums[ends] - sums[starts]) * self.back[starts & (PERIOD - 1)]
        for i in np.flatnonzero(starts // PERIOD != (ends - 1) // PERIOD):
            h[i] = self._one(raw[starts[i] : ends[i]])
        h = mix(h + (ends - starts).astype(np.uint64) * M1)
        return h, np.diff(np.searchsorted(starts, bounds))

    def _one(self, raw: np.ndarray) -> np.uint64:
        total, scale = 0, 1
        for at in range(0, len(raw), PERIOD):
            part = self.value[raw[at : at + PERIOD]]
            total += scale * int((part * self.power[: len(part)]).sum(dtype=np.uint64))
            scale = scale * pow(BASE, PERIOD, 1 << 64) % (1 << 64)
        return np.uint64(total % (1 << 64))


def pieces(batches, column: int, most_rows: int = 4096, most_bytes: int = PIECE_BYTES):
    """Slices of batches, of bounded numbers of rows and bytes of the column of texts (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(size)])
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(total, total[at] + most_bytes, "right")) - 1
            end = min(max(end, at + 1), at + most_rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
