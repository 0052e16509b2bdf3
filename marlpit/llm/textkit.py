"""Vectorised text primitives over Arrow batches: words, hashes of spans and windows, minimisers.

Text is handled as UTF-8 bytes. All classes of separators used here are ASCII,
so byte-wise splitting equals splitting by code points. Hashes are not linear:
a span's eight-byte chunks are scrambled with their numbers before they are
added, and windows are scrambled anew at each doubling of their width, so that
no family of strings (Thue-Morse words, say) collides for every seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text is worked on alone.
SLICE_BYTES = 512 << 10

#: Spans that are hashed at once.
SPANS = 1 << 18

U = np.uint64
_M1, _M2, _M3, _M4 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)

SPACE_WORD = np.ones(256, bool)  # words are runs of anything but blanks and \t to \r
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORD = np.zeros(256, bool)  # words are runs of ASCII letters and digits and of all beyond ASCII
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h + U(salt)) if salt else h
    h = (h ^ (h >> U(30))) * _M1
    h = (h ^ (h >> U(27))) * _M2
    return h ^ (h >> U(31))


def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair, in order."""
    return mix(a * _M3 + (b ^ (b >> U(31))) * _M4)


def bounded(n: np.ndarray) -> np.ndarray:
    """Masks of the lower n bytes, n up to 8."""
    return ~U(0) >> (U(8) * (U(8) - n.astype(np.uint64)))


class Levels:
    """Hashes of all runs of 1, 2, 4, ... values, ``step`` positions from one value to the next; each level is made once it is asked for."""

    def __init__(self, values: np.ndarray, step: int = 1):
        self.step, self.level = step, [values]

    def at(self, j: int) -> np.ndarray:
        """The runs of 2 ** j values that begin at each position where one has room."""
        while len(self.level) <= j:
            last, gap = self.level[-1], self.step << (len(self.level) - 1)
            self.level.append(both(last[: max(0, len(last) - gap)], last[gap:]))
        return self.level[j]

    def windows(self, width: int) -> np.ndarray:
        """The hash of each run of ``width`` values."""
        n = max(0, len(self.level[0]) - (width - 1) * self.step)
        out, done = None, 0
        for j in range(width.bit_length() - 1, -1, -1):
            if width >> j & 1:
                part = self.at(j)[done * self.step :][:n]
                out, done = part if out is None else both(out, part), done + (1 << j)
        return out

    def spans(self, start: np.ndarray, size: np.ndarray, unit: int = 1) -> np.ndarray:
        """The hash of ``size`` positions from each start; one value covers ``unit`` of them, and size is ``unit`` at least."""
        out = np.empty(len(start), np.uint64)
        level = np.frexp((size // unit).astype(np.float64))[1] - 1
        for j in np.unique(level).tolist():
            some = np.flatnonzero(level == j)
            a, n = start[some], size[some]
            out[some] = both(self.at(j)[a], self.at(j)[a + n - (unit << j)])
        return mix(out + size.astype(np.uint64) * _M3)


class Chunks:
    """Bytes read eight at a time from any position."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        self.size, self.view = len(data), np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each span of bytes, wherever it stands."""
        out = np.zeros(len(starts), np.uint64)
        for at in range(0, len(starts), SPANS):
            begin, size = starts[at : at + SPANS], (ends - starts)[at : at + SPANS]
            count = (size + 7) >> 3
            k = ragged(np.zeros(len(count), np.int64), count)
            left = np.repeat(size, count) - 8 * k
            value = self.view[np.repeat(begin, count) + 8 * k] & bounded(np.minimum(left, 8))
            value = mix((value ^ (value >> U(32))) * _M3 + k.astype(np.uint64) * _M4)
            some = np.flatnonzero(count)
            if len(some):
                out[at + some] = np.add.reduceat(value, (np.cumsum(count) - count)[some])
            out[at : at + SPANS] += size.astype(np.uint64) * _M4
        return mix(out)

    def windows(self) -> Levels:
        """Hashes of runs of 8, 16, 32, ... bytes."""
        return Levels(mix(self.view[: max(0, self.size - 7)]), 8)


def byte_windows(chunks: Chunks, levels: Levels, width: int) -> np.ndarray:
    """The hash of each run of ``width`` bytes."""
    n = max(0, chunks.size - width + 1)
    if width < 8:
        return mix(chunks.view[:n] & bounded(np.array([width])))
    out = levels.windows(width // 8)[:n]
    return both(out, levels.at(0)[width - 8 :][:n]) if width % 8 else out


class Texts:
    """A slice of a batch: the joined bytes of its texts and where each begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        """The row of each byte position; rows without text have none."""
        return np.searchsorted(self.offsets, positions, "right") - 1

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of each word."""
        if not len(self.data):
            return (np.zeros(0, np.int64),) * 3
        inside = table[self.data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        cut = self.offsets[:-1][np.diff(self.offsets) > 0]
        begin[cut] = inside[cut]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        stop[cut[1:] - 1] = inside[cut[1:] - 1]
        starts = np.flatnonzero(begin)
        return starts, np.flatnonzero(stop) + 1, self.doc_of(starts)

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        return Chunks(LOWER[self.data] if lower else self.data).hashes(starts, ends)

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def slices(column: pa.Array | pa.ChunkedArray, limit: int = 0) -> Iterator[Texts]:
    """The texts of a column in slices of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    limit, row = limit or SLICE_BYTES, 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield Texts(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], row)
        row = end


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Positions of the leftmost minimum in each run of ``width`` values, which are compared whole."""
    n = len(keys)
    if n < width:
        return np.zeros(0, np.int64)
    full = np.full(-(-n // width) * width, ~U(0), np.uint64)
    full[:n] = keys
    rows = full.reshape(-1, width)
    place = np.arange(len(full)).reshape(-1, width)
    least = np.minimum.accumulate(rows, axis=1)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] < least[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(new, place, 0), axis=1).ravel()
    ahead = least.ravel()
    least = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]
    new[:, -1] = True
    new[:, :-1] = rows[:, :-1] <= least[:, 1:]
    back_at = np.minimum.accumulate(np.where(new, place, len(full))[:, ::-1], axis=1)[:, ::-1].ravel()
    back = least.ravel()
    m = n - width + 1
    return np.where(back[:m] <= ahead[width - 1 :][:m], back_at[:m], ahead_at[width - 1 :][:m])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, joined."""
    total = int(lengths.sum())
    step = np.ones(total, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    if not total:
        return step
    at = np.cumsum(lengths)[:-1]
    step[0] = starts[0]
    step[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in any of the spans."""
    d = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(d)[:n] > 0
