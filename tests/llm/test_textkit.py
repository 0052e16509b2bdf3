"""The text primitives against plain Python."""

import random

import numpy as np
import pyarrow as pa
from marlpit.llm import textkit as T

from tests.llm import brute


def test_words_and_hashes():
    texts = [t for _, t in brute.hard_cases()][:60]
    for limit in (1, 100, 1 << 20):
        seen, at = {}, 0
        for part in T.slices(pa.array(texts), limit):
            assert part.first == at
            for table, pattern, low in ((T.SPACE_WORD, brute.BLANK, False), (T.ALNUM_WORD, brute.ALNUM, True)):
                starts, ends, rows = part.words(table)
                got = [[] for _ in range(part.n)]
                for a, b, r, h in zip(starts, ends, rows, part.word_hashes(starts, ends, low), strict=True):
                    word = part.data[a:b].tobytes().decode()
                    word = brute.lower(word) if low else word
                    got[r].append(word)
                    assert seen.setdefault((low, word), h) == h
                text = [texts[at + i] or "" for i in range(part.n)]
                assert got == [pattern.findall(brute.lower(t) if low else t) for t in text]
            at += part.n
        assert at == len(texts) and len({h for (low, _), h in seen.items() if low}) == sum(low for low, _ in seen)


def test_sliding_argmin():
    rng = random.Random(2)
    for n in (0, 1, 5, 40):
        keys = np.array([rng.randrange(6) << 40 for _ in range(n)], np.uint64)
        for width in (1, 2, 7, 40):
            want = [min(range(i, i + width), key=lambda j: (keys[j], j)) for i in range(n - width + 1)]
            assert T.sliding_argmin(keys, width).tolist() == want


def test_argmin_of_slices():
    """A window's minimum is the same however long the values around it are."""
    rng = np.random.default_rng(3)
    keys = (rng.integers(0, 4, 5000, np.uint64) << np.uint64(50)) + rng.integers(0, 3, 5000, np.uint64)
    whole = T.sliding_argmin(keys, 30)
    for lo, hi in ((0, 40), (17, 160), (900, 3000)):
        assert (T.sliding_argmin(keys[lo:hi], 30) + lo == whole[lo : hi - 29]).all()


def test_window_hashes():
    """Equal hashes for equal runs of any width, wherever they stand, and no others."""
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[2000:2600] = data[300:900]
    chunks = T.Chunks(data)
    raw = data.tobytes()
    for width in (1, 5, 8, 13, 24, 64, 200, 333):
        got = T.byte_windows(chunks, chunks.windows(), width)
        assert len(set(zip(got.tolist(), [raw[i : i + width] for i in range(len(got))], strict=True))) == len(set(got.tolist())) == len({raw[i : i + width] for i in range(len(got))})
        at = np.arange(0, 3000 - width, 7)
        spans = T.Levels(T.mix(data.astype(np.uint64))).spans(at, np.full(len(at), width))
        assert len(set(spans.tolist())) == len({raw[i : i + width] for i in at.tolist()})
        assert (chunks.hashes(np.array([300]), np.array([300 + width])) == chunks.hashes(np.array([2000]), np.array([2000 + width]))).all()


def test_ragged_and_cover():
    assert T.ragged(np.array([3, 9, 0, 7]), np.array([2, 0, 3, 1])).tolist() == [3, 4, 0, 1, 2, 7]
    assert T.ragged(np.array([], int), np.array([], int)).tolist() == []
    assert T.cover(np.array([1, 2, 6]), np.array([3, 4, 7]), 8).tolist() == [False, True, True, True, False, False, True, False]
