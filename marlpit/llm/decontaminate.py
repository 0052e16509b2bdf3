"""Benchmark decontamination with suffix arrays of the training text."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm.shared import map_batches
from marlpit.llm.textkit import ALNUM_WORD, Levels, Texts, cover, mix, ragged, slices

#: A window is so many consecutive words.
WINDOW = 10
#: The first words of a suffix by which suffixes without any counterpart in the tests are left out.
LEAD = 3


class Tests:
    """The windows of test items, deduplicated, by their length in words."""

    def __init__(self, ids: list, texts, window: int = WINDOW):
        starts, ends, rows = texts.words(ALNUM_WORD)
        hashes = texts.word_hashes(starts, ends, lower=True)
        first = np.searchsorted(rows, np.arange(texts.n + 1))
        count = np.diff(first)
        self.ids = np.array([None if i is None else str(i) for i in ids], object)
        # all words, a value of its own after each item, and the order of all suffixes by doubled depths
        self.words = np.insert(hashes, first[1:], mix(np.arange(texts.n, dtype=np.uint64), 0x5E9A))
        self.starts = first[:-1] + np.arange(texts.n)
        self.levels = Levels(self.words)
        self.order, rank, depth = np.argsort(self.words, kind="stable"), np.unique(self.words, return_inverse=True)[1], 1
        while len(rank) and rank.max() + 1 < len(rank):
            after = np.append(rank[depth:] + 1, np.zeros(min(depth, len(rank)), np.int64))
            self.order = np.lexsort([after, rank])
            a, b = rank[self.order], after[self.order]
            rank = np.empty_like(rank)
            rank[self.order] = np.append(0, np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            depth *= 2
        self.classes = []
        for size in np.unique(np.minimum(count[count > 0], window)):
            items = np.flatnonzero(np.minimum(count, window) == size)
            room = count[items] - size + 1
            p = ragged(first[items], room)
            rows_of = hashes[p[:, None] + np.arange(size)]
            owner = np.repeat(items, room)
            keys, inverse = np.unique(rows_of, axis=0, return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            lead = min(LEAD, int(size))
            self.classes.append((int(size), keys, owner[order], np.append(0, np.cumsum(np.bincount(inverse.ravel(), minlength=len(keys)))), lead, np.unique(Levels(keys[:, :lead].ravel()).windows(lead)[::lead])))


def suffix_array(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes that begin at ``at``, sorted by their first ``depth`` words."""
    return at[np.lexsort([words[at + j] for j in range(depth - 1, -1, -1)])] if len(at) else at


def search(words: np.ndarray, array: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query: the range of suffixes in the array that begin with it, and the longest match in words."""
    lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(array), np.int64)
    longest = np.zeros(len(query), np.int64)
    for j in range(query.shape[1]):
        ends = []
        for right in (False, True):
            a, b = lo.copy(), hi.copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                value = words[np.minimum(array[np.minimum(mid, len(array) - 1)] + j, len(words) - 1)]
                less = (value <= query[:, j]) if right else (value < query[:, j])
                a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
            ends.append(a)
        lo, hi = ends
        longest = np.where(hi > lo, j + 1, longest)
        if not (hi > lo).any():
            break
    return lo, hi, longest


def longest_matches(tests: Tests, words: np.ndarray, levels: Levels, at: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most words from each of ``at``, ``room`` at most, that stand in an item in a row, and where in ``tests.words``."""

    def common(q: np.ndarray) -> np.ndarray:
        n, most = np.zeros(len(at), np.int64), np.minimum(room, len(tests.words) - q)
        for j in range(int(most.max()).bit_length() - 1, -1, -1):
            some = np.flatnonzero(n + (1 << j) <= most)
            same = levels.at(j)[(at + n)[some]] == tests.levels.at(j)[(q + n)[some]]
            n[some[same]] += 1 << j
        return n

    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(tests.order))
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        q = tests.order[np.minimum(mid, len(tests.order) - 1)]
        n = common(q)
        less = (n < room) & (tests.words[np.minimum(q + n, len(tests.words) - 1)] < words[np.minimum(at + n, len(words) - 1)])
        lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    below, above = tests.order[np.maximum(lo - 1, 0)], tests.order[np.minimum(lo, len(tests.order) - 1)]
    a, b = common(below), common(above)
    return np.maximum(a, b), np.where(a > b, below, above)


def matches(texts: Texts, blocks: list[Tests], locate: bool = False) -> tuple[np.ndarray, np.ndarray, list[set[str | None]], list[list[dict]]]:
    """Words of each text, words of it that are hit, the items met and, if they are to be located, the longest matches."""
    starts, ends, rows = texts.words(ALNUM_WORD)
    words = texts.word_hashes(starts, ends, lower=True)
    hit = np.zeros(len(words), bool)
    items: list[set[str | None]] = [set() for _ in range(texts.n)]
    most, block_of, place = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    begun = [np.zeros(len(words) if locate else 0, bool) for _ in blocks]
    levels = Levels(words)
    leads: dict[int, np.ndarray] = {}
    for block, tests, (size, keys, owner, owners, lead, known) in ((i, t, c) for i, t in enumerate(blocks) for c in t.classes):
        if len(words) < size:
            continue
        if lead not in leads:
            leads[lead] = levels.windows(lead)
        near = np.searchsorted(known, leads[lead])
        at = np.flatnonzero(known[np.minimum(near, len(known) - 1)] == leads[lead])
        at = at[at + size <= len(words)]
        at = at[rows[at] == rows[at + size - 1]]
        array = suffix_array(words, at, size)
        if not len(array):
            continue
        lo, hi, longest = search(words, array, keys)
        full = longest == size
        found = array[ragged(lo[full], (hi - lo)[full])]
        hit |= cover(found, found + size, len(words))
        if locate:
            begun[block][found] = True
        which = np.repeat(np.flatnonzero(full), (hi - lo)[full])
        for row, q in set(zip(rows[found].tolist(), which.tolist(), strict=True)):
            items[row].update(tests.ids[owner[owners[q] : owners[q + 1]]])
    n = np.bincount(rows, minlength=texts.n)
    first, located = np.append(0, np.cumsum(n)), [[] for _ in range(texts.n)]
    for block, flags in enumerate(begun):
        if len(at := np.flatnonzero(flags)):
            length, q = longest_matches(blocks[block], words, levels, at, first[rows[at] + 1] - at)
            more = length > most[at]
            most[at[more]], block_of[at[more]], place[at[more]] = length[more], block, q[more]
    # what is within the match that begins a word before is no match of its own
    for p in np.flatnonzero((most > 0) & (most >= np.append(0, most[:-1]))).tolist():
        tests = blocks[block_of[p]]
        item = int(np.searchsorted(tests.starts, place[p], "right")) - 1
        located[rows[p]].append({"start": p - int(first[rows[p]]), "n": int(most[p]), "item": tests.ids[item], "item_start": int(place[p] - tests.starts[item])})
    return n, np.bincount(rows[hit], minlength=texts.n), items, located


#: Test words collected and indexed at once; more tests come in blocks of about so many.
BLOCK_WORDS = 500_000


def test_blocks(benchmark: DataFrame, window: int, unnamed: bool) -> list[Tests]:
    """The tests in blocks of bounded size; benchmarks are a stated query set, not corpus data."""
    bench = benchmark.select("item_id", "text").filter("text is not null" if unnamed else "item_id is not null and text is not null")
    size = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-size // (BLOCK_WORDS * 4)))
    out = []
    for i in range(parts):
        rows = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).orderBy(F.col("item_id").cast("string"), "text").toArrow()
        for texts in slices(rows.column("text"), 1 << 40):
            out.append(Tests(rows.column("item_id").to_pylist(), texts, window))
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, unnamed: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, longest, located.

    Every batch of a partition is a shard: a suffix array over its words is
    built, sorted as deep as a window, and all test suffixes are searched in it
    by binary search. Suffixes whose first words begin no test suffix are not
    entered, which changes no match. Null texts and texts without words have no
    hits; items without words or text match nothing; repeated rows come once
    each; an item_id that repeats counts once; without items nothing is
    contaminated. Items without an id match nothing unless ``unnamed`` is set:
    then they hit as others do and count as one item, which stands as null at
    the end of ``items`` and not in the hash.

    ``located`` lists, from each word where a window is met, the longest run of
    words that also stands in one item, if it isn't the rest of the run a word
    before: its first word and number of words in the document, one such item,
    and the first word in it. ``longest`` is the largest such number, or 0.
    """
    spark = documents.sparkSession
    blocks = [spark.sparkContext.broadcast(t) for t in test_blocks(benchmark, window, unnamed)]

    def run(batch):
        ids = batch.column("doc_id")
        for texts in slices(batch.column("text")):
            n, n_hit, names, located = matches(texts, [b.value for b in blocks], locate=True)
            named = [sorted(x - {None}) for x in names]
            listed = [",".join(x) for x in named]
            yield {"doc_id": ids.slice(texts.first, texts.n), "n_words": n, "n_hit": n_hit, "n_items": [len(x) for x in names], "items_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in listed], "contaminated": n_hit > 0, "items": [[*a, None] if None in x else a for a, x in zip(named, names, strict=True)], "longest": [max((m["n"] for m in x), default=0) for x in located], "located": located}

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, longest long, located array<struct<start: long, n: long, item: string, item_start: long>>")


def keep_clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows, with all their columns, that hold no window of any item, with an id or without. A column named text is needed."""
    spark = documents.sparkSession
    blocks = [spark.sparkContext.broadcast(t) for t in test_blocks(benchmark, window, unnamed=True)]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                hit = np.concatenate([matches(texts, [b.value for b in blocks])[1] for texts in slices(batch.column("text"))])
                yield batch.filter(pa.array(hit == 0))

    return documents.mapInArrow(run, documents.schema)
