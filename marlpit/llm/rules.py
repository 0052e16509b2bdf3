"""Quality rules and an isolation forest over their statistics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm.shared import drop, map_batches, stored
from marlpit.llm.textkit import SPACE_WORD, Chunks, Levels, Texts, cover, mix, slices

#: The characters counted as symbols, and the length of a window of repeated words.
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
#: A text of fewer words, or of more repeated words than this percentage, fails the base rules.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest sees, each a share or a logarithm.
FEATURES = ("log_words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "punct", "distinct", "stop")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_UPPER, _DIGIT, _PUNCT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[0x41:0x5B] = _DIGIT[0x30:0x3A] = True
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out, some = np.zeros(len(offsets) - 1, np.int64), np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.add.reduceat(flags, offsets[some], dtype=np.int64)
    return out


def _earlier(keys: np.ndarray) -> np.ndarray:
    """Which values occur before in the array."""
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return again


def statistics(texts: Texts) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of the contract and the feature matrix, a row per text."""
    starts, ends, rows = texts.words(SPACE_WORD)
    n = np.bincount(rows, minlength=texts.n)
    data, offsets = texts.data, texts.offsets
    inside = SPACE_WORD[data]
    chars = _per_row(inside & ((data & 0xC0) != 0x80), offsets)
    symbols = _per_row(_SYMBOL[data], offsets)
    salt = mix(np.arange(1, texts.n + 1, dtype=np.uint64))
    # lines, the last one of each text included; those without a word don't count
    breaks = np.flatnonzero(data == 0x0A)
    line_start = np.sort(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    line_start = np.unique(line_start[line_start < len(data)])
    line_end = np.append(line_start[1:], len(data)) if len(line_start) else line_start
    line_end = np.where(data[line_end - 1] == 0x0A, line_end - 1, line_end) if len(line_start) else line_end
    has = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[has], line_end[has]
    line_row = texts.doc_of(line_start)
    chunks = Chunks(data)
    again = _earlier(chunks.hashes(line_start, line_end) ^ salt[line_row])
    dup = np.bincount(line_row[again], minlength=texts.n)
    # words in windows found twice or more
    words = chunks.hashes(starts, ends)
    at = np.arange(max(0, len(words) - REPEAT_WINDOW + 1))
    at = at[rows[at] == rows[at + REPEAT_WINDOW - 1]] if len(at) else at
    key = Levels(words).windows(REPEAT_WINDOW)[at] ^ salt[rows[at]]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = at[order[np.append(same, False) | np.append(False, same)]] if len(order) else at
    hit = cover(twice, twice + REPEAT_WINDOW, len(words)) if len(words) else np.zeros(0, bool)
    repeat = np.bincount(rows[hit], minlength=texts.n)
    kinds = np.bincount(rows[~_earlier(words ^ salt[rows])], minlength=texts.n) if len(words) else n
    small = np.bincount(rows[(ends - starts) <= 3], minlength=texts.n) if len(words) else n
    counts = dict(zip(COUNTS, (n, chars, symbols, dup, repeat), strict=True))
    size, some, lines = np.maximum(np.diff(offsets), 1), np.maximum(n, 1), np.maximum(np.bincount(line_row, minlength=texts.n), 1)
    x = np.stack([np.log1p(n), chars / some, symbols / size, dup / lines, repeat / some, _per_row(_UPPER[data], offsets) / size, _per_row(_DIGIT[data], offsets) / size, _per_row(_PUNCT[data], offsets) / size, np.log(np.maximum(kinds, 1)) / np.log(some + 1), small / some], 1)
    return counts, x.astype(np.float32)


#: How far cuts reach beyond the range of the rows that a forest is grown from, as a share of that range.
MARGIN = 0.5


class Forest:
    """An isolation forest: trees of random splits over random samples.

    A node is cut anywhere in its cell, not only between its own rows, and the
    first cell reaches beyond all rows: what lies outside of them soon falls
    into cells without rows, whose paths are short. ``bounds``: rows with the
    range of all those that ``x`` was drawn from. A column without a range there
    has that of ``wide``, the rows known besides.
    """

    def __init__(self, x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 5, wide: np.ndarray | None = None, bounds: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(x))
        self.depth = max(1, math.ceil(math.log2(max(2, self.sample))))
        nodes = (1 << (self.depth + 1)) - 1
        self.feature = np.full((trees, nodes), -1, np.int16)
        self.split = np.zeros((trees, nodes), np.float32)
        self.path = np.zeros((trees, nodes), np.float32)
        whole = x if bounds is None else bounds
        lo, hi, every = whole.min(0), whole.max(0), whole if wide is None else wide
        reach = MARGIN * np.where(hi > lo, hi - lo, every.max(0) - every.min(0))
        for t in range(trees):
            self._grow(t, 0, 0, x[rng.choice(len(x), self.sample, replace=False)], lo - reach, hi + reach, rng)

    def _grow(self, t: int, node: int, level: int, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, rng) -> None:
        open_ = np.flatnonzero(hi > lo)
        if level == self.depth or len(x) <= 1 or not len(open_):
            self.path[t, node] = level + expected(len(x))
            return
        f = int(rng.choice(open_))
        cut = np.float32(rng.uniform(lo[f], hi[f]))
        self.feature[t, node], self.split[t, node] = f, cut
        left, edge = x[:, f] < cut, np.arange(len(lo)) == f
        for k, part, a, b in ((1, x[left], lo, np.where(edge, cut, hi)), (2, x[~left], np.where(edge, cut, lo), hi)):
            if len(part):
                self._grow(t, 2 * node + k, level + 1, part, a, b, rng)
            else:
                self.path[t, 2 * node + k] = level + 1

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for anomalies, below 0.5 for the ordinary."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f >= 0, 2 * node + 1 + (x[rows, np.maximum(f, 0)] >= split[node]), node)
            total += path[node]
        return 2.0 ** (-total / len(self.path) / max(expected(self.sample), 1e-9))


def expected(n: int) -> float:
    """The mean path of an unsuccessful search in a tree of n."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


#: Scores are told apart in so many steps when a threshold is sought, which bounds what the driver takes of any number of rows.
LEVELS = 1 << 16


def level(scores: np.ndarray) -> np.ndarray:
    """The middle of each score's step."""
    return (np.floor(scores * LEVELS) + 0.5) / LEVELS


def calibrated(scores: np.ndarray, good: np.ndarray, keep: float) -> float:
    """The score up to which rows are kept, from labelled rows of both classes; see ``threshold``."""
    values, at = np.unique(scores, return_inverse=True)
    return threshold(values, np.bincount(at[good], minlength=len(values)), np.bincount(at[~good], minlength=len(values)), keep)


def threshold(values: np.ndarray, good: np.ndarray, bad: np.ndarray, keep: float) -> float:
    """The score up to which rows are kept, from ascending scores and how many good and bad rows have each.

    Among the lines that at least ``keep`` of the good rows stay below, the one
    of the largest share of bad rows above less the share of good ones above;
    the highest of equal ones, halfway between the scores it separates. Without
    bad rows it is the good rows' quantile, without good ones nothing is above.
    """
    if not len(values):
        return 2.0
    if not good.sum():
        return float(values[-1]) + 1e-9
    lost = good.sum() - np.cumsum(good)
    few = lost <= (1 - keep) * good.sum() + 1e-9
    if not bad.sum():
        return float(values[np.argmax(few)]) + 1e-9
    caught = bad.sum() - np.cumsum(bad)
    gain = np.where(few, caught / bad.sum() - lost / good.sum(), -1.0)
    best = len(values) - 1 - int(np.argmax(gain[::-1]))
    return float(values[best] + values[best + 1]) / 2 if best + 1 < len(values) else float(values[best]) + 1e-9


def quality_rules(documents: DataFrame, labels: DataFrame, trees: int = 60, subsample: int = 256, keep: float = 0.998) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, anomaly (forest's score), kept.

    All labelled documents that pass the base rules count: the forest reaches
    over the range of those of quality 1, and its threshold is the one that best
    separates all of these from all others while ``keep`` of the former stay.
    Each tree is grown from ``subsample`` rows drawn from all, as is the method.
    Every document is counted once, whole, and scored. Null and empty texts have
    no words and so fail the base rules; repeated rows come once each; without
    labelled rows only the base rules decide; an empty table gives no rows.
    """

    def measure(batch):
        ids = batch.column("doc_id")
        for texts in slices(batch.column("text")):
            counts, x = statistics(texts)
            yield counts | {"doc_id": ids.slice(texts.first, texts.n), "base_failed": failed(counts), "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))}

    base = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean"
    rows = stored(map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), measure, f"{base}, x array<float>"), "rules")
    marks = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("good"))
    # one row an id, however often it occurs
    known = stored(rows.filter("not base_failed").join(marks, "doc_id").groupBy("doc_id").agg(F.min(F.struct("x", "good")).alias("r")).select("doc_id", "r.*"), "known")
    forest, line = _grown(known, trees, subsample), 2.0
    if forest:
        steps = map_batches(known, lambda batch: [{"score": level(forest.scores(_matrix(batch))), "good": batch.column("good")}], "score double, good boolean")
        found = steps.groupBy("score").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")).toPandas().sort_values("score")
        line = threshold(found.score.to_numpy(), found.good.to_numpy(), found.bad.to_numpy(), keep)
    drop(known)

    def judge(batch):
        bad = np.asarray(batch.column("base_failed").to_numpy(zero_copy_only=False))
        score = forest.scores(_matrix(batch)) if forest else np.zeros(batch.num_rows)
        yield {c: batch.column(c) for c in ("doc_id", *COUNTS, "base_failed")} | {"anomaly": score, "kept": ~bad & (level(score) <= line)}

    return map_batches(rows, judge, f"{base}, anomaly double, kept boolean")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten(), np.float32).reshape(-1, len(FEATURES))


def _grown(known: DataFrame, trees: int, subsample: int) -> Forest | None:
    """A forest of the good rows, or of all if fewer than two are good; each tree's rows are drawn from all of them."""
    x = [F.col("x")[j] for j in range(len(FEATURES))]
    reach = lambda df: df.agg(F.count(F.lit(1)), *[f(c) for f in (F.min, F.max) for c in x]).first()
    every, own = reach(known), reach(known.filter("good"))
    if not every[0]:
        return None
    some, span = (known.filter("good"), own) if own[0] >= 2 else (known, every)
    # the rows whose ids hash least; half as many again are asked for, so that tasks send no more than these
    size = trees * subsample
    few = some.select("x", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)).alias("h")).filter(F.col("h") < int(1.5 * size / span[0] * (1 << 32)) + 1)
    drawn = sorted(few.collect(), key=lambda r: (r.h, r.doc_id))[:size]
    ranges = [np.array(r[1:], np.float32).reshape(2, -1) for r in (every, span)]
    return Forest(np.array(sorted(r.x for r in drawn), np.float32), trees, subsample, wide=ranges[0], bounds=ranges[1])


def failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
