"""A factorisation machine that scores documents for quality."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm.rules import statistics
from marlpit.llm.shared import map_batches, trim
from marlpit.llm.textkit import SPACE_WORD, Texts, mix, slices

#: Slots of hashed words, bins of each statistic, size of the factors.
WORD_SLOTS, BINS, RANK = 1 << 15, 12, 8
#: From this score on a document counts as good.
THRESHOLD = 0.3


@dataclass
class Machine:
    """Bias, weights, factors, and the edges of the bins of each statistic."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    edges: np.ndarray

    def raw(self, slot: np.ndarray, value: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Bias + sum w x + half of sum over k of ((sum v x)^2 - sum (v x)^2), linear in the features."""
        vx = self.factors[slot] * value[:, None]
        total = np.stack([np.bincount(row, vx[:, k], n) for k in range(vx.shape[1])], 1)
        square = np.bincount(row, (vx * vx).sum(1), n)
        return self.bias + np.bincount(row, self.weights[slot] * value, n) + 0.5 * ((total * total).sum(1) - square)


def word_features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and value of each distinct hashed word: 1 + log of its count, scaled to length 1 for each text."""
    starts, ends, rows = texts.words(SPACE_WORD)
    slot = (mix(texts.word_hashes(starts, ends, lower=True), 3) % np.uint64(WORD_SLOTS)).astype(np.int64)
    key, count = np.unique(rows * WORD_SLOTS + slot, return_counts=True)
    row, value = key // WORD_SLOTS, 1 + np.log(count)
    norm = np.sqrt(np.bincount(row, value * value, texts.n))
    return row, key % WORD_SLOTS, value / norm[row]


def with_bins(row, slot, value, x: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adds the one-hot bin of each statistic."""
    n, kinds = x.shape
    bins = np.stack([np.searchsorted(edges[j], x[:, j], "right") for j in range(kinds)], 1)
    own = WORD_SLOTS + np.arange(kinds) * BINS + bins
    return np.concatenate([row, np.repeat(np.arange(n), kinds)]), np.concatenate([slot, own.ravel()]), np.concatenate([value, np.full(n * kinds, 0.5)])


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], epochs: int = 6, rate: float = 0.03, decay: float = 1e-4, seed: int = 11) -> Machine:
    """Minimises the logistic loss with Adam over mini-batches; rows are slots, values, statistics and label."""
    rng = np.random.default_rng(seed)
    x = np.array([r[2] for r in rows], np.float32)
    edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T.astype(np.float32)
    size = WORD_SLOTS + x.shape[1] * BINS
    y = np.array([r[3] for r in rows], float)
    theta = {"b": np.zeros(1), "w": np.zeros(size), "v": rng.normal(0, 0.02, (size, RANK))}
    share = min(max(y.mean(), 0.01), 0.99)
    theta["b"][0] = np.log(share / (1 - share))
    first, second = ({k: np.zeros_like(v) for k, v in theta.items()} for _ in range(2))
    step = 0
    machine = Machine(0.0, theta["w"], theta["v"], edges)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 256):
            part = order[at : at + 256]
            n = len(part)
            row = np.repeat(np.arange(n), [len(rows[i][0]) for i in part])
            slot, value = (np.concatenate([rows[i][k] for i in part]) for k in (0, 1))
            row, slot, value = with_bins(row, slot, value, x[part], edges)
            vx = theta["v"][slot] * value[:, None]
            total = np.stack([np.bincount(row, vx[:, k], n) for k in range(RANK)], 1)
            machine.bias = theta["b"][0]
            err = (1 / (1 + np.exp(-np.clip(machine.raw(slot, value, row, n), -30, 30))) - y[part]) / n
            e = err[row] * value
            gv = e[:, None] * (total[row] - vx)
            grads = {"b": np.array([err.sum()]), "w": np.bincount(slot, e, size) + decay * theta["w"], "v": np.stack([np.bincount(slot, gv[:, k], size) for k in range(RANK)], 1) + decay * theta["v"]}
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                theta[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Machine(float(theta["b"][0]), theta["w"].astype(np.float32), theta["v"].astype(np.float32), edges)


def train(documents: DataFrame, labels: DataFrame, sample: int = 6000) -> Machine | None:
    """A machine from at most ``sample`` labelled documents outside the held-out fold, those whose ids hash least; of rows that share an id, one."""
    few = labels.filter("doc_id is not null and quality is not null").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    few = few.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = documents.select("doc_id", "text").join(F.broadcast(few), "doc_id")

    def features(batch):
        for texts in slices(batch.column("text")):
            row, slot, value = word_features(texts)
            _, x = statistics(texts)
            ends = np.searchsorted(row, np.arange(texts.n + 1)).astype(np.int32)
            here = slice(texts.first, texts.first + texts.n)
            yield {
                "doc_id": batch.column("doc_id").slice(texts.first, texts.n), "y": np.asarray(batch.column("quality"))[here],
                "slot": pa.ListArray.from_arrays(pa.array(ends), pa.array(slot.astype(np.int32))), "value": pa.ListArray.from_arrays(pa.array(ends), pa.array(value.astype(np.float32))),
                "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32())),
            }

    table = map_batches(chosen, features, "doc_id long, y int, slot array<int>, value array<float>, x array<float>")
    # one row an id, however often it occurs, so that ``sample`` bounds what the driver takes
    table = table.groupBy("doc_id").agg(F.min(F.struct("x", "slot", "value", "y")).alias("r")).select("doc_id", "r.*").toArrow()
    rows = []
    for batch in table.to_batches():
        ends = np.asarray(batch.column("slot").offsets)
        slot, value = (np.asarray(batch.column(c).values) for c in ("slot", "value"))
        x = batch.column("x").to_pylist()
        for i, (key, y) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("y").to_pylist(), strict=True)):
            a, b = ends[i], ends[i + 1]
            rows.append((key, slot[a:b].astype(np.int64), value[a:b].astype(float), np.array(x[i], np.float32), y))
    rows.sort(key=lambda r: (r[0], len(r[1]), r[3].tobytes()))
    try:
        return fit([r[1:] for r in rows]) if rows else None
    finally:  # the driver's memory isn't needed any more either
        del table, rows
        trim()


def probabilities(texts: Texts, machine: Machine | None) -> np.ndarray:
    """How likely each whole text is of quality 1."""
    if machine is None:
        return np.full(texts.n, 0.5)
    _, x = statistics(texts)
    row, slot, value = with_bins(*word_features(texts), x, machine.edges)
    return 1 / (1 + np.exp(-np.clip(machine.raw(slot, value, row, texts.n), -30, 30)))


def keep_good(documents: DataFrame, machine: Machine | None) -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold. A column named text is needed."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p = np.concatenate([probabilities(texts, machine) for texts in slices(batch.column("text"))])
                yield batch.filter(pa.array(p >= THRESHOLD))
                trim()

    return documents.mapInArrow(run, documents.schema)


def score(documents: DataFrame, labels: DataFrame, sample: int = 6000) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    The features are hashed words, the statistics of ``rules`` and, among them,
    the text's length; doc_id, lang, source and labels are none. Whole texts
    are scored. Null and empty texts are scored by their statistics; a missing
    doc_id is not held out and never trains; repeated rows get the same score;
    without labels every score is 0.5; an empty table gives no rows.
    """
    machine = train(documents, labels, sample)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))

    def run(batch):
        for texts in slices(batch.column("text")):
            here = slice(texts.first, texts.first + texts.n)
            p = probabilities(texts, machine)
            yield {"doc_id": batch.column("doc_id")[here], "held_out": batch.column("held_out")[here], "score": p, "predicted": (p >= THRESHOLD).astype(np.int32)}

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")
