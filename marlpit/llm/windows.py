"""Repeated windows of a fixed length, found by most-significant-digit passes over anchored suffixes.

Ordering every suffix of a corpus would shuffle many times its size. Here each
window of L units (words or bytes) is owned by its anchor: the k-gram in it
with the least hash, the leftmost on a tie. Equal windows have equal anchors at
equal offsets, so only windows of one anchor need comparing, and what is sorted
are the suffixes (with what precedes them in a window) that begin at anchors.
The passes, each of which looks deeper than the one before and goes on only
with groups that still hold different members:

1. the anchor's k-gram. Each anchor owns a *block* of consecutive windows (about
   L/2); blocks that are equal as a whole are one class, and repeats;
2. for anchors with several classes, one member of each is opened. Its windows
   are taken ``step`` offsets at a time, and the digit is what all windows of
   such a range have in common, L - step + 1 units around the anchor;
3. in groups that agree so far, single windows, L units deep. There the sort
   ends: equal groups are exactly the repeated windows.

Each pass only counts (or takes the least document of) a group, pre-aggregated
before the shuffle, so a group may hold any share of the rows. No list of a
group's members is ever built, no group is gathered and no pair is formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlpit.llm.shared import drop, map_batches, stored
from marlpit.llm.textkit import SPACE_WORD, U, Chunks, Levels, Texts, both, byte_windows, mix, ragged, sliding_argmin, slices

#: Offsets that the second pass takes at a time, and windows that are hashed at once, so few that their arrays stay in the processor's cache.
STEP, PIECE = 16, 1 << 16


@dataclass(frozen=True)
class Spec:
    """length: units in a window; gram: units in an anchor; unit: word or byte."""

    length: int
    gram: int
    unit: str

    @property
    def steps(self) -> tuple[int, ...]:
        """The offsets that each pass takes at a time; no more than an anchor's units, so that a digit always holds part of it."""
        step = min(STEP, self.gram)
        return (step, 1) if step > 1 else (1,)


class Units:
    """Hashes of runs of words or bytes of a slice. ``first``: the first unit of each row, and the end."""

    def __init__(self, texts: Texts, spec: Spec):
        self.chunks = None
        if spec.unit == "word":
            starts, self.ends, rows = texts.words(SPACE_WORD)
            self.starts, self.first, self.n = starts, np.searchsorted(rows, np.arange(texts.n + 1)), len(starts)
            self.values = texts.word_hashes(starts, self.ends, lower=False)
        else:
            self.first, self.n, self.data = texts.offsets, len(texts.data), texts.data
        self.spec = spec

    def piece(self, lo: int, hi: int) -> Piece:
        return Piece(self, lo, hi)


class Piece:
    """The hashes of the units from ``lo`` up to ``hi``; positions count from lo."""

    def __init__(self, units: Units, lo: int, hi: int):
        self.unit, self.chunks = 1, None
        if units.spec.unit == "word":
            self.levels = Levels(units.values[lo:hi])
        elif units.spec.length < 64:
            self.levels = Levels(mix(units.data[lo:hi].astype(np.uint64)))
        else:
            self.chunks = Chunks(units.data[lo:hi])
            self.levels, self.unit = self.chunks.windows(), 8

    def windows(self, width: int) -> np.ndarray:
        return byte_windows(self.chunks, self.levels, width) if self.chunks else self.levels.windows(width)

    def spans(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.levels.spans(start, size, self.unit)


NAMES = ("row", "lo", "n", "m", "anchor", "ah", "bk")


def blocks(texts: Texts, spec: Spec) -> dict[str, np.ndarray]:
    """The blocks of all rows: row, first window and anchor (as units within the row), number of windows, anchor and block hash.

    A row's windows are dealt to its blocks without gaps, so a block that repeats
    m times on end, as in periodic text, is one entry and covers m * n windows.
    Long texts are worked on in overlapping pieces; a block that is cut between
    two of them is two.
    """
    units = Units(texts, spec)
    parts = [_blocks(units, spec, lo, min(units.n, lo + PIECE + spec.length - 1)) for lo in range(0, max(0, units.n - spec.length + 1), PIECE)]
    return {x: np.concatenate([p[x] for p in parts]) if parts else np.zeros(0, np.int64) for x in NAMES}


def _blocks(units: Units, spec: Spec, base: int, stop: int) -> dict[str, np.ndarray]:
    """The blocks of windows that lie between two units."""
    size, k, piece = spec.length, spec.gram, units.piece(base, stop)
    first = np.clip(units.first, base, stop) - base
    grams = piece.windows(k)
    anchor = sliding_argmin(mix(grams, 77), size - k + 1)
    room = np.diff(first) - size + 1
    rows = np.flatnonzero(room > 0)
    if not len(rows):
        return {x: np.zeros(0, np.uint64 if x in ("ah", "bk") else np.int64) for x in NAMES}
    p = ragged(first[rows], room[rows])
    own = np.repeat(rows, room[rows])
    a = anchor[p]
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(p)))
    lo, a, own = p[at], a[at], own[at]
    body = piece.spans(lo, count + size - 1)
    key = both(body, ((a - lo) * 1009 + count).astype(np.uint64))
    ah = grams[a]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (ah[1:] != ah[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    m, own, lo, a = np.diff(np.append(at, len(own))), own[at], lo[at], a[at]
    start = units.first[own] - base
    return {"row": own, "lo": lo - start, "n": count[at], "m": m, "anchor": a - start, "ah": ah[at], "bk": key[at]}


def block_table(docs: DataFrame, spec: Spec) -> DataFrame:
    """k1, k2, lo, n, m, off (first window to anchor), ah, bk for each block, stored."""

    def run(batch):
        k1, k2 = (np.asarray(batch.column(c)) for c in ("k1", "k2"))
        for texts in slices(batch.column("text")):
            b = blocks(texts, spec)
            if len(b["row"]):
                row = b["row"] + texts.first
                yield {"k1": k1[row], "k2": k2[row], "lo": b["lo"].astype(np.int32), "n": b["n"].astype(np.int16), "m": b["m"].astype(np.int32), "off": (b["anchor"] - b["lo"]).astype(np.int16), "ah": b["ah"].view(np.int64), "bk": b["bk"].view(np.int64)}

    return stored(map_batches(docs.select("k1", "k2", "text"), run, "k1 long, k2 long, lo int, n short, m int, off short, ah long, bk long"), "blocks")


#: An anchor with more than this share of all blocks is hot; so there are at most so many hot ones.
HOT_SHARE = 1 / 100_000
#: ... and none has fewer blocks than this.
HOT_LEAST = 5000


def live_blocks(table: DataFrame) -> DataFrame:
    """The blocks that can hold a repeat, with c and least, their class's size and least k1, k, the number of classes of their anchor, and rn, their number in the class (1: its representative). Stored.

    Blocks of an anchor meet in one task, sorted. Those of hot anchors, whose
    number is bounded by ``HOT_SHARE``, are instead counted by class, partially
    before the shuffle, and joined with the counts; Spark splits such joins.
    The most frequent anchor is always one of them, so that tables of any size
    go the same way: Spark leaves out joins with an empty list.
    """
    count = table.groupBy("ah").agg(F.count(F.lit(1)).alias("blocks"))
    limit = max(HOT_LEAST, int(table.count() * HOT_SHARE))
    top = count.agg(F.max_by("ah", "blocks").alias("ah"))
    listed = stored(count.filter(F.col("blocks") > limit).select("ah").unionByName(top).distinct(), "hot")
    hot = F.broadcast(listed)
    one, anchor = Window.partitionBy("ah", "bk"), Window.partitionBy("ah")
    cool = table.join(hot, "ah", "left_anti").repartition("ah")
    cool = cool.withColumn("rn", F.row_number().over(one.orderBy("k1", "k2", "lo"))).withColumns({"c": F.sum("m").over(one), "least": F.min("k1").over(one)})
    cool = cool.withColumn("k", F.sum(F.when(F.col("rn") == 1, 1).otherwise(0)).over(anchor)).filter("c > 1 or k > 1")
    many = table.join(hot, "ah", "left_semi")
    classes = many.groupBy("ah", "bk").agg(F.sum("m").alias("c"), F.min(F.struct("k1", "k2", "lo")).alias("rep"))
    classes = classes.join(F.broadcast(classes.groupBy("ah").agg(F.count(F.lit(1)).alias("k"))), "ah")
    met = many.join(classes, ["ah", "bk"]).withColumns({"least": F.col("rep.k1"), "rn": F.when(F.struct("k1", "k2", "lo") == F.col("rep"), 1).otherwise(2)})
    columns = [*table.columns, "c", "least", "k", "rn"]
    out = stored(cool.select(columns).unionByName(met.select(columns)), "live")
    drop(listed)
    return out


def opened(docs: DataFrame, live: DataFrame, spec: Spec) -> DataFrame:
    """ah, bk, k1, n, off and body (the text of the block) of one member of each class of a shared anchor. Stored."""
    wanted = live.filter("k > 1 and rn = 1").groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "n", "off", "ah", "bk")).alias("blocks"))
    met = docs.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("k1", "text", "blocks")

    def run(batch):
        lists = batch.column("blocks")
        ends = np.asarray(lists.offsets).astype(np.int64)
        ends -= ends[0]
        flat = lists.flatten()
        get = {f.name: np.asarray(flat.field(i)) for i, f in enumerate(flat.type)}
        k1 = np.asarray(batch.column("k1"))
        for texts in slices(batch.column("text")):
            bound = ends[texts.first : texts.first + texts.n + 1]
            part = {k: v[bound[0] : bound[-1]] for k, v in get.items()}
            row = np.repeat(np.arange(texts.n), np.diff(bound))
            if not len(row):
                continue
            begin = part["lo"].astype(np.int64)
            end = begin + part["n"] + spec.length - 1
            if spec.unit == "byte":
                begin, end = texts.offsets[row] + begin, texts.offsets[row] + end
            else:
                starts, stops, rows = texts.words(SPACE_WORD)
                first = np.searchsorted(rows, np.arange(texts.n + 1))[row]
                begin, end = starts[first + begin], stops[first + end - 1]
            for some in _cuts(end - begin):
                at = np.append(0, np.cumsum((end - begin)[some])).astype(np.int32)
                body = texts.data[ragged(begin[some], (end - begin)[some])]
                yield {x: part[x][some] for x in ("ah", "bk", "n", "off")} | {"k1": k1[row[some] + texts.first], "body": pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(body)])}

    return stored(map_batches(met, run, "ah long, bk long, n short, off short, k1 long, body binary"), "opened")


def _cuts(size: np.ndarray, limit: int = 8 << 20) -> Iterator[slice]:
    """Slices of rows of about so many bytes in all."""
    total, at = np.cumsum(size), 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        yield slice(at, end)
        at = end


def digits(bodies: DataFrame, spec: Spec, step: int) -> DataFrame:
    """The digits of a pass, stored: key, hull, ah, bk, k1, s, m, top for each range of ``step`` offsets of each block.

    Blocks come with ``ranges``, the offsets from their anchor that are still
    open. key: the hash of the anchor and of what all windows at these offsets
    have in common; hull: of all that the block's own windows among them cover;
    those are m windows from the s-th on, and the first one's offset is top.
    """

    def run(batch):
        lists = batch.column("ranges")
        ends = np.asarray(lists.offsets).astype(np.int64)
        ends -= ends[0]
        flat = lists.flatten()
        o1, o2 = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
        get = {x: np.asarray(batch.column(x)) for x in ("ah", "bk", "k1", "off")}
        for texts in slices(batch.column("body"), PIECE):
            units, bound = Units(texts, spec), ends[texts.first : texts.first + texts.n + 1]
            if not units.n:
                continue
            piece = units.piece(0, units.n)
            a, b = o1[bound[0] : bound[-1]], o2[bound[0] : bound[-1]]
            count = b // step - a // step + 1
            own = np.repeat(np.repeat(np.arange(texts.n), np.diff(bound)), count)
            at = ragged(a // step, count) * step
            top, low = np.minimum(at + step - 1, np.repeat(b, count)), np.maximum(at, np.repeat(a, count))
            row = own + texts.first
            anchor = units.first[own] + get["off"][row]
            common = piece.spans(anchor - at, np.full(len(at), spec.length - step + 1))
            key = both(common, mix(get["ah"][row].view(np.uint64)) + at.astype(np.uint64))
            m = top - low + 1
            hull = both(piece.spans(anchor - top, spec.length + m - 1), (top * 1009 + m).astype(np.uint64)) if step > 1 else key
            yield {"key": key.view(np.int64), "hull": hull.view(np.int64), "ah": get["ah"][row], "bk": get["bk"][row], "k1": get["k1"][row], "s": (get["off"][row] - top).astype(np.int16), "m": m.astype(np.int16), "top": top.astype(np.int16)}

    return stored(map_batches(bodies, run, "key long, hull long, ah long, bk long, k1 long, s short, m short, top short"), "digits")


def repeated_in_classes(bodies: DataFrame, spec: Spec, earlier: bool) -> DataFrame:
    """ah, bk, s, m: runs of m windows from the s-th of a class's block that another class of the anchor has as well. Stored.

    ``earlier``: only those that a class of a smaller document has.
    """
    found, spent = [], [bodies]
    ranged = bodies.withColumn("ranges", F.array(F.struct((F.col("off") - F.col("n") + 1).cast("short").alias("o1"), F.col("off").alias("o2"))))
    for step in spec.steps:
        made = digits(ranged, spec, step)
        group = made.groupBy("key").agg(F.count(F.lit(1)).alias("g"), F.min("k1").alias("g1"), F.max("k1").alias("g2"), (F.min("hull") != F.max("hull")).alias("mixed"))
        group = group.filter("g1 < g2" if earlier else "g > 1").select("key", F.col("g1").alias("least"), "mixed")
        spent.append(made)
        if step == 1:
            found.append(stored(made.join(group, "key").filter("k1 > least" if earlier else "true").select("ah", "bk", "s", "m"), "runs"))
            break
        near = stored(made.join(group.drop("least"), "key"), "near")
        classes = near.groupBy("key", "hull").agg(F.count(F.lit(1)).alias("c"), F.min("k1").alias("least"), F.min(F.struct("ah", "bk")).alias("rep"))
        met = stored(near.join(classes, ["key", "hull"]), "met")
        found.append(met.filter("k1 > least" if earlier else "c > 1").select("ah", "bk", "s", "m"))
        # a class goes on by one of its members; if documents count, by all of its least document
        deeper = met.filter("mixed").filter("k1 = least" if earlier else "struct(ah, bk) = rep")
        deeper = deeper.groupBy("ah", "bk").agg(F.collect_list(F.struct((F.col("top") - F.col("m") + 1).cast("short").alias("o1"), F.col("top").alias("o2"))).alias("ranges"))
        ranged = bodies.join(deeper, ["ah", "bk"])
        spent += [near]
    drop(*spent)
    return reduce(DataFrame.unionByName, found)


def repeated_spans(live: DataFrame, runs: DataFrame, spec: Spec, earlier: bool) -> DataFrame:
    """k1, k2, spans: for each row, the unit spans covered by repeated windows.

    A class of several members is a repeat as a whole (``earlier``: for all but
    its least document); the others have the runs found for their class.
    """
    whole = F.col("k1") > F.col("least") if earlier else F.col("c") > 1
    span = lambda at, m: F.struct(at.alias("s"), (at + m + F.lit(spec.length - 1)).alias("e"))
    all_ = live.filter(whole).select("k1", "k2", span(F.col("lo"), F.col("n") * F.col("m")).alias("x"))
    some = live.filter(~whole & (F.col("k") > 1)).select("k1", "k2", F.explode(F.sequence(F.col("lo"), F.col("lo") + (F.col("m") - 1) * F.col("n"), F.col("n").cast("int"))).alias("lo"), "ah", "bk")
    some = some.join(runs, ["ah", "bk"]).select("k1", "k2", span(F.col("lo") + F.col("s"), F.col("m")).alias("x"))
    return all_.unionByName(some).groupBy("k1", "k2").agg(F.collect_list("x").alias("spans"))


def span_arrays(batch: pa.RecordBatch, column: str = "spans") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List ends, starts and ends of a column of spans; null counts as none."""
    lists = batch.column(column)
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    flat = lists.flatten()
    return np.append(0, np.cumsum(size)), np.asarray(flat.field(0)).astype(np.int64), np.asarray(flat.field(1)).astype(np.int64)
