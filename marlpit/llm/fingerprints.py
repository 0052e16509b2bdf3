"""Incremental removal of repeated passages with a log-structured fingerprint index."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.llm import windows as W
from marlpit.llm.shared import discard, drop, keyed, map_batches, shared_dir, stored
from marlpit.llm.textkit import SPACE_WORD, cover, slices

COLUMNS = {"k1": "BIGINT", "k2": "BIGINT", "lo": "INT", "n": "SMALLINT", "m": "INT", "off": "SMALLINT", "ah": "BIGINT", "bk": "BIGINT"}
#: By which Spark takes a bucket's only file as sorted.
SORTED_SCAN = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class FingerprintIndex:
    """Sorted immutable runs of the window hashes of past batches, compacted as they add up.

    A run holds, for each distinct block of windows (see ``windows``) of its
    batches, the fingerprints of anchor and block and the least document with
    it and where. It is bucketed and sorted by fingerprint, so a batch, sorted
    likewise, is merge-joined with every run without moving or sorting the run.
    Then the batch becomes a run. Once there are more than ``fan_in`` runs they
    are merged into one and removed.

    ``path``: the index's folder, in a store that driver and executors share.
    A manifest in it names the runs; it is replaced once a run is whole, and an
    index whose folder has one is opened with the runs of the last.

    What meets in the index is verified by windows of the documents' own words
    (see ``remove_seen``); equal blocks are those of equal anchor hash and equal
    block hash, 64 bits each and from different functions of the words.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, length: int = 50, gram: int = 8, fan_in: int = 4, buckets: int | None = None):
        self.spark, self.spec, self.fan_in = spark, W.Spec(length, min(gram, length), "word"), fan_in
        self.path = (path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}").rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, names = max(self._manifests(), default=-1), []
        if self.version >= 0:
            for row in spark.read.parquet(f"{self.path}/manifest-{self.version}").collect():
                names.append(row.run)
                self.buckets, self.spec = row.buckets, W.Spec(row.length, row.gram, "word")
        self.runs: dict[str, DataFrame] = {name: self._table(name) for name in sorted(names) if name}

    def _manifests(self) -> list[int]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        store = where.getFileSystem(conf)
        names = [x.getPath().getName() for x in store.listStatus(where)] if store.exists(where) else []
        return [int(x.removeprefix("manifest-")) for x in names if x.startswith("manifest-") and store.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}/_SUCCESS"))]

    def _table(self, name: str) -> DataFrame:
        columns = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (ah) SORTED BY (ah, bk) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(name)

    def _commit(self, runs: dict[str, DataFrame]) -> None:
        """From now on these are the index's runs; those that are none any more are removed."""
        gone, self.runs, old, self.version = self.runs.keys() - runs.keys(), runs, self.version, self.version + 1
        rows = [(name, self.buckets, self.spec.length, self.spec.gram) for name in runs] or [(None, self.buckets, self.spec.length, self.spec.gram)]
        self.spark.createDataFrame(rows, "run string, buckets int, length int, gram int").coalesce(1).write.parquet(f"{self.path}/manifest-{self.version}")
        if old >= 0:
            discard(self.spark, f"{self.path}/manifest-{old}")
        for name in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, f"{self.path}/{name}")

    def matched(self, docs: DataFrame) -> DataFrame:
        """The batch's live blocks (``new``) and those of past runs that they meet, stored; the batch becomes a run."""
        table = W.block_table(docs, self.spec)
        fresh = table.withColumn("new", F.lit(True))
        if self.runs:
            seen = table.select("ah").distinct()
            before = self.spark.conf.get(SORTED_SCAN, "false")
            self.spark.conf.set(SORTED_SCAN, "true")
            past = stored(reduce(DataFrame.unionByName, [run.join(seen.hint("merge"), "ah", "left_semi") for run in self.runs.values()]), "met")
            self.spark.conf.set(SORTED_SCAN, before)
            live = W.live_blocks(fresh.unionByName(past.withColumn("new", F.lit(False))))
            drop(past)
        else:
            live = W.live_blocks(fresh)
        self._commit(self.runs | self._run(table))
        drop(table)
        if len(self.runs) > self.fan_in:
            self.compact()
        return live

    def _run(self, table: DataFrame) -> dict[str, DataFrame]:
        """Each block once, with its least document, in order of fingerprint."""
        name = f"run_{uuid.uuid4().hex}"
        least = table.groupBy("ah", "bk").agg(F.min(F.struct("k1", "k2", "lo", "n", "m", "off")).alias("x")).select("x.*", "ah", "bk")
        out = least.select(*COLUMNS).repartition(self.buckets, "ah").sortWithinPartitions("ah", "bk")
        out.write.bucketBy(self.buckets, "ah").sortBy("ah", "bk").option("path", f"{self.path}/{name}").saveAsTable(name)
        return {name: self.spark.table(name)}

    def compact(self) -> None:
        self._commit(self._run(reduce(DataFrame.unionByName, self.runs.values())))

    def remove(self) -> None:
        """Takes the index off the store."""
        for name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(self.spark, self.path)


def remove_seen(documents: DataFrame, length: int = 50, gram: int = 8, batches: int = 2, fan_in: int = 4) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, kept_text.

    Every word goes that lies in a window of ``length`` consecutive words whose
    sequence also starts in a document with a smaller doc_id. Documents enter
    the index in batches of ascending doc_id, so one pass decides each for
    good. A missing doc_id counts as the largest; rows that share an id don't
    act on each other; null, empty and short texts keep all words; an empty
    table gives no rows. Kept words are joined by one blank.
    """
    docs = keyed(documents)
    index = FingerprintIndex(documents.sparkSession, None, length, gram, fan_in)
    cuts = sorted(set(docs.approxQuantile("k1", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    spec, spans = index.spec, []
    edges = [None, *(int(c) for c in cuts), None]
    for lo, hi in zip(edges, edges[1:], strict=False):
        batch = docs if lo is None else docs.filter(F.col("k1") > lo)
        past = docs if hi is None else docs.filter(F.col("k1") <= hi)
        live = index.matched(batch if hi is None else batch.filter(F.col("k1") <= hi))
        bodies = W.opened(past, live, spec)
        runs = W.repeated_in_classes(bodies, spec, earlier=True)
        spans.append(stored(W.repeated_spans(live.filter("new"), runs, spec, earlier=True), "spans"))
        drop(live)
    index.remove()
    both = docs.join(reduce(DataFrame.unionByName, spans), ["k1", "k2"], "left").select("doc_id", "text", "spans")

    def finish(batch):
        ends, lo, hi = W.span_arrays(batch)
        ids = batch.column("doc_id")
        for texts in slices(batch.column("text")):
            starts, stops, rows = texts.words(SPACE_WORD)
            first = np.searchsorted(rows, np.arange(texts.n + 1))
            bound = ends[texts.first : texts.first + texts.n + 1]
            shift = np.repeat(first[:-1], np.diff(bound))
            gone = cover(lo[bound[0] : bound[-1]] + shift, hi[bound[0] : bound[-1]] + shift, len(starts)) if len(starts) else np.zeros(0, bool)
            total = np.append(0, np.cumsum(gone, dtype=np.int64))[first]
            kept = _joined(texts, starts, stops, rows, ~gone)
            yield {
                "doc_id": ids.slice(texts.first, texts.n), "n_words": np.diff(first), "n_removed": np.diff(total),
                "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept], "kept_text": [x.decode() for x in kept],
            }

    return map_batches(both, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def _joined(texts, starts, stops, rows, keep) -> list[bytes]:
    """The kept words of each text, joined by a blank."""
    if not len(starts):
        return [b""] * texts.n
    # every kept word with one separator after it, taken from the text and overwritten
    flags = np.zeros(len(texts.data) + 1, np.int8)
    np.add.at(flags, starts[keep], 1)
    np.subtract.at(flags, stops[keep], 1)
    inside = np.cumsum(flags[:-1]).astype(bool)
    size = np.bincount(rows[keep], weights=(stops - starts)[keep] + 1, minlength=texts.n).astype(np.int64)
    order = np.cumsum((stops - starts)[keep] + 1) - 1
    out = np.full(int(size.sum()), 0x20, np.uint8)
    mask = np.ones(len(out), bool)
    mask[order] = False
    out[mask] = texts.data[inside]
    joined, at = out.tobytes(), np.append(0, np.cumsum(size))
    return [joined[at[i] : max(at[i], at[i + 1] - 1)] for i in range(texts.n)]
