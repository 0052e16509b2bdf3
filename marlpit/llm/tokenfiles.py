"""Token ids in bit-plane files: id blocks transposed into planes, each plane compressed."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlpit.llm.shared import map_batches, stored
from marlpit.llm.textkit import Chunks, Texts, ragged, slices

MAGIC = b"PLANES01"
#: Ids in a block, and ids after which a file is closed.
BLOCK, FILE_IDS = 1 << 16, 1 << 20


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The byte planes, lowest first, or the bit planes of 32-bit ids."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(rows[:, i]).tobytes() for i in range(4)]
    flags = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(np.ascontiguousarray(flags[:, i]), bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        rows = np.stack([np.frombuffer(p, np.uint8) for p in planes], 1)
    else:
        flags = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], 1)
        rows = np.packbits(flags, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").ravel()


def write_file(ids: np.ndarray, doc_ids: list, lengths: np.ndarray, bits: bool = False, level: int = 1) -> bytes:
    """One file: magic, compressed planes, the chunk index, the documents, and a footer with the place of both.

    The chunk index has offset and size of every plane of every block, so any
    block can be read alone.
    """
    squeeze = zstandard.ZstdCompressor(level=level)
    parts, chunks, at = [MAGIC], [], len(MAGIC)
    for i in range(0, len(ids), BLOCK):
        for plane in to_planes(ids[i : i + BLOCK], bits):
            data = squeeze.compress(plane)
            parts.append(data)
            chunks.append((at, len(data)))
            at += len(data)
    index = squeeze.compress(np.array(chunks, "<i8").reshape(-1, 2).tobytes())
    rows = squeeze.compress(json.dumps(doc_ids).encode() + b"\n" + np.asarray(lengths, "<i8").tobytes())
    head = struct.pack("<qqqqqqq", at, len(index), at + len(index), len(rows), len(ids), BLOCK, 32 if bits else 4)
    return b"".join([*parts, index, rows, head, MAGIC])


def read_file(data: bytes, blocks: range | None = None) -> tuple[np.ndarray, list, np.ndarray]:
    """Ids (of all or some blocks), document ids and their lengths in ids."""
    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError("not a plane file")
    at, size, rows_at, rows_size, n, block, planes = struct.unpack("<qqqqqqq", data[-64:-8])
    expand = zstandard.ZstdDecompressor().decompress
    chunks = np.frombuffer(expand(data[at : at + size]), "<i8").reshape(-1, planes, 2)
    parts = []
    for i in blocks if blocks is not None else range(len(chunks)):
        count = min(block, n - i * block)
        parts.append(from_planes([expand(data[a : a + s]) for a, s in chunks[i].tolist()], count))
    names, _, lengths = expand(data[rows_at : rows_at + rows_size]).partition(b"\n")
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32), json.loads(names), np.frombuffer(lengths, "<i8")


#: Units that are one piece for the tokenizer's own splitting: letters, after a blank or not.
_PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_LETTER, _SOLID, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SOLID[0x21:0x7F] = True
_MARK[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: Units kept with their ids by a worker; rarer ones are encoded each time.
CACHE_UNITS = 400_000


#: Bytes of one text that are encoded at once.
PIECE = 1 << 21


def _cuts(data: np.ndarray) -> np.ndarray:
    """Where the tokenizer's own splitting parts a text for certain; the first byte counts as well."""
    cut = np.zeros(len(data), bool)
    prev, here = data[:-1], data[1:]
    solid = _SOLID[prev]
    solid[1:] |= data[:-2] == 0xC3
    cut[1:] = (((here == 0x20) | (here == 0x0A)) & solid) | (_MARK[here] & _LETTER[prev])
    cut[:1] = True
    return cut


class Encoder:
    """Encodes whole texts with a byte-level BPE tokenizer, each distinct unit of a slice once.

    The tokenizer first splits a text before white space that follows anything
    else, and before punctuation that follows a letter, and never merges over a
    split. Texts are therefore cut at such places (only where the bytes leave no
    doubt), and units that are alike, byte for byte, share their ids.
    """

    def __init__(self, path: str):
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in keep]
        self.letters = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.known: dict[bytes, int] = {}
        self.flat, self.at, self.size, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def unit(self, data: bytes) -> list[int]:
        if _PLAIN.fullmatch(data):
            return [t.id for t in self.model.tokenize(data.decode("latin-1").translate(self.letters))]
        return self.tokenizer.encode(data.decode(), add_special_tokens=False).ids

    def _store(self, number: int, ids: list[list[int]]) -> None:
        """Puts the ids of the units from ``number`` on behind those in use."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while number + len(ids) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.size[number : number + len(ids)] = sizes
        self.at[number : number + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.used += total

    def encode(self, texts: Texts) -> list[np.ndarray]:
        """The ids of each text of a slice; a long text is cut into pieces of about PIECE bytes, so that it takes little more room than its ids."""
        data = texts.data
        if texts.n > 1 or len(data) <= PIECE or any(word in texts.text(0) for word in self.special):
            return self._encode(texts)
        parts, start = [], 0
        while start < len(data):
            size = PIECE
            while True:
                places = np.flatnonzero(_cuts(data[start : start + size]))
                if start + size >= len(data) or len(places) > 1:
                    break
                size *= 2
            end = len(data) if start + size >= len(data) else start + int(places[-1])
            parts += self._encode(Texts(data[start:end], np.array([0, end - start]), 0))
            start = end
        return [np.concatenate(parts)]

    def _encode(self, texts: Texts) -> list[np.ndarray]:
        data, offsets = texts.data, texts.offsets
        if not len(data):
            return [np.zeros(0, np.uint32)] * texts.n
        cut = _cuts(data)
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        keys = Chunks(data).hashes(starts, ends)
        group, kinds = pd.factorize(keys)
        first = np.full(len(kinds), len(starts), np.int64)
        first[group[::-1]] = np.arange(len(starts))[::-1]
        length = ends - starts
        same = length == length[first[group]]
        if same.all():  # then compare byte for byte
            where = ragged(starts[first[group]], length)
            same = np.add.reduceat(data[where] != data, starts) == 0
        if not same.all():  # unequal units under one hash
            _, group = np.unique([data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], return_inverse=True)
            first = np.full(int(group.max()) + 1, len(starts), np.int64)
            first[group[::-1]] = np.arange(len(starts))[::-1]
        raw = data.tobytes()
        get, known = self.known.get, self.known
        names = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        numbers = [get(name, -1) for name in names]
        missing = [i for i, number in enumerate(numbers) if number < 0]
        base, mark = len(known), self.used
        self._store(base, [self.unit(names[i]) for i in missing])
        for number, i in enumerate(missing, base):
            numbers[i] = number
        lasting = missing[: max(0, CACHE_UNITS - base)]  # the others serve this slice only
        known.update(zip([names[i] for i in lasting], range(base, base + len(lasting)), strict=True))
        mark += int(self.size[base : base + len(lasting)].sum())
        which = np.array(numbers, np.int64)[group]
        size = self.size[which]
        ids = self.flat[ragged(self.at[which], size)]
        self.used = mark
        at = np.append(0, np.cumsum(size))[np.append(np.searchsorted(starts, offsets[:-1]), len(starts))]
        out = [ids[at[i] : at[i + 1]] for i in range(texts.n)]
        for word in self.special:
            if word in raw:
                for i in range(texts.n):
                    if word in (text := texts.text(i)):
                        out[i] = np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, with what it has seen."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(documents: DataFrame, path: str, end_id: int = 0, bits: bool = False, order: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Encodes and stores; shard, seq, n_ids, payload: the files in ascending order of doc_id, or of other columns.

    ``path``: the tokenizer's file, there on every executor. Rows without a
    doc_id come first, those that share one in order of their text's hash. A
    null text is empty and so only has ``end_id``. Each file is one row of a
    stored table, so only Spark needs to reach the store and a lost executor's
    files are written again.
    """
    docs = documents.select(*(F.col(c).alias(f"by{i}") for i, c in enumerate(order)), F.col("doc_id").cast("long").alias("doc_id"), "text")
    by = [*(f"by{i}" for i in range(len(order))), F.xxhash64("text")]
    placed = docs.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")
    schema = pa.schema([("shard", pa.int64()), ("seq", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        coder, shard, seq = encoder(path), TaskContext.get().partitionId(), 0
        ids, names, sizes, held = [], [], [], 0
        end = np.array([end_id], np.uint32)

        def close():
            data = write_file(np.concatenate(ids), names, np.array(sizes), bits)
            return pa.RecordBatch.from_pydict({"shard": [shard], "seq": [seq], "n_ids": [held], "payload": [data]}, schema=schema)

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for texts in slices(batch.column("text"), 1 << 20):
                for i, own in enumerate(coder.encode(texts)):
                    ids += [own, end]
                    names.append(keys[texts.first + i])
                    sizes.append(len(own) + 1)
                    held += len(own) + 1
                if held >= FILE_IDS:
                    yield close()
                    ids, names, sizes, held, seq = [], [], [], 0, seq + 1
        if names:
            yield close()

    return stored(placed.mapInArrow(run, "shard long, seq long, n_ids long, payload binary"), "tokens")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row a shard
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("shard_start"))
    inner = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = files.select("shard", "seq", "n_ids").withColumn("inner", F.sum("n_ids").over(inner) - F.col("n_ids")).join(before, "shard").select("shard", "seq", (F.col("shard_start") + F.col("inner")).alias("file_start"))

    def run(batch):
        for shard, seq, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "seq", "payload")), strict=True):
            ids, names, sizes = read_file(data)
            at = np.append(0, np.cumsum(sizes))
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield {"shard": [shard] * len(names), "seq": [seq] * len(names), "doc_id": names, "at": at[:-1], "n_tokens": sizes, "ids_crc32": crc}

    found = map_batches(files.select("shard", "seq", "payload"), run, "shard long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["shard", "seq"]).select("doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
