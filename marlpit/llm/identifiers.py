"""Personal data by fixed patterns, and by contexts bootstrapped from what they find."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from functools import reduce

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm.shared import map_batches, stored
from marlpit.llm.textkit import U, mix

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
#: Characters cut from a candidate's end, and the length from which one counts.
_TRAILING, LEAST_CANDIDATE = ".,;:!?)\"'", 4
#: A candidate: a token with a digit or an at sign, or a run of groups of digits with blanks between, and the digits that a run has at most.
_CANDIDATE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")

#: Groups are parted as in phone numbers and cards, but not by the end of a sentence; 16 digits at once are a whole card.
_GROUP = r"(?![0-9]{16})[0-9]++"
_RUN = re.compile(rf"(?:(?<![^\x20\x09-\x0D\"'\[{{<:=,;/])|(?<=[\x20\x09-\x0D]\()|(?<=^\())\+?(?:\((?=[0-9]++\)))?{_GROUP}(?:(?!\.\x20)[\x20().-]{{1,4}}+{_GROUP})+(?=[.,;:!?)\"']*+(?:[\x20\x09-\x0D]|\Z))")
MOST_DIGITS = 19
#: What an unknown candidate weighs against a pattern that meets it, where a known one of another kind weighs 1.
UNKNOWN = 0.25


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def passes_luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Per kind, the leftmost non-overlapping matches that pass their test; offsets are code points."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if "." in text:
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0]) if m.end() - m.start() >= 16 else ""
        if 16 <= len(digits) <= 19 and passes_luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return out


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


_BLANKS = frozenset("\x20\x09\x0a\x0b\x0c\x0d")
#: Words of more characters than this are known by a hash.
_REACH = 64
_LONG = re.compile(rf"[^\x20\x09-\x0D]{{{_REACH + 1},}}+")


class Neighbours:
    """The whole words on either side of a text's spans, in time linear in the text however long its words are."""

    def __init__(self, text: str):
        self.text, self.long, self.hashed = text, None, {}

    def contexts(self, start: int, end: int) -> tuple[str, str]:
        """The word before and the word after, lower case; a digit in them is written 0."""
        text, b, c = self.text, start, end
        while b and text[b - 1] in _BLANKS:
            b -= 1
        a = b
        while a and b - a <= _REACH and text[a - 1] not in _BLANKS:
            a -= 1
        while c < len(text) and text[c] in _BLANKS:
            c += 1
        d = c
        while d < len(text) and d - c <= _REACH and text[d] not in _BLANKS:
            d += 1
        return self._word(None, b) if b - a > _REACH else _plain(text[a:b]), self._word(c, None) if d - c > _REACH else _plain(text[c:d])

    def _word(self, start: int | None, end: int | None) -> str:
        """The hash of a long word, of which one end is given."""
        if self.long is None:
            self.long = [m.span() for m in _LONG.finditer(self.text)]
        at = bisect_right(self.long, ((end - 1 if start is None else start), len(self.text))) - 1
        a, b = self.long[at]
        if at not in self.hashed:
            codes = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in self.text[a:b]], np.uint64)
            codes[(codes >= 0x30) & (codes <= 0x39)] = 0x30
            place = np.arange(1, b - a + 1, dtype=np.uint64) << U(32)
            # sums over characters and their places, from the first on for words that end anywhere and from the last back for those that begin anywhere
            self.hashed[at] = np.cumsum(mix(codes + place)), np.cumsum(mix(codes[::-1] + place))
        ahead, back = self.hashed[at]
        return f"\x20{int(ahead[end - a - 1] if start is None else back[b - start - 1]):x}"


def _plain(word: str) -> str:
    return re.sub("[0-9]", "0", word.lower())


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that may be identifiers, apart from each other and from those of ``taken``, which are in order.

    Runs of digit groups with a blank come first, up to MOST_DIGITS digits in
    all; what is left are blank-delimited tokens. A longer run stays in tokens.
    """
    runs, at = [], 0
    for a, b in [*taken, (len(text), len(text))]:
        if at < a:
            runs += [m.span() for m in _RUN.finditer(text, at, a) if "\x20" in m[0] and m.end() - m.start() >= LEAST_CANDIDATE and len(_NO_DIGIT.sub("", m[0])) <= MOST_DIGITS]
        at = max(at, b)
    out, closed, at = list(runs), sorted(taken + runs), 0
    for m in _CANDIDATE.finditer(text):
        a, b = m.start(), m.end()
        while b > a and text[b - 1] in _TRAILING:
            b -= 1
        while at < len(closed) and closed[at][1] <= a:
            at += 1
        if b - a >= LEAST_CANDIDATE and (at == len(closed) or closed[at][0] >= b):
            out.append((a, b))
    return out


_LETTERS = re.compile(r"[^\W\d_]")


def shape(instance: str) -> str:
    """The instance with 0 for each digit and a for each letter."""
    return _LETTERS.sub("a", re.sub("[0-9]", "0", instance))


def digest(value: str) -> str:
    return hashlib.blake2b(value.encode(), digest_size=8).hexdigest()


def mentions(documents: DataFrame) -> DataFrame:
    """Per document a row of start -1 with its base spans, and a row for each seed (with its kind) and candidate (kind null) with its neighbouring words. Stored; ``row`` names the document."""

    def run(batch):
        keys = ("row", "doc_id", "kind", "start", "end", "instance", "before", "after", "shape", "base", "counts")
        out: dict[str, list] = {k: [] for k in keys}
        part = TaskContext.get().partitionId() << 36

        def add(*values):
            for k, v in zip(keys, values, strict=True):
                out[k].append(v)

        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py() or ""
            row = part + done[0]
            done[0] += 1
            spans = base_spans(text)
            add(row, doc_id, None, -1, -1, None, None, None, None, joined(spans), [len(spans[k]) for k in KINDS])
            taken = sorted((a, b) for v in spans.values() for a, b in v)
            near = Neighbours(text)
            note = lambda kind, a, b: add(row, None, kind, a, b, digest(text[a:b]), *near.contexts(a, b), digest(shape(text[a:b])), None, None)  # noqa: B023, E731
            for kind, found in spans.items():
                for a, b in found:
                    note(kind, a, b)
            for a, b in candidates(text, taken):
                note(None, a, b)
        yield out

    done = [0]
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(map_batches(docs, run, "row long, doc_id long, kind string, start int, end int, instance string, before string, after string, shape string, base string, counts array<long>"), "mentions")


def bootstrap(found: DataFrame, support: int = 5, confidence: float = 0.8) -> DataFrame:
    """row, start, end, kind of candidates that high-confidence patterns discover.

    A pattern is a neighbouring word on one side of an instance, the words on
    both sides together, or the instance's own shape. The bipartite graph of
    patterns and instances is scored in turns: a pattern's confidence in a kind
    is the mean score of the distinct instances it meets, where seeds count 1
    for their kind, discovered ones what they were discovered with, and those
    still unknown weigh UNKNOWN against it; an instance's score is 1 minus the
    product of its patterns' doubts, over patterns of enough ``support`` by
    known instances of the kind (the first of them seeds) and enough
    ``confidence``. Discovered instances stay, so the turns end: once one
    discovers nothing.
    """
    pair = F.when((F.col("before") != "") & (F.col("after") != ""), F.concat("before", F.lit("\x20"), "after")).otherwise("")
    kinds = [("<", F.col("before")), (">", F.col("after")), ("<>", pair), ("=", F.col("shape"))]
    edges = found.filter("start >= 0").select("instance", "kind", F.explode(F.array(*(F.struct(F.lit(k).alias("side"), w.alias("word")) for k, w in kinds))).alias("p"))
    edges = stored(edges.filter("p.word <> ''").select(F.xxhash64("p.side", "p.word").alias("pattern"), "instance", "kind").distinct(), "edges")
    known = stored(edges.filter("kind is not null").select("instance", "kind", F.lit(1.0).alias("score"), F.lit(True).alias("seed")).distinct(), "known")
    size = edges.groupBy("pattern").agg(F.count_distinct("instance").alias("n"))
    parts = [known]
    while True:
        known = reduce(DataFrame.unionByName, parts)
        met = edges.select("pattern", "instance").distinct().join(known, "instance")
        votes = met.groupBy("pattern", "kind").agg(F.sum("score").alias("votes"), F.count(F.lit(1)).alias("known"))
        weight = size.join(met.groupBy("pattern").agg(F.count_distinct("instance").alias("k")), "pattern").select("pattern", (F.col("k") + UNKNOWN * (F.col("n") - F.col("k"))).alias("n"))
        good = votes.filter(F.col("known") >= support).join(weight, "pattern").withColumn("confidence", F.col("votes") / F.col("n")).filter(F.col("confidence") >= confidence).select("pattern", "kind", "confidence")
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))
        new = edges.filter("kind is null").select("pattern", "instance").join(good, "pattern").groupBy("instance", "kind").agg((1 - doubt).alias("score")).filter(F.col("score") >= confidence)
        best = new.groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("x")).select("instance", "x.kind", "x.score", F.lit(False).alias("seed"))
        fresh = stored(best.join(known.select("instance"), "instance", "left_anti"), "known")
        if fresh.isEmpty():
            break
        parts.append(fresh)
    # seeds are among them, as the fixed patterns can miss in one text what they find in another
    discovered = known.groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("x")).select("instance", F.col("x.kind").alias("as"))
    return found.filter("start >= 0 and kind is null").join(discovered, "instance").select("row", "start", "end", F.col("as").alias("kind"))


def find_personal_data(documents: DataFrame, support: int = 5, confidence: float = 0.8) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and hash are of the base spans; ``spans`` lists these and the
    discovered ones as kind:start:end, by kind and start, in code points with
    exclusive ends. What may be discovered are tokens with a digit or an at sign
    and runs of digit groups parted by blanks (see ``candidates``). Null and empty texts have none; repeated rows come once
    each; without seeds nothing is discovered; an empty table gives no rows.
    """
    found = mentions(documents)
    more = bootstrap(found, support, confidence)
    more = more.groupBy("row").agg(F.collect_list(F.concat_ws(":", "kind", "start", "end")).alias("more"))
    both = found.filter("start = -1").select("row", "doc_id", "base", "counts").join(more, "row", "left")
    every = F.concat(F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ",")), F.coalesce("more", F.array().cast("array<string>")))
    place = lambda x: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), F.split_part(x, F.lit(":"), F.lit(1))).alias("k"), F.split_part(x, F.lit(":"), F.lit(2)).cast("int").alias("s"), x.alias("x"))
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_join(F.transform(F.array_sort(F.transform(every, place)), lambda r: r.x), ","))
    counts = [F.col("counts")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return both.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))
