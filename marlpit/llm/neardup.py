"""Exact Jaccard join on word shingles by adaptive multi-match prefixes.

Two sets can only be similar if their prefixes share tokens, in any fixed order
of all tokens: with similarity t and required matches l, the first
|x| - ceil(t|x|) + l tokens of x hold l tokens of any set similar to it. The
join uses this three times:

1. every document, tokens in order of hash: with fewer than l tokens in its
   prefix that any other document's prefix has too, it is linked with nothing;
2. what is left, all tokens: fewer than ceil(t|x|) tokens shared with any other
   set settles it likewise. Sets are then ordered by the tokens' document
   counts, the rarest first;
3. each document takes the l that costs it least by an estimate from those
   counts; pairs need min(l) common tokens in the lengthened prefixes before
   they are verified.

Only components are asked for, so groups are not expanded into pairs. In each
round a document is verified against one pivot, the member of a shared token's
group with which it has most tokens in common, and linked groups shrink to one
component. What still crosses components is then met through the first token
that a pair has in common, with all that is common behind it, counted in the
lengthened prefixes and verified.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlpit.llm.components import components
from marlpit.llm.shared import drop, id_key, map_batches, stored
from marlpit.llm.textkit import SPACE_WORD, Levels, Texts, mix, ragged, slices

#: Matches that the first filter asks for: so many, and one more for each so many tokens, as long sets share some by chance.
FIRST_MATCHES, TOKENS_A_MATCH = 16, 12
#: Numbers of matches that the join chooses from for each document.
MATCHES = (1, 2, 4, 8, 16, 32)
#: A token is hot if it makes up more than this share of the tokens of a sample, one document in SAMPLE; so there are at most so many hot ones.
SAMPLE, HOT_SHARE, HOT_LEAST = 32, 1 / 100_000, 100
ROUNDS = 2


def shingle_sets(texts: Texts, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, ends, rows = texts.words(SPACE_WORD)
    count = np.bincount(rows, minlength=texts.n)
    first = np.cumsum(count) - count
    n = np.where(count == 0, 0, np.maximum(1, count - words + 1))
    begin = ragged(first, n)
    keys = Levels(texts.word_hashes(starts, ends, lower=True)).spans(begin, np.repeat(np.minimum(count, words), n))
    at = np.append(0, np.cumsum(n))
    return [np.unique(keys[at[i] : at[i + 1]]) for i in range(texts.n)]


def needed(n, percent: int):
    """The least overlap with any similar set: ceil(t n)."""
    return (n * percent + 99) // 100


def with_count(tokens: DataFrame, sample: DataFrame) -> DataFrame:
    """Adds c, how many rows have the token, and drops tokens that only one owner has.

    Rows of a token meet in one task, but for hot ones, a bounded list found in
    ``sample``, tokens of one row in SAMPLE: they are dealt out, kept as shared,
    and c is estimated. That only decides order and effort, never a result.
    """
    limit = F.greatest(F.lit(HOT_LEAST), (F.col("n") * HOT_SHARE).cast("long"))
    count = stored(sample.groupBy("token").agg(F.count(F.lit(1)).alias("s")), "sample")
    hot = stored(count.crossJoin(F.broadcast(count.agg(F.sum("s").alias("n")))).filter(F.col("s") > limit).select("token", "s"), "hot")
    salt = F.when(F.col("s").isNotNull(), F.pmod(F.xxhash64("owner"), F.lit(256))).otherwise(0)
    one = Window.partitionBy("token", "salt")
    met = tokens.join(F.broadcast(hot), "token", "left").withColumn("salt", salt)
    met = met.withColumns({"c": F.coalesce(F.col("s") * SAMPLE, F.count(F.lit(1)).over(one)), "lo": F.min("owner").over(one), "hi": F.max("owner").over(one)})
    return met.filter("s is not null or lo <> hi").drop("lo", "hi", "salt", "s")


def similar_groups(documents: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, text_hash (xxhash64), group_id (a number shared by linked rows only).

    Documents link when 100 * common shingles >= ``percent`` * all shingles of
    both. component_id is the least doc_id reachable over links, the document's
    own if it has none. A null text, or one without words, has no shingles and
    no links; a text of fewer words is one shingle. A missing doc_id counts as
    the largest, 2**63 - 1; repeated rows come once each and link; an empty
    table gives no rows.
    """
    hashes = {"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")}
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), id_key().alias("k1"), "text").withColumns(hashes | {"uid": F.xxhash64("k1", "t1")})

    def lead(batch):
        owner = np.asarray(batch.column("t1"))
        for texts in slices(batch.column("text")):
            sets = shingle_sets(texts, words)
            size = np.array([len(s) for s in sets])
            l = np.minimum(FIRST_MATCHES + size // TOKENS_A_MATCH, np.maximum(needed(size, percent), 1))  # noqa: E741
            take = np.minimum(size, size - needed(size, percent) + l)
            yield {"token": np.concatenate([s[:k] for s, k in zip(sets, take, strict=True)]).view(np.int64), "owner": np.repeat(owner[texts.first : texts.first + texts.n], take), "l": np.repeat(l, take).astype(np.int16)}

    first = lambda some: map_batches(some.select("t1", "text"), lead, "token long, owner long, l short")
    alive = with_count(first(docs), first(docs.filter(F.pmod(F.col("uid"), F.lit(SAMPLE)) == 0))).groupBy(F.col("owner").alias("t1")).agg(F.count_distinct("token").alias("m"), F.max("l").alias("l")).filter("m >= l").select("t1")
    # equal texts are one; the row of the least uid stands for them, if any other text may be similar
    equal = docs.select("t1", "t2", "uid", "k1").groupBy("t1", "t2").agg(F.min("uid").alias("uid"), F.min("k1").alias("k1"))
    equal = stored(equal.join(alive.withColumn("live", F.lit(1)), "t1", "left").withColumn("live", F.coalesce("live", F.lit(0))), "equal")

    def whole(batch):
        live, k1, t1, t2 = (np.asarray(batch.column(c)) for c in ("live", "k1", "t1", "t2"))
        part = TaskContext.get().partitionId()
        for texts in slices(batch.column("text")):
            sets = shingle_sets(texts, words)
            here = slice(texts.first, texts.first + texts.n)
            size = np.array([len(s) for s in sets])
            keep = (live[here] == 1) & (size > 0)
            kept = [s if k else s[:0] for s, k in zip(sets, keep, strict=True)]
            ends = np.append(0, np.cumsum([len(s) for s in kept])).astype(np.int32)
            sig = [[int(mix(s, salt).sum()) & (2**64 - 1) for s in kept] for salt in (7, 8)]
            yield {
                "doc_id": batch.column("doc_id").slice(texts.first, texts.n), "k1": k1[here], "rid": (part << 36) + count[0] + np.arange(texts.n), "t1": t1[here], "t2": t2[here], "n": size, "live": keep,
                "sig1": np.array(sig[0], np.uint64).view(np.int64), "sig2": np.array(sig[1], np.uint64).view(np.int64), "toks": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept).view(np.int64))),
            }
            count[0] += texts.n

    count = [0]
    every = docs.join(equal.filter("live = 1").select("uid", "live"), "uid", "left").withColumn("live", F.coalesce("live", F.lit(0)))
    rows = stored(map_batches(every, whole, "doc_id long, k1 long, rid long, t1 long, t2 long, n long, live boolean, sig1 long, sig2 long, toks array<long>"), "sets")
    live = rows.filter("live").join(equal.select("t1", "t2", F.col("k1").alias("tk1")), ["t1", "t2"])
    classes = stored(live.groupBy("sig1", "sig2").agg(F.min("rid").alias("nid"), F.min("tk1").alias("k1")), "classes")
    reps = rows.filter("live").select(F.col("rid").alias("nid"), "n", "toks").join(classes.select("nid", "k1"), "nid")
    ordered = _ordered(reps, percent)
    found = classes.join(_least(_joined(ordered, percent), ordered), "nid", "left").select("sig1", "sig2", F.coalesce("component_id", "k1").alias("component_id"), F.coalesce("label", "nid").alias("group_id"))
    found = live.select("t1", "t2", "sig1", "sig2").join(found, ["sig1", "sig2"]).drop("sig1", "sig2").distinct()
    # stored, so that the rows of a hot text can be split in the join with the one row they have here
    settled = stored(equal.join(found, ["t1", "t2"], "left").select("t1", "t2", F.coalesce("component_id", "k1").alias("component_id"), F.coalesce("group_id", "uid").alias("group_id")), "settled")
    some = rows.filter("n > 0").select("doc_id", "n", "t1", "t2").join(settled, ["t1", "t2"])
    some = some.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("t1").alias("text_hash"), "group_id")
    return some.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("k1").alias("component_id"), F.col("t1").alias("text_hash"), F.col("rid").alias("group_id")))


def _least(labels: DataFrame, ordered: DataFrame) -> DataFrame:
    """nid, label, component_id: the least k1 of each component, counted before the shuffle."""
    both = labels.join(ordered.select("nid", "k1"), "nid")
    return both.join(both.groupBy("label").agg(F.min("k1").alias("component_id")), "label").select("nid", "label", "component_id")


def _ordered(reps: DataFrame, percent: int) -> DataFrame:
    """nid, k1, n and toks (df, token; rarest first, only shared ones) of sets with enough shared tokens. Stored."""
    tokens = reps.select(F.col("nid").alias("owner"), F.explode("toks").alias("token"))
    tokens = with_count(tokens, tokens.filter(F.pmod(F.xxhash64("owner"), F.lit(SAMPLE)) == 0))
    shared = tokens.groupBy(F.col("owner").alias("nid")).agg(F.sort_array(F.collect_list(F.struct(F.col("c").cast("int").alias("df"), "token"))).alias("toks"))
    return stored(reps.select("nid", "k1", "n").join(shared, "nid").filter(100 * F.size("toks") >= percent * F.col("n")), "ordered")


def prefixes(ordered: DataFrame, percent: int) -> DataFrame:
    """token, nid, n, s, w, l, pos: the prefix entries of each set under the number of matches that costs it least.

    s is the number of the set's tokens that others have, w the mean document
    count of its tokens, pos the token's place.

    With l matches the prefix's lists hold cost(l) entries; about cost(l) / l
    candidates have enough matches, and each costs a pass over the set.
    """

    def run(batch):
        nid, n = (np.asarray(batch.column(c)) for c in ("nid", "n"))
        lists = batch.column("toks")
        ends = np.asarray(lists.offsets).astype(np.int64)
        flat = lists.flatten()
        df, token = np.asarray(flat.field(0)).astype(np.int64), np.asarray(flat.field(1))
        ends -= ends[0]
        taken, size, matches = [], [], []
        for i in range(len(nid)):
            a, b = ends[i], ends[i + 1]
            alone = n[i] - (b - a)  # tokens that no other set has come first
            cost = np.append(0, np.cumsum(df[a:b] - 1))
            best = None
            for l in MATCHES:  # noqa: E741
                if l > needed(n[i], percent):
                    break
                take = int(min(max(n[i] - needed(n[i], percent) + l - alone, 0), b - a))
                price = cost[take] + cost[take] / l * np.sqrt(n[i]) + 4 * take
                if best is None or price < best[0]:
                    best = price, take, l
            taken.append(token[a : a + best[1]])
            size.append(best[1])
            matches.append(best[2])
        take = np.array(size)
        w = np.add.reduceat(np.append(df, 0), ends[:-1]) / np.maximum(n, 1)
        yield {"token": np.concatenate(taken), "nid": np.repeat(nid, take), "n": np.repeat(n, take), "s": np.repeat(np.diff(ends), take), "w": np.repeat(w, take), "pos": ragged(np.zeros(len(take), np.int64), take), "l": np.repeat(np.array(matches), take).astype(np.int16)}

    return stored(map_batches(ordered, run, "token long, nid long, n long, s long, w double, l short, pos long"), "prefixes")


def verified(pairs: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """a, b, common, union and similar for each pair; every set is sent once to its pairs' other side."""
    tokens = ordered.select("nid", "n", F.col("toks.token").alias("t"))
    half = pairs.join(tokens.select(F.col("nid").alias("a"), F.col("n").alias("na"), F.col("t").alias("ta")), "a")
    both = half.join(tokens.select(F.col("nid").alias("b"), F.col("n").alias("nb"), F.col("t").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb")).cast("long")
    out = both.select("a", "b", common.alias("common"), (F.col("na") + F.col("nb")).alias("total"))
    return out.select("a", "b", "common", (F.col("total") - F.col("common")).alias("union")).withColumn("similar", 100 * F.col("common") >= percent * F.col("union"))


def _joined(ordered: DataFrame, percent: int) -> DataFrame:
    """nid, label of each set that is linked with another one."""
    spark = ordered.sparkSession
    entries = prefixes(ordered, percent)
    labels = spark.createDataFrame([], "nid long, label long")
    tested: list[DataFrame] = []
    enough = lambda shared, total: (100 + percent) * shared >= percent * total

    def current() -> DataFrame:
        return entries.join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid"))

    for turn in range(ROUNDS):
        now = current()
        # first the set of the most widespread tokens, which is the middle of a group of edited copies
        order = F.xxhash64(F.col("nid"), F.lit(turn)).cast("double") if turn else -F.col("w")
        pivot = now.groupBy("token").agg(F.min(F.struct(order.alias("o"), "nid", "n", "s", "label")).alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token", F.col("p.nid").alias("b"), F.col("p.n").alias("pn"), F.col("p.s").alias("ps"), F.col("p.label").alias("pl"))
        # tokens that no other set has can't be common
        met = now.join(pivot, "token").filter((F.col("label") != F.col("pl")) & enough(F.least("s", "ps"), F.col("n") + F.col("pn"))).groupBy(F.col("nid").alias("a"), "b").agg(F.count(F.lit(1)).alias("m"), F.min("pos").alias("pos"))
        for old in tested:
            met = met.join(old.select("a", "b"), ["a", "b"], "left_anti")
        # the pivot with most tokens in common and the one with the rarest
        best = met.groupBy("a").agg(F.max(F.struct("m", "b")).alias("x"), F.min(F.struct("pos", "b")).alias("y")).select("a", F.explode(F.array_distinct(F.array("x.b", "y.b"))).alias("b"))
        fresh = stored(verified(best, ordered, percent), "verified")
        if fresh.isEmpty():
            break
        tested.append(fresh)
        links = reduce(DataFrame.unionByName, tested).filter("similar").select("a", "b")
        labels = components(links)
    # The first common token of a pair is in the shortest prefix of both, and all that is common stands behind it. So entries
    # meet under the first of these conditions only, which leaves about the pairs that differ by the tokens they lack.
    now = current().filter(100 * (F.col("s") - F.col("pos")) >= percent * F.col("n"))
    open_ = now.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token")
    left = stored(now.join(open_, "token").select("token", "nid", "n", (F.col("s") - F.col("pos")).alias("rest"), "label"), "left")
    mate = left.select("token", F.col("nid").alias("b"), F.col("n").alias("pn"), F.col("rest").alias("prest"), F.col("label").alias("plabel"))
    pairs = left.join(mate, "token").filter((F.col("nid") < F.col("b")) & (F.col("label") != F.col("plabel")) & enough(F.least("rest", "prest"), F.col("n") + F.col("pn"))).select(F.col("nid").alias("a"), "b").distinct()
    for old in tested:
        pairs = pairs.join(old.select("a", "b"), ["a", "b"], "left_anti").join(old.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    pairs = stored(multi_matched(pairs, entries), "pairs")
    last = stored(verified(pairs, ordered, percent), "verified").filter("similar").select("a", "b")
    out = components(reduce(DataFrame.unionByName, [x.filter("similar").select("a", "b") for x in tested] + [last]))
    drop(entries, left, pairs)
    return out


def multi_matched(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """The pairs whose lengthened prefixes have as many tokens in common as the shorter of the two lengthenings asks for."""
    lists = entries.groupBy("nid").agg(F.collect_list("token").alias("t"), F.max("l").alias("l"))
    for side in "ab":
        pairs = pairs.join(lists.select(F.col("nid").alias(side), F.col("t").alias(f"t{side}"), F.col("l").alias(f"l{side}")), side)
    return pairs.filter(F.size(F.array_intersect("ta", "tb")) >= F.least("la", "lb")).select("a", "b")
