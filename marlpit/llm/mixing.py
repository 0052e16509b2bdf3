"""Mixing sources to target weights by temperature."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlpit.llm.shared import drop, stored

#: A table of a row a source is broadcast up to so many sources; beyond, Spark chooses the join.
BROADCAST_SOURCES = 100_000
#: No exponent beyond is tried.
FARTHEST = 2.0**50
#: Columns that mixing adds; it takes the place of columns of these names.
MIXED = ("tokens", "source_tokens", "weight", "quota", "copies", "place")
#: Blocks of a source whose tokens are summed before the sums are put in order.
BLOCKS_A_SUM = 1024


def temperature(tokens: dict[str, int], entropy: float | None = None, repeats: float | None = None, budget: int | None = None) -> tuple[float, dict[str, float]]:
    """The exponent and the normalised weights share**exponent of each source.

    ``entropy``: the target, as a share of the greatest possible (log of the
    number of sources). ``repeats``: no source may be read more often than that
    under ``budget`` tokens (all tokens by default). The exponent is bisected
    from 0, uniform, by 1, the natural shares, to as far as the target needs;
    the smallest exponent that keeps both limits is taken, where entropy falls
    as the exponent grows, and rarest sources' repeats fall up to 1. Beyond 1,
    which only the entropy may ask for, the largest sources' repeats grow: there
    the exponent ends where the limit on repeats is reached. A limit that can't
    be kept is warned of; one that no exponent keeps leaves the natural shares.
    """
    total = sum(tokens.values())
    names = sorted(s for s, n in tokens.items() if n > 0)
    if not names:
        return 1.0, {}
    budget = total if budget is None else budget

    def weights(a: float) -> dict[str, float]:
        logs = {s: a * math.log(tokens[s] / total) for s in names}
        top = max(logs.values())
        scale = math.fsum(math.exp(x - top) for x in logs.values())
        return {s: math.exp(x - top) / scale for s, x in logs.items()}

    def bisect(good, lo: float, hi: float) -> float:
        """Between ``lo``, for which ``good`` doesn't hold, and ``hi``, for which it does, the end where it still holds."""
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if good(weights(mid)) else (mid, hi)
        return hi

    spread = lambda w: -math.fsum(x * math.log(x) for x in w.values() if x > 0)
    level = lambda w: spread(w) <= entropy * math.log(len(names))
    spare = lambda w: all(w[s] * budget <= repeats * tokens[s] * (1 + 1e-12) for s in names)
    exponent = 0.0
    if entropy is not None and len(names) > 1 and not level(weights(0.0)):
        far = 1.0
        while far < FARTHEST and not level(weights(far)):
            far *= 2
        if level(weights(far)):
            exponent = bisect(level, 0.0 if far == 1.0 else far / 2, far)
        else:
            warnings.warn(f"no exponent gives the entropy {entropy}: the largest sources are equal; natural shares are kept", stacklevel=2)
            exponent = 1.0
    if repeats is not None:
        if not spare(weights(1.0)):
            warnings.warn(f"no exponent keeps {repeats} repeats under {budget} tokens; natural shares are kept", stacklevel=2)
            exponent = 1.0
        elif exponent > 1.0 and not spare(weights(exponent)):
            exponent = bisect(spare, exponent, 1.0)
            warnings.warn(f"the entropy {entropy} is not reached: {repeats} repeats end the exponent at {exponent:.6g}, at an entropy of {spread(weights(exponent)) / math.log(len(names)):.6g}", stacklevel=2)
        elif exponent < 1.0 and not spare(weights(exponent)):
            exponent = bisect(spare, exponent, 1.0)
    if entropy is None and repeats is None:
        exponent = 1.0
    return exponent, weights(exponent)


def mix_sources(documents: DataFrame, **options) -> DataFrame:
    """Per document: its columns and tokens, source_tokens, weight, quota, copies, place.

    Tokens are words (runs of non-blanks). Each source gets weight * budget
    tokens, budget being ``budget_share`` of all. Its documents stand in a
    permutation of blocks, each block a permutation of its documents, both by a
    seeded hash of id and text; whole passes give every document a copy and the
    last pass runs until the quota is reached, so a source exceeds its quota by
    less than one document. ``place`` is where in the mixed corpus, from 0 to 1,
    the document's first copy stands; sources advance side by side, each through
    its permutation. Documents without words follow their place; a
    missing source is a source of its own; equal rows stand in one place and
    get as many copies each; a text of any length is one document; an empty
    table gives no rows.

    ``options`` are those of ``placed_copies``. A column of a name that is added
    here is replaced, all others may have any name. Only counts are shuffled,
    texts are not. The bisection needs the sources' token counts, a row each, on
    the driver.
    """
    out = placed_copies(documents, **options).withColumn("place", F.when(F.col("copies") > 0, F.col("part") / F.col("passes")))
    return out.select(*(F.col("row")[c].alias(c) for c in documents.columns if c not in MIXED), *MIXED)


def _crossing(sums: DataFrame, key: str, base: Column) -> DataFrame:
    """Of each source the first key, in order, by which the sum of n reaches rest, and the sum before it, at."""
    so_far = base + F.sum("n").over(Window.partitionBy("src").orderBy(key))
    return sums.withColumn("at", so_far - F.col("n")).filter((F.col("at") < F.col("rest")) & (F.col("at") + F.col("n") >= F.col("rest")))


def placed_copies(documents: DataFrame, entropy: float | None = None, repeats: float | None = 2.0, budget_share: float = 1.0, seed: int = 17, block_tokens: int = 1 << 20) -> DataFrame:
    """row (the document's columns), tokens, source_tokens, weight, quota, copies, and where in a pass it stands (part, from 0 to 1) of how many passes."""
    docs = documents.select(
        F.struct("*").alias("row"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("src"),
        F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+"))).cast("long").alias("tokens"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"),
    )
    narrow = stored(docs.select("src", "tokens", "h"), "counts")
    sizes = {r["src"]: r["n"] for r in narrow.groupBy("src").agg(F.sum("tokens").alias("n")).collect()}
    budget = int(sum(sizes.values()) * budget_share)
    _, weights = temperature(sizes, entropy, repeats, budget)
    quota = {s: math.floor(weights.get(s, 0.0) * budget) for s in sizes}
    plan = documents.sparkSession.createDataFrame(
        [(s, n, weights.get(s, 0.0), quota[s], quota[s] // n if n else 0, quota[s] % n if n else 0, -(-n // block_tokens) or 1) for s, n in sorted(sizes.items())],
        "src string, source_tokens long, weight double, quota long, whole long, rest long, blocks long",
    )
    block = F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.col("blocks"))
    counted = narrow.join(plan, "src").withColumn("b", block)
    # the block of each source in which the last pass ends: among sums of many blocks first, then among these
    sums = stored(counted.groupBy("src", "b", "rest").agg(F.sum("tokens").alias("n")).withColumn("g", F.floor(F.col("b") / BLOCKS_A_SUM)), "blocks")
    group = _crossing(sums.groupBy("src", "g", "rest").agg(F.sum("n").alias("n")), "g", F.lit(0)).select("src", "g", F.col("at").alias("base"))
    last = stored(_crossing(sums.join(group, ["src", "g"]), "b", F.col("base")).select("src", F.col("b").alias("cb"), "at"), "last")
    # the first place in that block before which the quota is reached
    inside = counted.filter("tokens > 0").join(last, "src").filter("b = cb").groupBy("src", "rest", "at", "h").agg(F.sum("tokens").alias("n"))
    before = F.col("at") + F.sum("n").over(Window.partitionBy("src").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    stop = inside.withColumn("before", before).filter("before >= rest").groupBy("src").agg(F.min("h").alias("ch"))
    cut = stored(plan.join(last.drop("at"), "src", "left").join(stop, "src", "left").withColumn("cb", F.coalesce("cb", F.lit(-1))), "cut")
    drop(narrow, sums, last)
    out = docs.join(F.broadcast(cut) if len(sizes) <= BROADCAST_SOURCES else cut, "src").withColumn("b", block)
    extra = (F.col("b") < F.col("cb")) | ((F.col("b") == F.col("cb")) & (F.col("ch").isNull() | (F.col("h") < F.col("ch"))))
    part = (F.col("b") + (F.col("h") / 2.0**64 + 0.5)) / F.col("blocks")
    passes = F.when(F.col("quota") > 0, F.col("quota") / F.col("source_tokens")).otherwise(1.0)
    return out.select("row", "tokens", "source_tokens", "weight", "quota", (F.col("whole") + F.when(extra, 1).otherwise(0)).alias("copies"), part.alias("part"), passes.alias("passes"))


def realised(documents: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as its copies say, with its own columns alone, in the order of the places of its copies.

    Every stretch of the order holds the sources by their weights, and what a
    source adds to it follows the source's block permutation, pass after pass.
    Nulls, ties, repeated rows, long texts and clashing names are as in
    ``mix_sources``; an empty table gives no rows.
    """
    out = placed_copies(documents, **options).filter("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    place = (F.col("pass") + F.col("part")) / F.col("passes")
    return out.withColumn("place", place).repartitionByRange("place").sortWithinPartitions("place").select("row.*")
