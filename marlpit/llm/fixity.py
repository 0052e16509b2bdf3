"""Fixity audit of archived pages with Merkle trees over ordered offset ranges."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlpit.llm.shared import stored


#: The page_id that rows without one are placed by: the largest of all.
NO_PAGE = (1 << 63) - 1


def warc_records(pages: DataFrame, unnamed: bool = False, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """page_id, record: each page as a WARC response record; a missing url or html counts as empty.

    ``date`` is the WARC-Date of all records, as pages have none of their own.

    Rows without a page_id are left out unless ``unnamed`` is set: then they
    are records without an id, which stand last as NO_PAGE. Repeated ids are
    records of their own, ordered by content.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    head = F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return (pages if unnamed else pages.filter("page_id is not null")).select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_PAGE)).alias("page_id"), F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record"))


def leaves(records: DataFrame, span: int = 32) -> DataFrame:
    """leaf, n, bytes, records, digest: ``span`` consecutive ids make a leaf.

    ``records`` lists page_id, length, digest and how often it is there of each
    different record; the leaf's digest is over those lines in order, so it
    covers every byte, the order and the offsets.
    """
    each = records.select(F.floor(F.col("page_id") / span).alias("leaf"), "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    each = each.groupBy("leaf", "page_id", "length", "digest").agg(F.count(F.lit(1)).alias("n"))
    leaf = each.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("page_id", "length", "digest", "n"))).alias("records"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("length")).alias("bytes"))
    line = F.transform("records", lambda r: F.concat_ws(":", r.page_id.cast("string"), r.length.cast("string"), r.digest, r.n.cast("string")))
    return leaf.select("leaf", "n", "bytes", "records", F.sha2(F.array_join(line, "\n"), 256).alias("digest"))


def tree(leaf: DataFrame, fanout: int, depth: int) -> list[DataFrame]:
    """The levels from leaves to root, each with node, bytes and digest; a parent hashes its children in order."""
    levels = [leaf.select(F.col("leaf").alias("node"), "bytes", "digest")]
    for _ in range(depth):
        child = F.struct("node", "bytes", "digest")
        up = levels[-1].select(F.floor(F.col("node") / fanout).alias("parent"), child.alias("c")).groupBy("parent").agg(F.sort_array(F.collect_list("c")).alias("c"))
        text = F.array_join(F.transform("c", lambda c: F.concat_ws(":", c.node.cast("string"), c.bytes.cast("string"), c.digest)), "\n")
        levels.append(up.select(F.col("parent").alias("node"), F.aggregate("c", F.lit(0).cast("long"), lambda s, c: s + c.bytes).alias("bytes"), F.sha2(text, 256).alias("digest")))
    return levels


def audit(left: DataFrame, right: DataFrame, span: int = 32, fanout: int = 64) -> DataFrame:
    """Every record of either copy: page_id, leaf, copies of it and lengths on both sides, status, path, first_difference.

    ``left`` and ``right`` have page_id and record. Trees are compared from
    the roots down, and only children of differing nodes are compared further;
    only records below differing leaves are compared one by one. status:
    ``ok``, ``altered``, ``missing`` (not in right), ``extra`` (not in left).
    ``path`` is the chain of nodes from the root for records that are not ok,
    and ``first_difference`` the byte offset, within the leaf's range of the
    left copy, where the page's records begin, or would begin if they are extra.
    Empty copies give no rows or all
    missing or extra.
    """
    a, b = (stored(leaves(x, span), "leaves") for x in (left, right))
    # the leaf of records without an id is below a root of its own, so that it doesn't make all paths longer
    last = min(NO_PAGE, math.floor(float(NO_PAGE) / span))
    top = max([0, *(abs(v) for x in (a, b) for v in x.filter(F.col("leaf") < last).agg(F.max("leaf"), F.min("leaf")).first() if v is not None)])
    depth = 1
    while fanout**depth <= top:
        depth += 1
    ta, tb = ([stored(level, "level") if i else level for i, level in enumerate(tree(x, fanout, depth))] for x in (a, b))
    differing = None
    for x, y in zip(reversed(ta), reversed(tb), strict=True):
        if differing is not None:
            above = differing
            x, y = (t.withColumn("_up", F.floor(F.col("node") / fanout)).join(above, "_up", "left_semi") for t in (x, y))
        x, y = x.select("node", F.col("digest").alias("dx")), y.select("node", F.col("digest").alias("dy"))
        differing = stored(x.join(y, "node", "full").filter(~F.col("dx").eqNullSafe(F.col("dy"))).select(F.col("node").alias("_up")), "differing")
    bad = differing.select(F.col("_up").alias("leaf"))
    lines = lambda t: t.select("leaf", F.posexplode("records").alias("i", "r")).select("leaf", "r.page_id", "r.length", "r.digest", "r.n")
    count = lambda t, s: lines(t).groupBy("leaf", "page_id", "digest").agg(F.sum("n").alias(f"n{s}"), F.max("length").alias(f"len{s}"))
    same = lines(a.join(bad, "leaf", "left_anti")).groupBy("leaf", "page_id").agg(F.sum("n").alias("n_left"), F.sum(F.col("n") * F.col("length")).alias("bytes_left"))
    same = same.select("*", F.col("n_left").alias("n_right"), F.col("bytes_left").alias("bytes_right"), F.lit("ok").alias("status"))
    met = count(a.join(bad, "leaf", "left_semi"), "a").join(count(b.join(bad, "leaf", "left_semi"), "b"), ["leaf", "page_id", "digest"], "full")
    na, nb = (F.coalesce(c, F.lit(0).cast("long")) for c in ("na", "nb"))
    diff = met.groupBy("leaf", "page_id").agg(
        F.sum(na).alias("n_left"), F.sum(na * F.coalesce("lena", F.lit(0))).alias("bytes_left"), F.sum(nb).alias("n_right"), F.sum(nb * F.coalesce("lenb", F.lit(0))).alias("bytes_right"), F.sum(F.abs(na - nb)).alias("gap")
    )
    status = F.when(F.col("gap") == 0, "ok").when(F.col("n_right") == 0, "missing").when(F.col("n_left") == 0, "extra").otherwise("altered")
    # a leaf has few ids, whose lengths in order give the offsets
    offset = F.coalesce(F.sum("bytes_left").over(Window.partitionBy("leaf").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    diff = diff.withColumn("status", status).drop("gap").withColumn("first_difference", F.when(F.col("status") != "ok", offset))
    found = same.withColumn("first_difference", F.lit(None).cast("long")).unionByName(diff)
    node = F.col("leaf")
    path = reduce(lambda p, _: [F.floor(p[0] / fanout), *p], range(depth), [node])
    text: Column = F.concat_ws("/", *(x.cast("string") for x in path))
    return found.withColumn("path", F.when(F.col("status") != "ok", text))


def damaged(pages: DataFrame, every: int = 97) -> DataFrame:
    """A replica with known damage, for drills: of each ``every`` ids one loses a record, one is altered in its last byte."""
    at = F.pmod(F.col("page_id"), F.lit(every))
    return pages.filter(~at.eqNullSafe(F.lit(13))).withColumn("html", F.when(at == 7, F.concat(F.coalesce("html", F.lit("")), F.lit("?"))).otherwise(F.col("html")))
