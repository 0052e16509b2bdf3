"""Mixing and fixity by their properties and against plain versions."""

import hashlib
import math
import warnings

import pytest
from marlpit.llm import fixity, mixing

from tests.conftest import SF
from tests.llm import brute


def test_temperature():
    sizes = {"a": 1000, "b": 100, "c": 10}
    _, w = mixing.temperature(sizes, entropy=0.8)
    assert math.isclose(-sum(x * math.log(x) for x in w.values()), 0.8 * math.log(3), rel_tol=1e-6)
    a, w = mixing.temperature(sizes, repeats=2.0)
    assert math.isclose(max(w[s] * 1110 / sizes[s] for s in sizes), 2.0, rel_tol=1e-6) and 0 < a < 1
    assert mixing.temperature(sizes)[0] == 1.0 and mixing.temperature({}, repeats=2.0) == (1.0, {})
    assert mixing.temperature({"a": 5, "z": 0}, entropy=0.5)[1] == {"a": 1.0}
    assert mixing.temperature(sizes, repeats=1000.0)[0] == 0.0


def test_temperature_near_uniform():
    """Sources more level than the target are drawn apart, as far as repeats allow; what can't be met is told."""
    level = lambda w: -sum(x * math.log(x) for x in w.values() if x) / math.log(len(w))
    sizes = {f"s{i}": 100_000 + 500 * i for i in range(20)}
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        a, w = mixing.temperature(sizes, entropy=0.97)
        b, v = mixing.temperature(sizes, entropy=0.97, repeats=5.0)
    assert a > 1 and math.isclose(level(w), 0.97, rel_tol=1e-6) and (a, w) == (b, v)
    total = sum(sizes.values())
    with pytest.warns(UserWarning, match="not reached"):
        a, w = mixing.temperature(sizes, entropy=0.5, repeats=2.0)
    assert a > 1 and math.isclose(max(w[s] * total / sizes[s] for s in sizes), 2.0, rel_tol=1e-6) and level(w) > 0.5
    with pytest.warns(UserWarning, match="no exponent gives"):
        assert mixing.temperature(dict.fromkeys("abc", 10), entropy=0.97)[0] == 1.0
    with pytest.warns(UserWarning, match="no exponent keeps"):
        assert mixing.temperature(sizes, repeats=2.0, budget=3 * total)[0] == 1.0
    a, w = mixing.temperature({"a": 10**9, "b": 10**9 - 1, "c": 1}, entropy=0.01)
    assert a > 10**8 and math.isclose(level(w), 0.01, rel_tol=1e-3)


@pytest.mark.parametrize("block", [1, 500, 1 << 20])
def test_mixing(spark, block):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnsRenamed({"n_chars": "weight"})
    out = mixing.mix_sources(docs, entropy=0.97, repeats=2.0, block_tokens=block).toPandas()
    assert len(out) == 200 and out.doc_id.is_unique
    words = {r.doc_id: len(brute.BLANK.findall(r.text or "")) for r in docs.collect()}
    assert (out.tokens == out.doc_id.map(words)).all()
    assert math.isclose(out.groupby("source").weight.first().sum(), 1.0)
    for _, g in out.groupby("source"):
        got, quota = (g.tokens * g.copies).sum(), g.quota.iloc[0]
        assert quota <= got < quota + g.tokens.max() and g.copies.max() - g.copies.min() <= 1
    again = mixing.realised(docs, entropy=0.97, repeats=2.0, block_tokens=block)
    assert again.columns == docs.columns and again.count() == out.copies.sum()


def test_mixing_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c")]
    out = mixing.mix_sources(brute.frame(spark, rows)).collect()
    assert len(out) == 5
    assert mixing.mix_sources(brute.frame(spark, [])).count() == 0
    assert mixing.mix_sources(brute.frame(spark, [(1, None)])).first().copies == 0


def test_audit_locates_damage(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    left, right = (fixity.warc_records(p) for p in (pages, fixity.damaged(pages, 97)))
    a, b = ({r.page_id: hashlib.sha256(bytes(r.record)).hexdigest() for r in x.collect()} for x in (left, right))
    for span, fan in ((1, 2), (4, 3), (32, 64)):
        out = fixity.audit(left, right, span, fan).collect()
        got = {r.page_id: r.status for r in out}
        want = {k: "ok" if a.get(k) == b.get(k) else "missing" if k not in b else "extra" if k not in a else "altered" for k in {*a, *b}}
        assert got == want and {r.path is None for r in out if r.status == "ok"} == {True}
        assert all(r.path.split("/")[-1] == str(r.page_id // span) for r in out if r.status != "ok")


def test_audit_edges(spark):
    schema = "page_id long, url string, html string, leaf string"
    page = lambda rows: fixity.warc_records(spark.createDataFrame(rows, schema))
    some = page([(1, None, None, "x"), (1, "u", "h", "x"), (-5, "u", "", "y"), (None, "u", "h", "z"), (70, "u", "é" * 5000, "z")])
    assert {r.status for r in fixity.audit(some, some).collect()} == {"ok"}
    assert fixity.audit(page([]), page([])).count() == 0
    assert {(r.page_id, r.status) for r in fixity.audit(some, page([])).collect()} == {(1, "missing"), (-5, "missing"), (70, "missing")}
    assert {(r.page_id, r.status) for r in fixity.audit(page([(1, "u", "h", "x")]), some).collect()} == {(1, "altered"), (-5, "extra"), (70, "extra")}


def test_audit_offsets(spark):
    """first_difference is where a page's records begin in its leaf's range of the left copy; pages without an id are audited."""
    page = lambda rows: fixity.warc_records(spark.createDataFrame(rows, "page_id long, url string, html string"), unnamed=True)
    rows = [(i, "u", "h" * (i % 7)) for i in range(70)] + [(5, "v", "again"), (None, "u", "x"), (None, "u", "y")]
    left = page([r for r in rows if r[0] != 40])
    right = page([(k, u, h + "?" if k in (6, 33) else h) for k, u, h in rows if k not in (0, 69) and (k, h) != (None, "y")])
    records = sorted((r.page_id, bytes(r.record)) for r in left.collect())
    out = {r.page_id: r for r in fixity.audit(left, right).collect()}
    want = {k: sum(len(x) for i, x in records if i < k and i // 32 == k // 32) for k in (0, 6, 33, 40, 69, fixity.NO_PAGE)}
    assert {k: r.first_difference for k, r in out.items() if r.status != "ok"} == want
    assert {k: out[k].status for k in want} == {0: "missing", 6: "altered", 33: "altered", 40: "extra", 69: "missing", fixity.NO_PAGE: "altered"}
    assert all(r.first_difference is None for r in out.values() if r.status == "ok") and out[fixity.NO_PAGE].n_left == 2
    assert out[6].path == "0/0" and out[69].path == "0/2"
