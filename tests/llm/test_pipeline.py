"""Each pipeline stage on hard cases and small tables, against plain versions where there are any."""

from collections import Counter

import corpus_pipeline
import pytest

from tests.conftest import SF
from tests.llm import brute

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return brute.frame(spark, brute.hard_cases())


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_jaccard_stage(spark, docs):
    out = STAGES["jaccard_join"](spark, docs, SF)
    assert out.columns == docs.columns
    rows, kept = brute.hard_cases(), pairs(out)
    sets = [brute.shingles(t) for _, t in rows]
    # one of each group: rebuild the groups, with rows named by their number
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]
    group = {i: c for (i, _, c) in brute.op1(numbered)}
    want = Counter()
    for g in set(group.values()):
        members = [i for i in group if group[i] == g and sets[i]]
        if members:
            least = min(brute_key(rows[i][0]) for i in members)
            texts = {rows[i] for i in members if brute_key(rows[i][0]) == least}
            found = [x for x in texts if kept[x]]
            assert len(found) == 1 and kept[found[0]] == 1
            want[found[0]] += 1
    for i, s in enumerate(sets):
        if not s:
            want[rows[i]] += 1
    assert kept == want


def brute_key(doc_id):
    return (1 << 63) - 1 if doc_id is None else doc_id


def test_decontamination_stage(spark, docs):
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {(d, n) for d, n, h, *_ in brute.op8(brute.hard_cases(), bench) if h}
    out = STAGES["decontamination"](spark, docs, SF)
    assert out.columns == docs.columns and out.count() == len(brute.hard_cases()) - len(hit)


def test_quality_and_mixing_stages(spark, docs):
    good = STAGES["quality_classifier"](spark, docs, SF)
    assert good.columns == docs.columns and not pairs(good) - pairs(docs)
    mixed = STAGES["source_mixing"](spark, docs, SF)
    assert mixed.columns == docs.columns and set(pairs(mixed)) <= set(pairs(docs))


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).toPandas().sort_values("start")
    assert list(out.columns) == ["doc_id", "start", "n_tokens", "ids_crc32"] and 0 < len(out)
    assert (out.start.iloc[1:].values == (out.start + out.n_tokens).iloc[:-1].values).all() and out.start.iloc[0] == 0
    assert not out.doc_id.is_monotonic_increasing  # the files keep the mixed order


def test_mixed_order_is_kept(spark, tmp_path):
    """Token files follow the order of the mixing stage, in which any stretch holds the sources by their weights."""
    rows = [(i, f"w{i} " * (1 + i % 5), "en", "big" if i % 4 else "small", 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    STAGES["source_mixing"](spark, docs, SF).write.parquet(f"{tmp_path}/mixed")
    parts = sorted(p for p in (tmp_path / "mixed").iterdir() if p.name.startswith("part-"))
    order = [r.doc_id for p in parts for r in spark.read.parquet(str(p)).collect()]
    out = STAGES["token_files"](spark, spark.read.parquet(f"{tmp_path}/mixed"), SF).toPandas().sort_values("start")
    assert out.doc_id.tolist() == order and order != sorted(order)
    share = [sum(i % 4 == 0 for i in order[a : a + 500]) / 500 for a in range(0, len(order) - 500, 500)]
    whole = sum(i % 4 == 0 for i in order) / len(order)
    assert all(abs(s - whole) < 0.08 for s in share)


def test_clashing_names(spark):
    """Columns named as the stages' own are kept as they are."""
    names = ["row", "src", "tokens", "h", "b", "k1", "k2", "words", "pass", "place", "part", "copies", "__src", "__k1"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(i, f"some words {i} of a text", "en", "s", 1, *(f"{n}{i}" for n in names)) for i in range(6)], schema)
    for stage in ("quality_classifier", "jaccard_join", "decontamination", "source_mixing"):
        out = STAGES[stage](spark, docs, SF)
        assert out.columns == docs.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)


def test_empty(spark):
    docs = brute.frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
