"""Exact removal of repeated passages of bytes: depth-limited radix sort of suffixes.

The sort never goes deeper than the threshold, so its groups of equal suffixes
are exactly the repeated windows. Digits are not single bytes but lengthening
stretches around anchors (see ``windows``), which leaves the groups the same
and spares most suffixes the later passes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from marlpit.llm import windows as W
from marlpit.llm.shared import drop, keyed, map_batches
from marlpit.llm.textkit import cover, slices


def remove_repeats(documents: DataFrame, threshold: int = 200, gram: int = 24) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    Every byte goes that a string of ``threshold`` bytes covers which also
    starts anywhere else, in the same document or another one. Null and empty
    texts, and those below the threshold, keep all; repeated rows are two
    documents, so both lose what they share; an empty table gives no rows.
    ``kept_text`` is binary, as a cut may fall within a character.
    """
    spec = W.Spec(threshold, min(gram, threshold), "byte")
    docs = keyed(documents)
    table = W.block_table(docs, spec)
    live = W.live_blocks(table)
    drop(table)
    runs = W.repeated_in_classes(W.opened(docs, live, spec), spec, earlier=False)
    spans = W.repeated_spans(live, runs, spec, earlier=False)
    both = docs.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")

    def finish(batch):
        ends, lo, hi = W.span_arrays(batch)
        ids = batch.column("doc_id")
        for texts in slices(batch.column("text")):
            bound = ends[texts.first : texts.first + texts.n + 1]
            shift = np.repeat(texts.offsets[:-1], np.diff(bound))
            gone = cover(lo[bound[0] : bound[-1]] + shift, hi[bound[0] : bound[-1]] + shift, len(texts.data))
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            cuts = texts.offsets[:-1][np.diff(texts.offsets) > 0]
            begins[cuts] = gone[cuts]
            total, runs = (np.append(0, np.cumsum(x, dtype=np.int64))[texts.offsets] for x in (gone, begins))
            rest = texts.data[~gone].tobytes()
            at = texts.offsets - total
            kept = [rest[at[i] : at[i + 1]] for i in range(texts.n)]
            yield {
                "doc_id": ids.slice(texts.first, texts.n), "n_bytes": np.diff(texts.offsets), "n_removed": np.diff(total), "n_spans": np.diff(runs),
                "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept], "kept_text": kept,
            }

    return map_batches(both, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary")
