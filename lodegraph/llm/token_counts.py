"""Operator 6: tokens per section of a document, from one encoding of the whole text.

Every document is encoded once as a whole. Each token covers a span of code points; the spans are joined with the
document's sections, which are disjoint intervals in ascending order, by binary search on their ends. A token that
crosses a boundary goes to one section by an explicit rule:

    start     the first section it touches
    end       the last one
    largest   the one that holds most of its code points, the first of equals

Sections come as a column of arrays (name, begin, end in code points), so no text moves. Without one, the sections are
the lines of the text, each with its line feed, which cover it all. Tokens that touch no section are counted under
section -1 with a null name.

Edge cases: a null or empty text has one row, section -1 with 0 tokens; empty sections have rows with 0 tokens; a null
array counts as no sections; repeated rows each get their rows; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenize import encoder, load_spec

RULES = ("start", "end", "largest")
COUNTS = "doc_id long, section int, name string, begin long, end long, n_tokens long, n_crossing long, doc_tokens long"


def allocate(a: np.ndarray, b: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For tokens a..b: the section each goes to (-1: none), and whether it touches more than one."""
    first = np.searchsorted(end, a, "right")
    last = np.searchsorted(begin, b, "left") - 1
    inside = first <= last
    crossing = inside & (first < last)
    to = np.where(inside, first if rule != "end" else last, -1)
    if rule == "largest":
        for i in np.flatnonzero(crossing):
            k = np.arange(first[i], last[i] + 1)
            to[i] = k[np.argmax(np.minimum(end[k], b[i]) - np.maximum(begin[k], a[i]))]
    return to, crossing


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
    ends[-1] -= 1
    begins = np.concatenate([[0], ends[:-1]])
    keep = ends > begins
    return begins[keep], ends[keep]


def token_counts(docs: DataFrame, *, tokenizer_path: str, sections: str | None = None, rule: str = "start") -> DataFrame:
    """COUNTS: a row per section of each row of docs (doc_id, text, and the column `sections` if given)."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    sent = docs.sparkSession.sparkContext.broadcast(load_spec(tokenizer_path))
    names = [c.split()[0] for c in COUNTS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for i, (doc_id, value) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                text = value.as_py() or ""
                _, a, b = enc.spans(text)
                if sections is None:
                    begin, end = line_sections(text)
                    titles = [None] * len(begin)
                else:
                    own = batch.column(2)[i].as_py() or []
                    begin, end = np.array([s["begin"] for s in own], np.int64), np.array([s["end"] for s in own], np.int64)
                    titles = [s["name"] for s in own]
                to, crossing = allocate(a, b, begin, end, rule)
                n = np.bincount(to + 1, minlength=len(begin) + 1)
                x = np.bincount(to[crossing] + 1, minlength=len(begin) + 1)
                at = range(1 if n[0] == 0 and len(begin) else 0, len(begin) + 1)
                out[0] += [doc_id] * len(at)
                out[1] += [k - 1 for k in at]
                out[2] += [titles[k - 1] if k else None for k in at]
                out[3] += [int(begin[k - 1]) if k else None for k in at]
                out[4] += [int(end[k - 1]) if k else None for k in at]
                out[5] += n[at.start :].tolist()
                out[6] += x[at.start :].tolist()
                out[7] += [len(a)] * len(at)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.col(sections).alias("_sections")] if sections else []))
    return source.mapInArrow(run, COUNTS)
