"""Token counts by section, from one encoding of each whole document.

Each document is encoded once, with character offsets. Sections are character spans of it. An
interval join by binary search attributes tokens to sections. A token that crosses a boundary is
allocated by an explicit rule: ``start`` (the section of its first character), ``end`` (of its last)
or ``most`` (where it has most characters, the earlier section if equal).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encode_whole

RULES = ("start", "end", "most")
COUNTS = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long, doc_tokens long"


def _attribute(begin: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether the token crosses a boundary. ``bounds``: sorted section starts."""
    left = np.searchsorted(bounds, begin, "right") - 1
    last = np.maximum(end - 1, begin)
    right = np.searchsorted(bounds, last, "right") - 1
    crossing = left != right
    if rule == "start":
        return left, crossing
    if rule == "end":
        return right, crossing
    out = left.copy()
    for i in np.flatnonzero(crossing):
        inner = np.arange(left[i], right[i] + 1)
        stops = np.append(bounds[inner[1:]], end[i])
        out[i] = inner[np.argmax(stops - np.maximum(bounds[inner], begin[i]))]
    return out, crossing


def _count(batches, path: str, rule: str):
    for batch in batches:
        bounds = batch.column("bounds")
        lengths = batch.column("n_chars")
        for first, ids, at, begin, end in encode_whole(batch.column("text"), path):
            out = []
            n = len(at) - 1
            marks = bounds.slice(first, n)
            flat, edge = marks.flatten().to_numpy(), np.concatenate([[0], np.cumsum(marks.value_lengths().to_numpy())])
            for i, (doc, size) in enumerate(zip(batch.column("doc_id").slice(first, n).to_pylist(), lengths.slice(first, n).to_pylist(), strict=True)):
                own = flat[edge[i] : edge[i + 1]]
                section, crossing = _attribute(begin[at[i] : at[i + 1]], end[at[i] : at[i + 1]], own, rule)
                k = len(own)
                out.append((np.full(k, doc if doc is not None else -1), np.full(k, doc is None), np.arange(k), own, np.append(own[1:], size), np.bincount(section, minlength=k), np.bincount(section[crossing], minlength=k), np.full(k, at[i + 1] - at[i])))
            doc, none, *rest = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=none), *(pa.array(x.astype(np.int32 if j == 0 else np.int64)) for j, x in enumerate(rest))], names=[x.split()[0] for x in COUNTS.split(", ")])


def count_tokens(docs: DataFrame, tokenizer: str, bounds: F.Column | None = None, rule: str = "start") -> DataFrame:
    """``doc_id, section, start, end, n_tokens, n_crossing, doc_tokens`` of every section of every row.

    ``bounds`` gives each text's section starts: ascending code-point offsets, the first of them 0.
    By default every line, with its line break, is a section. ``n_crossing`` counts the section's
    tokens that cross a boundary. The sections' tokens add up to the document's.

    Null and empty texts have one empty section without tokens. Rows that repeat stay repeated, null
    ids stay null, other columns are ignored, and an empty table gives an empty table. An unknown
    rule raises ValueError.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    text = F.coalesce("text", F.lit(""))
    bounds = F.lit(None).cast("array<long>") if bounds is None else bounds
    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.length(text).cast("long").alias("n_chars"), bounds.alias("bounds"))
    return rows_.mapInArrow(lambda it: _count(map(_lined, it), tokenizer, rule), COUNTS)


def _lined(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Line starts where no bounds are given."""
    bounds = batch.column("bounds")
    if not bounds.null_count:
        return batch
    lists = []
    for text, own in zip(batch.column("text").to_pylist(), bounds.to_pylist(), strict=True):
        if own is None:
            own, at = [0], text.find("\n")
            while at >= 0:
                own.append(at + 1)
                at = text.find("\n", at + 1)
        lists.append(own)
    return batch.set_column(batch.schema.get_field_index("bounds"), "bounds", pa.array(lists, pa.list_(pa.int64())))
