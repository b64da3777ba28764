"""Token counts by section: each document is encoded once, tokens are attributed by their spans.

A document's tokens tile its bytes, and so do its sections, so the interval join of both is a merge of
two sorted lists of bounds (one search a section).  A token over a border is allocated by rule:

* ``start``: to the section that holds its first byte (the default);
* ``end``: to the section that holds its last byte;
* ``largest``: to the section that holds most of its bytes, the earlier one on ties.

Sections are the text's lines by default, each with its newline, or the fields of a rendered row.  Counts
over a document's sections always add up to the document's tokens.  Null and empty texts have no tokens
and no sections; empty fields are sections without tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Codec, shared_codec
from .shared import column_name, extended, map_batches

RULES = ("start", "end", "largest")


def attribute(token_widths: np.ndarray, bounds: np.ndarray, rule: str = "start") -> tuple[np.ndarray, int]:
    """Tokens of each section and how many tokens cross a border.

    ``token_widths`` in bytes, ``bounds`` the sections' starts and the end, ascending, in bytes."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    end = np.cumsum(token_widths)
    start = end - token_widths
    # The last section that starts at or before a byte holds it, as empty sections hold none.
    first = np.searchsorted(bounds, start, side="right") - 1
    last = np.searchsorted(bounds, end - 1, side="right") - 1
    owner = {"start": first, "end": last}.get(rule)
    if owner is None:
        owner = first.copy()
        for i in np.flatnonzero(first != last).tolist():
            cuts = np.clip(bounds[first[i]:last[i] + 2], start[i], end[i])
            owner[i] = first[i] + int(np.argmax(np.diff(cuts)))
    return np.bincount(owner, minlength=len(bounds) - 1), int(np.count_nonzero(first != last))


def line_bounds(data: bytes) -> np.ndarray:
    """Starts of the lines, and the end; a line keeps its newline."""
    feeds = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 0x0A) + 1
    return np.concatenate([[0], feeds[feeds < len(data)], [len(data)]]) if data else np.zeros(1, np.int64)


def count_one(codec: Codec, text: str | None, lengths: list[int] | None, rule: str) -> tuple[int, list[int], int]:
    """Tokens, tokens by section, crossing tokens; ``lengths`` are the sections' bytes, lines if None."""
    if not text:
        return 0, [0] * len(lengths or []), 0
    widths = codec.widths[codec.encode(text)]
    bounds = line_bounds(text.encode("utf-8")) if lengths is None else np.concatenate([[0], np.cumsum(lengths)])
    sections, crossing = attribute(widths, bounds, rule)
    return len(widths), sections.tolist(), crossing


def count_tokens(docs: DataFrame, fields: list[str] | None = None, separator: str = "\n", rule: str = "start", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with n_tokens, n_sections, section_tokens and n_crossing.

    Sections are the lines of ``text``, or the columns in ``fields``, rendered in order with
    ``separator`` after each but the last; a separator belongs to the field before it."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    get = shared_codec(docs.sparkSession, path, pattern)
    text, lengths = column_name(docs, "rendered"), column_name(docs, "lengths")
    if fields is None:
        staged = docs.withColumn(text, F.col("text").cast("string")).withColumn(lengths, F.lit(None).cast("array<int>"))
    else:
        parts: list[Column] = [F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit(separator if i + 1 < len(fields) else "")) for i, f in enumerate(fields)]
        staged = docs.withColumn(text, F.concat(*parts)).withColumn(lengths, F.array(*(F.octet_length(p) for p in parts)))
    names = [column_name(docs, c) for c in ("n_tokens", "n_sections", "section_tokens", "n_crossing")]
    schema = extended(docs, (names[0], "long"), (names[1], "long"), (names[2], "array<long>"), (names[3], "long"))

    def run(batches):
        with get() as codec:
            for batch in batches:
                texts, sizes = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
                found = [count_one(codec, t, s, rule) for t, s in zip(texts, sizes)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-2], pa.array([f[0] for f in found], pa.int64()), pa.array([len(f[1]) for f in found], pa.int64()),
                     pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.int64())],
                    names=[f.name for f in schema])

    return map_batches(staged, run, schema)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
