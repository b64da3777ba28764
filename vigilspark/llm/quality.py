"""Quality rules: base counts, and repetition by a suffix array over words.

For each text the suffix array of its words is built by prefix doubling (all texts of a block at
once, a text's suffixes only among themselves).  Longest-common-prefix lengths between neighbours give
for every word the longest repeat that starts there; these are the longest-common-prefix intervals'
maximal repeated substrings.  The union of their spans and the longest one decide.

Null, empty and word-less texts have no words and fail the base rules.  Every row is judged by itself,
so repeated rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import U64, Block, blocks, ngram_hashes
from .shared import column_name, extended, map_batches

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Words that a repeated substring must have to count.
MIN_REPEAT = 10
#: Largest part of the words that repeated substrings may cover, in percent.
MAX_COVERED_PERCENT = 30
#: Longest repeated substring, in percent of the words.
MAX_LONGEST_PERCENT = 20
SYMBOLS = b"#*$%&|<>"


def repeat_lengths(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word: length of the longest string of words from here that occurs elsewhere in its text."""
    n = len(words)
    longest = np.zeros(n, dtype=np.int64)
    if not n:
        return longest
    end = np.searchsorted(doc, doc, side="right")
    # ranks[k]: equal for two positions of a text exactly if 2**k words from there are equal and exist.
    by = np.lexsort((words, doc))
    step = np.concatenate([[True], (words[by][1:] != words[by][:-1]) | (doc[by][1:] != doc[by][:-1])])
    rank = np.empty(n, dtype=np.int64)
    rank[by] = np.cumsum(step)
    ranks, width = [rank], 1
    alone = -np.arange(1, n + 1)
    while True:
        shared = np.bincount(rank[rank > 0], minlength=1)
        live = np.flatnonzero((rank > 0) & (shared[np.maximum(rank, 0)] > 1) & (np.arange(n) + 2 * width <= end))
        if not len(live):
            break
        first, second = rank[live], rank[live + width]
        live, first, second = (x[second > 0] for x in (live, first, second))
        by = np.lexsort((second, first))
        step = np.concatenate([[True], (first[by][1:] != first[by][:-1]) | (second[by][1:] != second[by][:-1])])
        rank = alone.copy()
        rank[live[by]] = np.cumsum(step)
        ranks.append(rank)
        width *= 2
    # Suffix order: by the ranks from the widest down would sort all; neighbours only need the order
    # within groups of equal first words, which the refinement below restores level by level.
    order = _suffix_order(words, doc, end, ranks)
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, dtype=np.int64)
    same = doc[left] == doc[right]
    for k in range(len(ranks) - 1, -1, -1):
        i, j = np.minimum(left + common, n - 1), np.minimum(right + common, n - 1)
        inside = same & (left + common < end[left]) & (right + common < end[right])
        equal = inside & (ranks[k][i] == ranks[k][j]) & (ranks[k][i] > 0)
        common = common + np.where(equal, 1 << k, 0)
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    return longest


def _suffix_order(words, doc, end, ranks) -> np.ndarray:
    """Positions in suffix order, text by text."""
    n = len(words)
    rank = ranks[0].copy()  # dense, ordered by text, then word
    width = 1
    order = np.argsort(rank, kind="stable")
    while True:
        group = rank[order]
        tied = np.concatenate([[False], group[1:] == group[:-1]])
        tied[:-1] |= tied[1:]
        at = order[tied]
        if not len(at):
            return order
        ahead = np.where(at + width < end[at], rank[np.minimum(at + width, n - 1)], 0)
        by = np.lexsort((ahead, rank[at]))
        slots = np.flatnonzero(tied)
        order[slots] = at[by]
        first, second = rank[at][by], ahead[by]
        fresh = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        # New rank: the group's first slot, so ranks stay comparable with untouched ones.
        rank = _slot_ranks(order, rank, slots, fresh)
        width *= 2


def _slot_ranks(order, rank, slots, fresh):
    n = len(order)
    group = rank[order]
    head = np.concatenate([[True], group[1:] != group[:-1]])
    head[slots[fresh]] = True
    at = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1
    new = np.empty(n, dtype=np.int64)
    new[order] = at
    return new


def _covered(length: np.ndarray) -> np.ndarray:
    """Which words lie in one of the spans [i, i + length[i])."""
    n = len(length)
    at = np.flatnonzero(length)
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + length[at], -1)
    return np.cumsum(delta[:-1]) > 0


def measure(block: Block, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """The counts of every text in the block."""
    start, end, doc = block.words()
    words = block.span_hash(start, end)
    per = lambda mask: np.bincount(doc[mask], minlength=block.n)
    n_words = np.bincount(doc, minlength=block.n)
    first = np.concatenate([[0], np.cumsum(n_words)])
    byte_doc = block.doc_of(block.lengths)
    letters = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    # Three-word windows found twice or more.
    at, h = ngram_hashes(words, first, doc, 3)
    key = (doc[at].astype(U64) << U64(50)) | (h >> U64(14))
    _, same, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[count[same] > 1]
    spread = np.zeros(len(words), dtype=np.int64)
    spread[twice] = 3
    longest = repeat_lengths(words, doc)
    long_ones = np.where(longest >= min_repeat, longest, 0)
    most = np.zeros(block.n, dtype=np.int64)
    np.maximum.at(most, doc, long_ones)
    return {
        "n_words": n_words,
        "word_chars": np.bincount(doc, weights=letters[end] - letters[start], minlength=block.n).astype(np.int64),
        "n_symbols": np.bincount(byte_doc[symbol[block.data]], minlength=block.n),
        "n_dup_lines": _repeated_lines(block, start),
        "n_repeat_words": per(_covered(spread)),
        "n_covered_words": per(_covered(long_ones)),
        "longest_repeat": most,
    }


def _repeated_lines(block: Block, word_start: np.ndarray) -> np.ndarray:
    feed = np.flatnonzero(block.data == 0x0A)
    full = block.off[:-1][block.lengths > 0]
    start = np.union1d(full, feed[feed + 1 < len(block.data)] + 1)
    doc = np.searchsorted(block.off, start, side="right") - 1
    next_feed = np.append(feed, len(block.data))[np.searchsorted(feed, start)]
    end = np.minimum(next_feed, block.off[doc + 1])
    has_word = np.searchsorted(word_start, end) > np.searchsorted(word_start, start)
    start, end, doc = start[has_word], end[has_word], doc[has_word]
    key = (doc.astype(U64) << U64(50)) | (block.span_hash(start, end) >> U64(14))
    return np.bincount(doc, minlength=block.n) - np.bincount((np.unique(key) >> U64(50)).astype(np.int64), minlength=block.n)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")


def judge(docs: DataFrame, min_repeat: int = MIN_REPEAT, covered_percent: int = MAX_COVERED_PERCENT, longest_percent: int = MAX_LONGEST_PERCENT) -> DataFrame:
    """``docs`` with the counts, base_failed and kept; columns that ``docs`` has already are kept too,
    the new ones then have an underscore appended."""
    names = {c: column_name(docs, c) for c in (*COUNTS, "base_failed", "kept")}
    schema = extended(docs, *((names[c], "long") for c in COUNTS))

    def run(batches):
        for rows, block in blocks(batches):
            found = measure(block, min_repeat)
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], names=[f.name for f in schema])

    col = lambda c: F.col(names[c])
    failed = (col("n_words") < MIN_WORDS) | (100 * col("n_repeat_words") > MAX_REPEAT_PERCENT * col("n_words"))
    clean = (100 * col("n_covered_words") <= covered_percent * col("n_words")) & (100 * col("longest_repeat") <= longest_percent * col("n_words"))
    return map_batches(docs, run, schema).withColumn(names["base_failed"], failed).withColumn(names["kept"], ~failed & clean)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
