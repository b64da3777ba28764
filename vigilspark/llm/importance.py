"""Importance resampling towards a target distribution, on hashed features.

Features are a text's words and pairs of neighbouring words.  A feature's bucket is the CRC-32 of its bytes modulo
``buckets``.  CRC-32 is linear but for its length: each byte adds a value that depends on the byte and on
its distance from the end, so the sums of all features of a block of texts are table look-ups and one
``bitwise_xor.reduceat`` over their spans, times a constant for the length.  Spans longer than the table fold
block by block: a block's sum is moved over the bytes behind it by powers of the zero-byte step.

A first pass counts the buckets of corpus and target (a row a bucket and task, then one a bucket: ``buckets``
rows are all that reaches the driver), a second weighs the documents.  Scores add Gumbel noise from a hash of
the doc_id, so the highest scores are a draw without replacement.  Ranks come from ranges: scored rows, without
their texts, are range-partitioned by score, doc_id and a written row number, and numbered by place in their range.

Null, empty and word-less texts have no features, weight 0 and no rank.  A null doc_id is hashed as an empty string
and ranks first among its ties.  Rows equal in doc_id and text have equal scores and ranks of their own.  An empty
table gives an empty one, an empty target gives every bucket its share of 1 / ``buckets``.  Extra columns are carried;
names that the input has already get an underscore.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, blocks
from .shared import column_name, extended, map_batches, materialise, partitions

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: Bytes from a span's end that the position table covers, and lengths that have a constant.
DEPTH = 64
LENGTHS = 4096
_POLYNOMIAL, _ONES = 0xEDB88320, np.uint32(0xFFFFFFFF)
_SPACE = 0x20


@functools.lru_cache(maxsize=1)
def _zero_steps() -> list[np.ndarray]:
    """For 2**k zero bytes: what each of a state's four bytes becomes, as tables [4, 256]."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & np.uint32(1), state >> np.uint32(1) ^ np.uint32(_POLYNOMIAL), state >> np.uint32(1))
    byte = np.arange(256, dtype=np.uint32)
    steps = [np.stack([state, *(byte << np.uint32(8 * k - 8) for k in (1, 2, 3))])]
    for _ in range(40):
        steps.append(_step(steps[-1], steps[-1]))
    return steps


def _step(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    part = lambda k: table[k][state >> np.uint32(8 * k) & np.uint32(255)]
    return part(0) ^ part(1) ^ part(2) ^ part(3)


def _moved(state: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """States after so many zero bytes."""
    state = state.copy()
    for k, table in enumerate(_zero_steps()):
        at = np.flatnonzero(zeros >> k & 1)
        if len(at):
            state[at] = _step(table, state[at])
        elif not (zeros >> k).any():
            break
    return state


@functools.lru_cache(maxsize=1)
def _position_table() -> np.ndarray:
    """What a byte adds at each distance from the end, flat: distance * 256 + byte."""
    steps = _zero_steps()[0]
    rows = [steps[0]]
    for _ in range(DEPTH - 1):
        rows.append(_step(steps, rows[-1]))
    return np.concatenate(rows)


@functools.lru_cache(maxsize=1)
def _length_table() -> np.ndarray:
    return _length_sums(np.arange(LENGTHS))


def _length_sums(length: np.ndarray) -> np.ndarray:
    return _moved(np.full(len(length), _ONES), length) ^ _ONES


def _constants(length: np.ndarray) -> np.ndarray:
    """The CRC of so many zero bytes."""
    out = _length_table()[np.minimum(length, LENGTHS - 1)]
    far = np.flatnonzero(length >= LENGTHS)
    if len(far):
        out[far] = _length_sums(length[far])
    return out


def _ramp(length: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n."""
    return np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)


def span_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the spans of ``data``, none empty, whatever their lengths."""
    length = end - start
    pieces = -(-length // DEPTH)
    back = _ramp(pieces)  # pieces count from a span's end
    stop = np.repeat(end, pieces) - DEPTH * back
    size = np.minimum(stop - np.repeat(start, pieces), DEPTH)
    far = np.repeat(size, size) - 1 - _ramp(size)
    at = np.repeat(stop, size) - 1 - far
    sums = np.bitwise_xor.reduceat(_position_table()[far * 256 + data[at]], np.cumsum(size) - size)
    sums = _moved(sums, DEPTH * back)
    return np.bitwise_xor.reduceat(sums, np.cumsum(pieces) - pieces) ^ _constants(length)


@functools.lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Bytes of words with A-Z as a-z; 0 is no byte of a word."""
    out = np.zeros(256, dtype=np.uint8)
    for lo, hi in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
        out[lo:hi] = np.arange(lo, hi)
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    return out


def features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, CRC-32 of each feature): words first, then pairs."""
    folded = _folded()[block.data]
    word = folded > 0
    edge = np.zeros(len(word) + 1, dtype=bool)  # a word starts or ends before this byte
    edge[1:-1] = word[1:] != word[:-1]
    if len(word):
        edge[0], edge[-1] = word[0], word[-1]
    inner = block.off[1:-1]
    inner = inner[(inner > 0) & (inner < len(word))]
    split = np.unique(inner[word[inner] & word[inner - 1]])  # a text's last word meets the next one's first
    edge[split] = False
    both = np.flatnonzero(edge)
    start, end = np.sort(np.concatenate([both[::2], split])), np.sort(np.concatenate([both[1::2], split]))
    doc = np.searchsorted(block.off, start, side="right") - 1
    n_words = np.bincount(doc, minlength=block.n)
    if not len(start):
        return n_words, doc, np.zeros(0, np.uint32)
    # The words one after another, with a space between.
    length = end - start
    data = np.full(length.sum() + len(length) - 1, _SPACE, dtype=np.uint8)
    place = np.cumsum(length + 1) - length - 1
    step = _ramp(length)
    data[np.repeat(place, length) + step] = folded[word]
    far = np.repeat(length, length) - 1 - step
    table = _position_table()
    where = far * 256 + folded[word]
    first = np.cumsum(length) - length
    alone = np.bitwise_xor.reduceat(table[np.minimum(where, len(table) - 1)], first)
    words = alone ^ _constants(length)
    long = np.flatnonzero(length > DEPTH)
    if len(long):
        words[long] = span_crcs(data, place[long], place[long] + length[long])
    # A pair is its first word, farther from the end, a space, and its second word as it was.
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    behind = np.zeros(len(length), dtype=np.int64)
    behind[pair] = length[pair + 1] + 1
    moved = np.bitwise_xor.reduceat(table[np.minimum(where + np.repeat(behind * 256, length), len(table) - 1)], first)
    space = table[np.minimum(length[pair + 1] * 256 + _SPACE, len(table) - 1)]
    total = length[pair] + 1 + length[pair + 1]
    pairs = moved[pair] ^ space ^ alone[pair + 1] ^ _constants(total)
    long = np.flatnonzero(total > DEPTH)
    if len(long):
        pairs[long] = span_crcs(data, place[pair[long]], place[pair[long]] + total[long])
    return n_words, np.concatenate([doc, doc[pair]]), np.concatenate([words, pairs])


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for _, block in blocks(batches):
            total += np.bincount(features(block)[2] % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    counted = map_batches(docs.select(F.col("text").cast("string").alias("text")), count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in counted.collect():  # ``buckets`` rows at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of how much likelier each bucket is in the target, by counts plus one, floored."""
    n, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    ratio = lambda s, t: float((t + 1) * (all_source + n)) / float((s + 1) * (all_target + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``docs`` (text, ...) with n_words, n_features and weight, the floored mean of its features' gains."""
    names = [column_name(docs, c) for c in ("n_words", "n_features", "weight")]
    schema = extended(docs, *((c, "long") for c in names))
    buckets = np.uint32(len(gain))

    def score(batches):
        for rows, block in blocks(batches):
            n_words, doc, crc = features(block)
            n = np.bincount(doc, minlength=block.n)
            total = np.bincount(doc, weights=gain[crc % buckets], minlength=block.n).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            columns = [*rows.columns, *(pa.array(c, pa.int64()) for c in (n_words, n, weight))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return map_batches(docs, score, schema)


def noise(doc_id: Column, seed: int) -> Column:
    """A thousandfold Gumbel draw, floored, from the first 32 bits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))


def ranked(rows: DataFrame, order: list[Column], most: int, name: str) -> DataFrame:
    """``rows`` with ``name``: 1, 2, 3 ... in ``order``, null after ``most``.  ``order`` must tell rows apart."""
    ranges = materialise(rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
                         .withColumn("place", F.monotonically_increasing_id()), "ranges")
    # The upper bits name the range, the lower 33 the row in it: a row a range is broadcast.
    part = F.shiftright("place", 33)
    sizes = ranges.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.selectExpr("part", "coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS skip")
    rank = F.col("skip") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return ranges.withColumn("part", part).join(F.broadcast(before), "part").withColumn(
        name, F.when(rank <= most, rank)).drop("part", "skip", "place")


def resample(docs: DataFrame, target: DataFrame, carry: list[str] | None = None, percent: int = PERCENT, min_words: int = MIN_WORDS,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all but the text) with n_words, n_features, weight, score and rank.

    ``percent`` of the documents with ``min_words`` words are drawn; the others have no rank."""
    carry = [c for c in docs.columns if c != "text"] if carry is None else carry
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    slim = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").alias("id"), F.struct(*(F.col(c) for c in carry)).alias("carried"))
    scored = materialise(weigh(slim, gain).drop("text").withColumn("score", F.col("weight") + noise(F.col("id"), seed))
                         .withColumn("row", F.monotonically_increasing_id()), "scored")
    fit = scored.where(F.col("n_words") >= min_words)
    drawn = ranked(fit, [F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("row")], percent * fit.count() // 100, "rank")
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    added = ("n_words", "n_features", "weight", "score", "rank")
    return drawn.unionByName(rest).select(*(F.col("carried")[c].alias(c) for c in carry), *(F.col(c).alias(column_name(docs, c)) for c in added))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
