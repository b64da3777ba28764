"""Document fingerprints: digests of improbable features.

A feature is a window of ``WINDOW`` bytes.  Its entropy, quantised, has a rarity: how seldom that
entropy occurs over the windows of all documents (one pass over the whole corpus, or a given table).
A feature is selected if it is the rarest, leftmost on ties, of at least ``POPULAR`` of the ``WINDOW``
neighbourhoods of ``WINDOW`` features that hold it, so selection depends on nearby bytes alone and an
edit changes only features near it.  Windows of one repeated byte are never selected.  Each text's
distinct selected features are hashed in order of place into a chain of Bloom filters, ``PER_FILTER``
features each.

Likeness: each filter of the shorter chain takes its best partner in the other; the bits in common are
normalised between what chance gives (0) and the smaller filter's bits (1), and the filters' scores are
averaged by their features.  Equal fingerprints are 1 alike; texts without features are 1 alike if their
fingerprints are equal and 0 otherwise.

Texts under four windows have too few to choose from: all their windows of ``SHORT_WINDOW`` bytes are
features, or all their bytes if there are fewer.  Null and empty texts have none.  Rows are ordered by doc_id
descending, nulls last, equal ids by the SHA-256 of their text; the next of the last row is the first, of an
only row itself.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import U64, Block, blocks, mix
from .shared import map_batches, materialise, partitions

WINDOW = 32
SHORT_WINDOW = 8
POPULAR = 8
PER_FILTER = 128
FILTER_BITS = 2048
HASHES = 5
LEVELS = 1000  # entropy is quantised to this many steps
_SCALE = 1 << 20


def _entropy_steps() -> tuple[np.ndarray, int]:
    c = np.arange(WINDOW + 1, dtype=float)
    h = np.round(np.where(c > 0, c * np.log2(np.maximum(c, 1)), 0) * _SCALE).astype(np.int64)
    return np.diff(h), int(h[WINDOW])


_STEP, _FULL = _entropy_steps()


def window_entropy(data: np.ndarray) -> np.ndarray:
    """Entropy of the window at every position of the buffer, in steps 0..LEVELS."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    # ahead/behind: equal bytes among the WINDOW - 1 next and previous ones.
    ahead, behind = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    # The sum of count * log2(count) over a window changes by the byte that leaves and the one that enters.
    first = np.bincount(data[:WINDOW], minlength=256)
    table = np.concatenate([[0], np.cumsum(_STEP)])
    change = _STEP[behind[WINDOW:]] - _STEP[ahead[:n - 1]]
    total = table[first].sum() + np.concatenate([[0], np.cumsum(change)])
    return (_FULL - total) * LEVELS // _FULL


def _rarest(rank: np.ndarray) -> np.ndarray:
    """How many neighbourhoods of WINDOW features have each position as their rarest one."""
    n = len(rank)
    key = (rank.astype(np.int64) << 32) | np.arange(n)
    width = 1
    low = key
    while width * 2 <= WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < WINDOW:
        low = np.minimum(low[:-(WINDOW - width)], low[WINDOW - width:])
    return low


def selected_features(block: Block, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the selected features of all texts, in order of place."""
    data = block.data
    prefix = block.prefix_hash()
    tiny = np.flatnonzero((block.lengths < SHORT_WINDOW) & (block.lengths > 0))
    hashes, owners = [block.span_hash(block.off[tiny], block.off[tiny + 1], prefix=prefix)], [tiny]
    brief = block.lengths < 4 * WINDOW
    owner = block.doc_of(block.lengths)
    at = np.flatnonzero(brief[owner])
    at = at[at + SHORT_WINDOW <= block.off[owner[at] + 1]]
    hashes.append(block.span_hash(at, at + SHORT_WINDOW, prefix=prefix))
    owners.append(owner[at])
    entropy = window_entropy(data)
    if len(entropy):
        at = np.arange(len(entropy))
        doc = np.repeat(np.arange(block.n), np.diff(np.minimum(block.off, len(entropy))))
        inside = (at + WINDOW <= block.off[doc + 1]) & ~brief[doc]
        rank = np.where(inside & (entropy > 0), rarity[entropy], rarity.max() + 1)
        if len(rank) >= WINDOW:
            low = _rarest(rank)
            start = np.arange(len(low))
            whole = block.off[doc[start] + 1] - WINDOW - start >= WINDOW - 1  # neighbourhood inside the text
            popular = np.bincount((low[whole] & 0xFFFFFFFF), minlength=len(rank))
        else:
            popular = np.zeros(len(rank), np.int64)
        chosen = np.flatnonzero((popular >= POPULAR) & inside & (entropy > 0))
        hashes.append(block.span_hash(chosen, chosen + WINDOW, prefix=prefix))
        owners.append(doc[chosen])
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    # Each text's distinct features, first place first.
    order = np.lexsort((np.arange(len(h)), h, owner))
    keep = order[np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])])] if len(h) else order
    keep = keep[np.lexsort((keep, owner[keep]))]
    return h[keep], owner[keep]


class Prints:
    """Bloom chains of a block: ``bits`` (filters x words), ``size`` (features), ``off`` by text."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, off: np.ndarray):
        self.bits, self.size, self.off = bits, size, off

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.bits[self.off[i]:self.off[i + 1]], self.size[self.off[i]:self.off[i + 1]]


def bloom_chains(h: np.ndarray, owner: np.ndarray, n: int) -> Prints:
    counts = np.bincount(owner, minlength=n)
    filters = -(-counts // PER_FILTER)
    off = np.concatenate([[0], np.cumsum(filters)])
    place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    row = off[owner] + place // PER_FILTER
    bits = np.zeros((int(off[-1]), FILTER_BITS), dtype=bool)
    for k in range(HASHES):
        x = mix(h + U64(k * 0x632BE59BD9B4E019 % (1 << 64)))
        bits[row, (x % U64(FILTER_BITS)).astype(np.int64)] = True
    return Prints(np.packbits(bits, axis=1).view(U64), np.bincount(row, minlength=int(off[-1])), off)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1; see the module's docstring."""
    (x, nx), (y, ny) = a, b
    if len(x) == len(y) and np.array_equal(nx, ny) and np.array_equal(x, y):
        return 1.0
    if not len(x) or not len(y):
        return 0.0
    if len(x) > len(y):
        x, nx, y, ny = y, ny, x, nx
    wx, wy = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    scores = np.empty(len(x))
    for i in range(len(x)):
        common = np.bitwise_count(y & x[i]).sum(axis=1, dtype=np.int64)
        most = np.minimum(wy, wx[i])
        chance = wy * wx[i] / FILTER_BITS
        scores[i] = np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max()
    # Features of the longer chain beyond the shorter one have no partner.
    return float((scores * nx).sum() / max(nx.sum(), ny.sum()))


def encode(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """``features per filter:base64 filters``, or an empty string."""
    bits, size = print_
    if not len(bits):
        return ""
    return ",".join(map(str, size.tolist())) + ":" + base64.b64encode(bits.tobytes()).decode()


def entropy_rarity(docs: DataFrame) -> list[int]:
    """Rank of each entropy step by how many windows of all documents have it, rarest first.

    Tasks send one histogram each; what reaches the driver is LEVELS + 1 numbers whatever the corpus."""
    def count(batches):
        seen = np.zeros(LEVELS + 1, dtype=np.int64)
        for _, block in blocks(batches):
            entropy = window_entropy(block.data)
            doc = np.repeat(np.arange(block.n), np.diff(np.minimum(block.off, len(entropy))))
            inside = np.arange(len(entropy)) + WINDOW <= block.off[doc + 1]
            seen += np.bincount(entropy[inside], minlength=LEVELS + 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["step", "windows"])

    found = map_batches(docs.select("text"), count, "step int, windows long").groupBy("step").agg(F.sum("windows").alias("windows"))
    windows = np.zeros(LEVELS + 1, dtype=np.int64)
    for row in found.collect():
        windows[row["step"]] = row["windows"]
    rank = np.empty(LEVELS + 1, dtype=np.int64)
    rank[np.lexsort((np.arange(LEVELS + 1), windows))] = np.arange(LEVELS + 1)
    return rank.tolist()


def _prints(texts: list[bytes], rarity: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])
    for _, block in blocks([batch]):
        chains = bloom_chains(*selected_features(block, rarity), block.n)
        out += [chains.of(i) for i in range(block.n)]
    return out


def with_next(docs: DataFrame) -> tuple[DataFrame, bool]:
    """Rows (doc_id, text, bucket, copy, times) so that a bucket, sorted, ends with the row that follows it; and whether
    some rows stand for several.

    Buckets are ranges of doc_id from approximate quantiles.  A doc_id that several quantiles hit, and a null
    one, is dealt to as many buckets by the hash that orders its rows; its equal rows become one, with their number,
    in each task first.  One row is copied to each bucket, the first one of the next bucket."""
    spark = docs.sparkSession
    parts = 3 * partitions(spark)
    seen = docs.select(F.percentile_approx("doc_id", F.array(*(F.lit((i + 1) / parts) for i in range(parts - 1))), 10_000), F.count_if(F.col("doc_id").isNull())).first()
    cuts, some = seen[0] or [], [c for c, n in Counter(seen[0] or []).items() if n > 1]
    grouped = bool(some) or seen[1] > 1
    if grouped:
        often = F.col("doc_id").isNull() | F.coalesce(F.col("doc_id").isin(some), F.lit(False))
        one = docs.where(often).groupBy("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_d")).agg(F.first("text").alias("text"), F.count("*").alias("times"))
        docs = docs.where(~often).withColumn("times", F.lit(1).cast("long")).unionByName(materialise(one.drop("_d"), "equal"))
    else:
        docs = docs.withColumn("times", F.lit(1).cast("long"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / (1 << 32)
    held = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<bigint>")
    equal = F.size(F.filter(held, lambda c: c == F.col("doc_id")))
    bucket = F.size(F.filter(held, lambda c: c > F.col("doc_id"))) + F.when(equal > 1, F.floor(share * equal)).otherwise(0)
    bucket = F.when(F.col("doc_id").isNull(), len(cuts) + 1 + F.floor(share * parts)).otherwise(bucket)
    placed = docs.select("doc_id", "text", bucket.cast("int").alias("bucket"), "times")
    order = F.struct(F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("k"), digest.alias("s"))  # descending, without overflow
    heads = placed.groupBy("bucket").agg(F.min(order).alias("head"))
    numbers = [r[0] for r in heads.select("bucket").collect()]  # six a task at most
    before = {b: a for a, b in zip(sorted(numbers), sorted(numbers)[1:])} | ({min(numbers): max(numbers)} if numbers else {})
    steps = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else None
    own = placed.withColumn("copy", F.lit(0))
    if steps is None:
        return own, grouped
    first = placed.join(F.broadcast(heads.select("bucket", "head")), "bucket").where(order == F.col("head")).groupBy("bucket").agg(
        F.first(F.struct("doc_id", "text")).alias("r")).select(
        "r.*", F.element_at(steps, F.col("bucket")).alias("bucket"), F.lit(1).cast("long").alias("times"), F.lit(1).alias("copy"))
    return own.unionByName(first), grouped


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, features long"
#: Equal rows that a task makes of one at most.
_REPEAT = 10_000


def fingerprint(docs: DataFrame, rarity: list[int] | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is the next text's beginning."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = spark.sparkContext.broadcast(np.array(rarity if rarity is not None else entropy_rarity(docs), dtype=np.int64))
    rows, grouped = with_next(docs)
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    placed = rows.repartition(partitions(spark), "bucket").sortWithinPartitions(
        "bucket", "copy", F.col("doc_id").desc_nulls_last(), key)

    def finish(rank, rows_, nexts):
        """Result rows for (doc_id, text, print, times) and each one's next (text, print)."""
        edited = []
        for (_, text, *_), (other, _) in zip(rows_, nexts):
            half = len(text) // 2
            edited.append((text[:len(text) - half] + other[:half]).encode())
        prints = _prints(edited, rank)
        out = list(zip(*((
            doc_id, len(text), hashlib.sha256(e).hexdigest(), encode(own), encode(p), likeness(own, p), likeness(own, follow), int(own[1].sum()), times)
            for (doc_id, text, own, times), (_, follow), e, p in zip(rows_, nexts, edited, prints))))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[*(x.split()[0] for x in _SCHEMA.split(", ")), "times"])

    def run(batches):
        rank = held.value
        last, at = None, None  # the row that waits for its next, and its bucket
        for batch in batches:
            ready, nexts = [], []
            ids, texts, buckets, repeats, copies = (batch.column(i).to_pylist() for i in range(5))
            texts = [t or "" for t in texts]
            for doc_id, text, bucket, times, copy, own in zip(ids, texts, buckets, repeats, copies, _prints([t.encode() for t in texts], rank)):
                if last is not None and bucket == at:
                    ready.append((*last[:3], 1))
                    nexts.append((text, own))
                    if last[3] > 1:  # the others are followed by one like them
                        ready.append((*last[:3], last[3] - 1))
                        nexts.append((last[1], last[2]))
                    last = None
                if not copy:
                    last, at = (doc_id, text, own, times), bucket
            if ready:
                yield finish(rank, ready, nexts)

    done = map_batches(placed, run, _SCHEMA + ", times long")
    if not grouped:
        return done.drop("times")
    # Rows that stand for many are told out in pieces, which go to different tasks.
    done = materialise(done, "prints")
    piece = done.where("times > 1").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / _REPEAT)))).repartition(partitions(spark))
    many = piece.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(_REPEAT), F.col("times") - F.col("piece") * _REPEAT)))).drop("piece", "one")
    return done.where("times = 1").unionByName(many).drop("times")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))
