"""Suffix-array dedup: range-partitioned suffixes, sorted bucket by bucket.

Removes every byte covered by a string of ``length`` bytes (200) that starts anywhere else too.

A suffix for each of 10^14 bytes can't be shipped, so the array is sparse and loses nothing:

* Each window of ``length`` bytes has an *anchor*, the position inside it whose ``GRAM``-byte string
  has the smallest hash.  It depends on the window's bytes alone, so equal windows have equal
  anchors at equal offsets.  Consecutive windows with one anchor form a *unit*.
* Units meet by their anchor's string.  A string that occurs once rules its windows out.  A whole
  unit that occurs twice is settled: its windows all repeat.  What is left are the units at the ends
  of repeated passages, of which each different text is fetched once.
* Sampled splitters range-partition those suffixes by their leading tokens (the first bytes of the
  anchor's string).  Spark's range bounds never divide equal keys, and a chunk's last group is
  carried to the next chunk, so nothing has to be compared over a boundary.  Each bucket sorts its
  window suffixes by multikey quicksort with eight bytes a key: a round splits each group of equal
  prefixes by the next word and drops what stands alone.  What survives all rounds repeats,
  compared byte by byte.
* Leading tokens of more than ``HOT`` such units (the ends of a passage that millions of texts
  share) aren't one bucket: each window goes by itself to a bucket of its 128-bit hash, which deals
  them evenly.  Windows that a task holds twice are settled there, and one of each goes on.

Nulls count as empty texts, texts under ``length`` bytes lose nothing, matches never cross texts,
and two rows with equal texts repeat each other, also when their doc_ids are equal.  A passage that
a third of all documents share is combined in each task before it is sent.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import U64, Block, blocks, complete_groups, mix
from .shared import buckets, column_name, extended, map_batches, materialise, partitions, scatter, unpack

LENGTH = 200
GRAM = 72
FLUSH = 150_000
HOT = 2_000
_POSITION_BITS = 22  # of a block's bytes; longer texts take more


def anchored_units(block: Block, length: int, gram: int):
    """Text, first window start, number of windows, anchor, hash of the anchor's string, hash of the
    unit's bytes: for every unit of the block, starts and anchors as positions in its buffer."""
    size = len(block.data)
    none = np.zeros(0, np.int64)
    if size < length:
        return none, none, none, none, none.view(U64), none.view(U64)
    prefix = block.prefix_hash()
    at = np.arange(size - gram + 1)
    h = block.span_hash(at, at + gram, prefix=prefix)
    bits = U64(max(_POSITION_BITS, int(size).bit_length()))
    key = (h >> bits << bits) | at.astype(U64)
    # Sliding minimum over the window's grams: prefix minima of a block against suffix minima.
    w = length - gram + 1
    padded = np.concatenate([key, np.full(-len(key) % w, ~U64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[:len(key) - w + 1], ahead[w - 1:len(key)])
    start = np.arange(len(low))
    doc = np.repeat(np.arange(block.n), np.diff(np.minimum(block.off, len(low))))
    inside = start + length <= block.off[doc + 1]
    start, doc = start[inside], doc[inside]
    if not len(start):
        return none, none, none, none, none.view(U64), none.view(U64)
    anchor = (low[start] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    run = np.diff(np.append(head, len(start)))
    first, anchor, doc = start[head], anchor[head], doc[head]
    return doc, first, run, anchor, h[anchor], block.span_hash(first, first + run + length - 1, prefix=prefix)


def _sorted_units(h, u, rid, tid, start):
    order = np.lexsort((start, tid, rid, u, h))
    h, u = h[order], u[order]
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new_u = new_h | np.concatenate([[True], u[1:] != u[:-1]])
    return order, new_h, new_u


_FOUND = "rid long, tid long, lo int, hi int"
_SPANS = _FOUND + ", lead long, gram long, skip int"


def _spans(rid, tid, lo, hi, lead=None, gram=None, skip=None):
    """Rows of _SPANS: removed bytes, or with ``gram`` a unit whose bytes are wanted."""
    n = len(rid)
    nulls = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(rid), pa.array(tid), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), nulls if lead is None else pa.array(lead),
         nulls if gram is None else pa.array(gram), pa.nulls(n, pa.int32()) if skip is None else pa.array(skip.astype(np.int32))],
        names=["rid", "tid", "lo", "hi", "lead", "gram", "skip"])


def _row_hash(rid: np.ndarray, tid: np.ndarray) -> np.ndarray:
    return mix(mix(rid.view(U64)) ^ tid.view(U64))


_UNITS = {"h": U64, "u": U64, "rid": np.int64, "tid": np.int64, "start": np.int32, "run": np.int16, "skip": np.int16, "lead": np.int64}


def settle_units(docs: DataFrame, length: int, gram: int, wide: int) -> DataFrame:
    """Spans that repeat as whole units, and the units still to be compared (with ``gram``).

    Units meet in ``wide`` buckets by their anchor's string, packed by task and bucket."""
    tasks = partitions(docs.sparkSession)
    names = ["bucket", *_UNITS, "many"]

    def packed(bucket, columns):
        batch = scatter((bucket % U64(wide)).astype(np.int64), columns)
        have = dict(zip(batch.schema.names, batch.columns))
        return pa.RecordBatch.from_arrays([have.get(n, pa.nulls(batch.num_rows, pa.binary())) for n in names], names=names)

    def send(batches):
        kept: list[list[np.ndarray]] = []
        held = 0

        def flush():
            units = dict(zip(_UNITS, (np.concatenate(x) for x in zip(*kept))))
            # Units met twice here are settled; one of each goes on, marked, to meet the others.
            order, _, new_u = _sorted_units(*(units[c] for c in ("h", "u", "rid", "tid", "start")))
            group = np.cumsum(new_u) - 1
            many = np.bincount(group)[group] > 1
            rest = order[many & ~new_u]
            if len(rest):  # settled spans only pass through
                yield packed(_row_hash(units["rid"][rest], units["tid"][rest]), {
                    **{c: units[c][rest] for c in ("rid", "tid", "start", "run")}, "many": np.full(len(rest), 2, np.int8)})
            one = order[new_u]
            yield packed(units["h"][one], {**{c: v[one] for c, v in units.items()}, "many": many[new_u].astype(np.int8)})

        for rows, block in blocks(batches):
            doc, start, run, anchor, h, u = anchored_units(block, length, gram)
            if not len(doc):
                continue
            rid, tid = (rows.column(i).to_numpy(zero_copy_only=False)[doc] for i in range(2))
            words = np.ndarray((max(len(block.data) - 7, 0),), dtype=">u8", buffer=np.ascontiguousarray(block.data), strides=(1,))
            found = (h, u, rid, tid, start - block.off[doc], run, anchor - start, words[anchor] >> U64(1))
            kept.append([v.astype(kind, copy=False) for v, kind in zip(found, _UNITS.values())])
            held += len(doc)
            if held >= FLUSH:
                yield from flush()
                kept, held = [], 0
        if held:
            yield from flush()

    def receive(batches):
        for table in complete_groups(batches, ["bucket"]):
            through = np.array([m[:1] == b"\x02" for m in table.column("many").to_pylist()], dtype=bool)
            passed = table.filter(pa.array(through))
            if passed.num_rows:
                rid, tid, start, run = (unpack(passed, c, _UNITS[c]) for c in ("rid", "tid", "start", "run"))
                yield _spans(rid, tid, start, start + run + (length - 1))
            table = table.filter(pa.array(~through))
            if not table.num_rows:
                continue
            h, u, rid, tid, start, run, skip, lead = (unpack(table, c, kind) for c, kind in _UNITS.items())
            many = unpack(table, "many", np.int8)
            order, new_h, new_u = _sorted_units(h, u, rid, tid, start)
            by_u, by_h = np.cumsum(new_u) - 1, np.cumsum(new_h) - 1
            settled = np.bincount(by_u, weights=1 + many[order])[by_u] > 1
            done = order[settled]
            yield _spans(rid[done], tid[done], start[done], start[done] + run[done] + (length - 1))
            # A string whose units are all settled, or that has one unit, needs no comparison.
            texts = np.bincount(by_h[new_u])
            still = np.bincount(by_h, weights=~settled) > 0
            ask = order[new_u & (still & (texts > 1))[by_h]]
            yield _spans(rid[ask], tid[ask], start[ask], start[ask] + run[ask] + (length - 1), lead[ask], h[ask].view(np.int64), skip[ask])

    sent = map_batches(docs.select("rid", "tid", "text"), send, "bucket int, " + ", ".join(f"{c} binary" for c in names[1:]))
    return map_batches(sent.repartition(tasks, "bucket").sortWithinPartitions("bucket"), receive, _SPANS)


def repeated_suffixes(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which of the positions ``at`` start a string of ``length`` bytes that another of their group equals.

    Multikey quicksort, eight bytes a key: groups of equal prefixes are split by the next word."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))
    for depth in [*range(0, length - 8, 8), length - 8]:
        head = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
        alone = head & np.append(head[1:], True) if len(head) else head
        order, group = order[~alone], group[~alone]
        if not len(order):
            break
        word = words[at[order] + depth].astype(U64)
        if ((word[1:] != word[:-1]) & (group[1:] == group[:-1])).any():
            by = np.lexsort((word, group))
            order, group, word = order[by], group[by], word[by]
        group = np.cumsum(np.concatenate([[True], (group[1:] != group[:-1]) | (word[1:] != word[:-1])]))
    if len(group):
        head = np.concatenate([[True], group[1:] != group[:-1]])
        order = order[~(head & np.append(head[1:], True))]
    found = np.zeros(len(at), dtype=bool)
    found[order] = True
    return found


def _windows(units: Block, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit and step within it of every window."""
    run = units.lengths - (length - 1)
    unit = np.repeat(np.arange(units.n), run)
    return unit, np.arange(len(unit)) - np.repeat(np.cumsum(run) - run, run)


def _runs(rid: np.ndarray, tid: np.ndarray, lo: np.ndarray, length: int) -> pa.RecordBatch:
    """(rid, tid, lo, hi) of windows, consecutive ones of a row as one span."""
    order = np.lexsort((lo, tid, rid))
    rid, tid, lo = rid[order], tid[order], lo[order]
    head = np.concatenate([[True], (rid[1:] != rid[:-1]) | (tid[1:] != tid[:-1]) | (lo[1:] > lo[:-1] + 1)])
    tail = np.append(head[1:], True)
    return pa.RecordBatch.from_arrays(
        [pa.array(rid[head]), pa.array(tid[head]), pa.array(lo[head].astype(np.int32)), pa.array((lo[tail] + length).astype(np.int32))], names=["rid", "tid", "lo", "hi"])


_WINDOWS = {"h": U64, "g": U64, "at": np.int64, "of": np.int64, "low": np.int32, "many": np.int8}


def match_windows(units: DataFrame, length: int, wide: int = 1024) -> DataFrame:
    """(rid, tid, lo, hi): repeated spans of units (rid, tid, lo, bytes) of hot leads, by the hashes of their windows."""
    tasks = partitions(units.sparkSession)
    wide = max(wide, tasks)
    names = ["bucket", *_WINDOWS, "rid", "tid", "lo", "hi"]

    def groups(h, g):
        order = np.lexsort((g, h))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])])
        return order, new, np.cumsum(new) - 1

    def send(batches):
        kept: list[list[np.ndarray]] = []
        held = 0

        def flush():
            h, g, rid, tid, lo = (np.concatenate(x) for x in zip(*kept))
            order, new, group = groups(h, g)
            many = np.bincount(group) > 1
            rest = order[many[group] & ~new]
            if len(rest):
                spans = _runs(rid[rest], tid[rest], lo[rest], length)
                to = _row_hash(spans.column(0).to_numpy(), spans.column(1).to_numpy()) % U64(wide)
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), *(pa.nulls(len(spans), pa.binary()) for _ in _WINDOWS), *spans.columns], names=names)
            one = order[new]
            batch = scatter((h[one] % U64(wide)).astype(np.int64), {"h": h[one], "g": g[one], "at": rid[one], "of": tid[one], "low": lo[one], "many": many.astype(np.int8)})
            none = [pa.nulls(len(batch), kind) for kind in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *none], names=names)

        for rows, block in blocks(batches, "bytes"):
            unit, step = _windows(block, length)
            at, half, prefix = block.off[unit] + step, length // 2, block.prefix_hash()
            h = block.span_hash(at, at + length, prefix=prefix)
            g = mix(block.span_hash(at, at + half, prefix=prefix)) + block.span_hash(at + half, at + length, prefix=prefix)
            rid, tid, lo = (rows.column(rows.schema.get_field_index(c)).to_numpy()[unit] for c in ("rid", "tid", "lo"))
            kept.append([h, g, rid, tid, (lo + step).astype(np.int32)])
            held += len(unit)
            if held >= 3 * FLUSH:
                yield from flush()
                kept, held = [], 0
        if held:
            yield from flush()

    def receive(batches):
        for table in complete_groups(batches, ["bucket"]):
            through = pc.is_valid(table.column("rid"))
            yield from table.filter(through).select(["rid", "tid", "lo", "hi"]).to_batches()
            table = table.filter(pc.invert(through))
            if not table.num_rows:
                continue
            h, g, rid, tid, lo, many = (unpack(table, c, kind) for c, kind in _WINDOWS.items())
            order, _, group = groups(h, g)
            found = order[np.bincount(group, weights=1 + many[order])[group] > 1]
            if len(found):
                yield _runs(rid[found], tid[found], lo[found], length)

    packed = map_batches(
        units.select("rid", "tid", "lo", "bytes"), send, "bucket int, " + ", ".join(f"{c} binary" for c in _WINDOWS) + ", " + _FOUND)
    return map_batches(packed.repartition(tasks, "bucket").sortWithinPartitions("bucket"), receive, _FOUND)


def compare_suffixes(docs: DataFrame, wanted: DataFrame, length: int, wide: int, hot: int = HOT) -> DataFrame:
    """(rid, tid, lo, hi): repeated spans of the wanted units, compared by their bytes; by hashes for leads of over ``hot`` units."""
    spark = docs.sparkSession
    row = ["rid", "tid"]
    ask = ["lo", "hi", "lead", "gram", "skip"]
    sent = {"lead": pa.int64(), "gram": pa.int64(), "skip": pa.int32(), "rid": pa.int64(), "tid": pa.int64(), "lo": pa.int32(), "bytes": pa.binary()}

    def fetch(batches):
        for batch in batches:
            out: list[tuple] = []
            for rid, tid, text, asks in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = text.encode() if isinstance(text, str) else text
                out += [(a["lead"], a["gram"], a["skip"], rid, tid, a["lo"], data[a["lo"]:a["hi"]]) for a in asks]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), sent.values())], names=list(sent))

    def bucket(batches):
        for table in complete_groups(batches, ["lead", "gram"]):
            units = Block.of(table.column("bytes").combine_chunks())
            unit, step = _windows(units, length)
            at = units.off[unit] + step
            gram = np.unique(table.column("gram").to_numpy(), return_inverse=True)[1]
            found = repeated_suffixes(units.data, at, gram[unit] * (length + 1) + table.column("skip").to_numpy()[unit] - step, length)
            unit, step = unit[found], step[found]
            if len(unit):
                rid, tid, lo = (table.column(c).to_numpy()[unit] for c in ("rid", "tid", "lo"))
                yield _runs(rid, tid, lo + step, length)

    def fetched(asked: DataFrame) -> DataFrame:
        # Units of rows that occur twice are settled, so each row here is one of its kind and asks once for a unit.
        asks = asked.groupBy(*row).agg(F.collect_list(F.struct(*ask)).alias("asks"))
        return map_batches(docs.select(*row, "text").join(asks, row), fetch, "lead long, gram long, skip int, rid long, tid long, lo int, bytes binary")

    # Leads of many units: at most one row for each ``hot`` units, so Spark chooses how to join them.
    leads = materialise(wanted.groupBy("lead").count().where(F.col("count") > hot).select("lead"), "hot")
    some = not leads.isEmpty()
    units = fetched(wanted.join(leads, "lead", "left_anti") if some else wanted)
    cold = map_batches(units.repartitionByRange(partitions(spark), "lead").sortWithinPartitions("lead", "gram"), bucket, _FOUND)
    return cold.union(match_windows(fetched(wanted.join(leads, "lead", "left_semi")), length, 4 * wide)) if some else cold


def _row_keys(docs: DataFrame) -> tuple:
    """Two longs that name a row: its doc_id and a 64-bit hash of its text, so rows share them only if both agree.

    Rows without a doc_id go by two such hashes of the text, ids that aren't whole numbers by their hash."""
    number = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    by_id = F.col("doc_id").cast("long") if number else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    return F.coalesce(by_id, F.xxhash64("text")), F.xxhash64(F.lit(1), "text")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, decode: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) with kept (binary), n_bytes, n_removed, n_spans, kept_sha256.

    ``kept`` is what is left of the text's UTF-8 bytes; with ``decode`` it is a string, without the bytes
    of characters that are only partly left.  Names that ``docs`` has already get an underscore."""
    rid, tid = _row_keys(docs)
    keyed = docs.select(rid.alias("rid"), tid.alias("tid"), F.col("text").cast("string").alias("text"))
    wide = buckets(docs.sparkSession, keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    spans = materialise(settle_units(keyed, length, gram, wide), "units")
    compared = compare_suffixes(keyed, spans.where("gram is not null"), length, wide, hot)
    # A set: rows that are equal in doc_id and text share their spans, however many they are.
    removed = spans.where("gram is null").select("rid", "tid", "lo", "hi").union(compared).groupBy("rid", "tid").agg(
        F.collect_set(F.struct("lo", "hi")).alias("spans"))
    keys = column_name(docs, "rid"), column_name(docs, "tid")
    mark = column_name(docs, "spans")
    whole = docs.withColumns(dict(zip(keys, (rid, tid)))).join(
        removed.select(F.col("rid").alias(keys[0]), F.col("tid").alias(keys[1]), F.col("spans").alias(mark)), list(keys), "left").drop(*keys)
    added = zip(("kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"), ("string" if decode else "binary", "long", "long", "long", "string"))
    schema = extended(whole.drop(mark), *((column_name(docs, name), kind) for name, kind in added))

    def cut(batches):
        for batch in batches:
            text_at, mark_at = batch.schema.get_field_index("text"), batch.schema.get_field_index(mark)
            columns = [c for i, c in enumerate(batch.columns) if i != mark_at]
            kept, size, gone, runs, digest = [], [], [], [], []
            for text, marks in zip(batch.column(text_at).cast(pa.binary()).to_pylist(), batch.column(mark_at)):
                text = text or b""
                parts, at, spans, lost = [], 0, 0, 0
                if marks.is_valid:
                    flat = marks.values.flatten()
                    lo, hi = (np.asarray(x) for x in flat)
                    order = np.argsort(lo, kind="stable")
                    lo, hi = lo[order], np.maximum.accumulate(hi[order])
                    head = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
                    for i, j in zip(lo[head].tolist(), hi[np.append(head[1:], len(hi)) - 1].tolist()):
                        parts.append(text[at:i])
                        spans, lost, at = spans + 1, lost + j - i, j
                parts.append(text[at:])
                left = b"".join(parts)
                kept.append(left.decode("utf-8", "ignore") if decode else left)
                size.append(len(text)), gone.append(lost), runs.append(spans)
                digest.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(kept, pa.string() if decode else pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())],
                names=[f.name for f in schema])

    return map_batches(whole, cut, schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
