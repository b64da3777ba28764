"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, exact sorted-array intersection.

Two texts link when ``100 * |A & B| >= percent * |A | B|`` for their sets of word shingles.

1. *Size bands.*  Linked sets have sizes within ``percent / 100``, so they lie in one band or in two
   neighbouring ones.  In a pair of bands linked sets differ in at most K shingles; hashing shingles
   to K + 1 cells leaves one cell with equal contents (pigeonhole).  Each set sends one digest a cell;
   sets that share a digest get a candidate edge to the digest's smallest id.  Digests cover about ten
   shingles each, so words, lines or passages that are frequent don't make candidates.  Under a
   threshold of 0.87 cells would become too small for that; then 128 or more larger cells are drawn, so
   many that two sets right at the threshold miss each other once in 10^4 at most (:func:`sample_size`;
   once in 10^9 at 0.8).  What passes is verified exactly either way.
2. *Clusters* of candidate edges are connected components.  Equal sets leave one representative.
3. *Tiles.*  A cluster is one tile.  Beyond ``TILE`` members its candidate edges are verified first,
   one by one, and what they link is one component.  While components are still apart, the members
   are dealt into tiles at random, each to one, for ``DEALS`` rounds at most: a cluster of near copies
   ends there, at a cost in proportion to it.  For what is apart even then, pairs of blocks of
   compatible size bands are tiles, but for blocks of one component: a task holds two blocks at most,
   whatever the cluster's size.
4. In a tile parity bitmaps bound the overlap from above (their Hamming distance never exceeds the
   sets' difference); what passes is decided by exact intersection.  Pairs already connected in the
   tile are skipped, and each tile returns a spanning forest, never all pairs.
5. Links of all tiles are joined into components.

Nulls, empty and word-less texts have an empty set and link with nothing.  Rows that share a doc_id
are one node.  All rows without a doc_id are one node, too; it goes by a number that no row has, the
smallest long if that is free, and is returned as null.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import U64, Block, blocks, chain, complete_groups, local_components, mix, ngram_hashes
from .shared import buckets, connected_components, connected_stars, map_batches, materialise, partitions, scatter, unpack

BITS = 50  # of a shingle's hash; the rest of 64 bits hold the document's place in its block
MASK = U64((1 << BITS) - 1)
TILE = 1024
#: Rounds, each with one more run of components, in which a large cluster's members are dealt into random tiles.
#: Their number changes the time, not the results.
DEALS = 1
SIGNATURE_BITS = 1024
FLUSH = 250_000
#: From this threshold on the cells are as many as differing shingles, plus one; below, such cells would hold three
#: shingles or fewer and tie most texts together, so a fixed number of larger cells is drawn.
PIGEONHOLE = 87
SAMPLED = 128
#: Chance that two sets right at the threshold share no cell, under PIGEONHOLE.
MISSED = 1e-4
#: Numbers for a missing doc_id, of which the first that no row has is taken.
NULL_IDS = [-(1 << 63), (1 << 63) - 1, *(-(0x5DEECE66D << 20) - 7 * i for i in range(1, 30))]


def shingle_sets(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and n + 1 offsets by text.

    With fewer than n words the whole sequence is the one shingle."""
    start, end, doc = block.words()
    words = block.span_hash(start, end, fold=True)
    counts = np.bincount(doc, minlength=block.n)
    first = np.concatenate([[0], np.cumsum(counts)])
    at, h = ngram_hashes(words, first, doc, n)
    parts, owners = [h], [doc[at]]
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        parts.append(chain(words, first[short], k))
        owners.append(short)
    key = np.unique((np.concatenate(owners).astype(U64) << U64(BITS)) | (np.concatenate(parts) >> U64(64 - BITS)))
    sizes = np.bincount((key >> U64(BITS)).astype(np.int64), minlength=block.n)
    return key & MASK, np.concatenate([[0], np.cumsum(sizes)])


def set_digests(sets: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set, whatever its order."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(sets ^ U64(salt)), dtype=U64)])
        out.append((total[off[1:]] - total[off[:-1]]).view(np.int64))
    return out[0], out[1]


def bands(largest: int, percent: int) -> np.ndarray:
    """Upper ends of the size bands: sets that link lie in one band or in neighbouring ones."""
    ends, low = [], 1
    while True:
        high = low * 100 // percent
        ends.append(high)
        if high >= largest:
            ends.append((high + 1) * 100 // percent)
            return np.array(ends, dtype=np.int64)
        low = high + 1


def cell_digests(sets: np.ndarray, off: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(digest, text) for every cell of the two band pairs that each set belongs to."""
    sizes = np.diff(off)
    full = np.flatnonzero(sizes)
    if not len(full):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    ends = bands(int(sizes.max()), percent)
    band = np.searchsorted(ends, sizes[full])
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(sets ^ U64(0x2545F4914F6CDD1D)), dtype=U64)])
    digests, owners = [], []
    for pair, docs in ((band, full), (band - 1, full[band > 0])):
        pair = pair[pair >= 0]
        # |A ^ B| <= (|A| + |B|) (1 - t) / (1 + t)
        cells = 2 * ends[pair + 1] * (100 - percent) // (100 + percent) + 1
        base = np.concatenate([[0], np.cumsum(cells)])
        # Cells are ranges of the hash, so a cell's shingles lie together in the sorted set.
        edge_doc = np.repeat(np.arange(len(docs)), cells)
        edge_cell = np.arange(base[-1]) - base[edge_doc]
        slot = np.full(len(off), -1)
        slot[docs] = np.arange(len(docs))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        mine = slot[owner] >= 0
        local = slot[owner[mine]]
        cell = ((sets[mine] >> U64(BITS - 32)) * cells[local].astype(U64) >> U64(32)).astype(np.int64)
        held = np.bincount(base[local] + cell, minlength=base[-1])
        upto = np.cumsum(held)
        # positions within the sets of these documents, in order
        reach = np.concatenate([[0], upto])
        if len(docs) != len(full):
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(sets[mine] ^ U64(0x2545F4914F6CDD1D)), dtype=U64)])
        else:
            sums = total
        digest = sums[reach[1:]] - sums[reach[:-1]]
        digests.append(mix(mix(digest + edge_cell.astype(U64)) + pair[edge_doc].astype(U64) + U64(1)))
        owners.append(docs[edge_doc])
    return np.concatenate(digests), np.concatenate(owners)


def _shingles_a_cell(percent: int) -> int:
    return max(2, 1 << int(np.log2(0.9 * (100 + percent) / (2 * (100 - percent)))))


@functools.lru_cache(maxsize=8)
def sample_size(percent: int) -> int:
    """Cells to draw so that sets right at the threshold share one of three shingles but for a chance of MISSED.

    The shingles that fall into a cell are Poisson: none may be in one set only, three must be in both.  Cells
    hold one to two times their usual number, as sets are cut at powers of two."""
    t, least = percent / 100, 1.0
    for held in np.linspace(1, 2, 9) * _shingles_a_cell(percent):
        for one, both in ((held * 2 * (1 - t) / (1 + t), held * 2 * t / (1 + t)), (held * (1 - t), held * t)):  # equal sizes; nested
            least = min(least, math.exp(-one) * (1 - math.exp(-both) * (1 + both + both * both / 2)))
    return max(SAMPLED, math.ceil(math.log(MISSED) / math.log1p(-least)))


def sampled_cells(sets: np.ndarray, off: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(digest, text) of about ``sample_size`` cells a text, of 4 to 8 shingles each at 0.8, for lower thresholds.

    A text is cut at its size's power of two, and at larger ones where a partner may be.  Small texts are cut
    several times by other hashes, of large ones only the first cells count.  Cells of under three shingles are
    left out (but for texts of under 16), so that a frequent line makes no candidates."""
    sizes = np.diff(off)
    per_cell, drawn = _shingles_a_cell(percent), sample_size(percent)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    level = np.zeros(len(sizes), dtype=np.int64)
    some = sizes > 0
    level[some] = np.floor(np.log2(sizes[some])).astype(np.int64)
    digests, owners = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for up in range(1 + math.ceil(math.log2(100 / percent))):
        mine = some & (sizes * 100 >= percent * (1 << (level + up))) if up else some
        cells = np.maximum(2, (1 << (level + up)) // per_cell)
        rounds = np.where(mine, -(-drawn // cells), 0)
        for r in range(int(rounds.max(initial=0))):
            at = np.flatnonzero((rounds > r)[owner])
            doc = owner[at]
            h = mix(sets[at] + U64(1 + r))
            cell = ((h >> U64(32)) * cells[doc].astype(U64) >> U64(32)).astype(np.int64)
            kept = cell < drawn
            doc, h, group = doc[kept], h[kept], (doc * drawn + cell)[kept]
            if not len(group):
                continue
            order = np.argsort(group, kind="stable")
            group, h, doc = group[order], h[order], doc[order]
            head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            held = np.diff(np.append(head, len(group)))
            digest = np.add.reduceat(mix(h ^ U64(0x2545F4914F6CDD1D)), head)
            doc, place = doc[head], group[head] % drawn
            heavy = (held >= 3) | (level[doc] + up < 4)
            tag = (((level[doc] + up) << 40) + (r << 20) + place).astype(U64)
            digests.append(mix(mix(digest) + tag)[heavy])
            owners.append(doc[heavy])
    return np.concatenate(digests), np.concatenate(owners)


def _combine(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Before the shuffle: one row a key, its members tied to its smallest id by keys of their own.

    A digest that a third of all documents share so leaves each task once."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    head = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    leader = ids[head][np.cumsum(head) - 1] if len(keys) else ids
    rest = ~head & (leader != ids)
    ties = np.unique(np.stack([leader[rest], ids[rest]], axis=1), axis=0)
    own = mix(mix(ties[:, 0].view(U64)) ^ ties[:, 1].view(U64))
    return np.concatenate([keys[head], own, own]), np.concatenate([ids[head], ties[:, 0], ties[:, 1]])


def candidate_edges(docs: DataFrame, n: int, percent: int, wide: int) -> DataFrame:
    """(a, b): the name of a set (its first digest) tied to the smallest name that shares a cell with it.

    Texts with equal sets are one node here, so copies make no edges.  Digests meet in ``wide`` buckets."""
    tasks = partitions(docs.sparkSession)

    def send(batches):
        keys, ids, held = [], [], 0

        def flush():
            k, d = _combine(np.concatenate(keys), np.concatenate(ids))
            return scatter((k % U64(wide)).astype(np.int64), {"k": k, "d": d})

        for rows, block in blocks(batches):
            sets, off = shingle_sets(block, n)
            k, owner = (cell_digests if percent >= PIGEONHOLE else sampled_cells)(sets, off, percent)
            keys.append(k)
            ids.append(set_digests(sets, off)[0][owner])
            held += len(k)
            if held >= FLUSH:
                yield flush()
                keys, ids, held = [], [], 0
        if held:
            yield flush()

    def receive(batches):
        for table in complete_groups(batches, ["bucket"]):
            keys, ids = unpack(table, "k", U64), unpack(table, "d", np.int64)
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            head = np.concatenate([[True], keys[1:] != keys[:-1]])
            leader = ids[head][np.cumsum(head) - 1]
            rest = leader != ids
            if rest.any():
                node, low = local_components(ids[rest], leader[rest])
                tied = node != low
                yield pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(low[tied])], names=["a", "b"])

    packed = map_batches(docs.select("text"), send, "bucket int, k binary, d binary")
    return map_batches(packed.repartition(tasks, "bucket").sortWithinPartitions("bucket"), receive, "a long, b long")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int(np.count_nonzero(b[at] == a))
    return common * (100 + percent) >= percent * (len(a) + len(b))


def edge_links(sets: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """(a, b): the candidate edges between ``sets`` (doc_id, name, shingles) that are links."""
    ends = [sets.select(F.col("name").alias(x), F.col("doc_id").alias(f"{x}_id"), F.col("shingles").alias(f"{x}_set")) for x in "ab"]

    def verify(batches):
        for batch in batches:
            at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            one, other = at["a_set"].to_pylist(), at["b_set"].to_pylist()
            ok = pa.array([_linked(np.frombuffer(x, U64), np.frombuffer(y, U64), percent) for x, y in zip(one, other)], pa.bool_())
            yield pa.RecordBatch.from_arrays([at["a_id"].filter(ok), at["b_id"].filter(ok)], names=["a", "b"])

    # The leaders' side of a hub is one row, so Spark can split the other.
    return map_batches(edges.join(ends[0], "a").join(ends[1], "b").select("a_id", "b_id", "a_set", "b_set"), verify, "a long, b long")


def _links(table: pa.Table, percent: int):
    """Spanning forest of the links in one tile."""
    ids = table.column("doc_id").to_numpy()
    linked = table.column("comp").to_numpy()
    cross = table.column("side").to_numpy()
    sizes = table.column("n").to_numpy().astype(np.int64)
    order = np.lexsort((ids, sizes))
    ids, cross, sizes = ids[order], cross[order], sizes[order]
    component = np.unique(linked[order], return_inverse=True)[1]
    packed = table.column("shingles").to_pylist()
    sets = [np.frombuffer(packed[i], dtype=U64) for i in order]
    everything = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    ones = np.bincount(row * SIGNATURE_BITS + (everything % U64(SIGNATURE_BITS)).astype(np.int64), minlength=len(sets) * SIGNATURE_BITS)
    sign = np.packbits((ones & 1).astype(np.uint8).reshape(len(sets), SIGNATURE_BITS), axis=1).view(U64)
    out = []
    for i in range(len(sets)):
        upto = np.searchsorted(sizes, sizes[i] * 100 // percent, side="right")
        j = np.arange(i + 1, upto)
        j = j[component[j] != component[i]]
        if cross[0] >= 0 and cross[i] != 2:
            j = j[(cross[j] != cross[i])]  # pairs inside a block have a tile of their own
        if not len(j):
            continue
        both = sizes[i] + sizes[j]
        apart = np.bitwise_count(sign[j] ^ sign[i]).sum(axis=1, dtype=np.int64)
        j = j[(both - apart) * (100 + percent) >= 2 * percent * both]
        for k in j:
            if component[k] == component[i]:
                continue
            if _linked(sets[i], sets[k], percent):
                component[component == component[k]] = component[i]
                out.append((ids[i], ids[k]))
    return out


def _tiles(big: DataFrame, percent: int) -> DataFrame:
    """Members of large clusters, once a tile: pairs of blocks that aren't of one component (``comp``)."""
    # A component of more than half a tile has blocks of its own; the others share blocks.
    sizes = big.groupBy("cluster", "comp").agg(F.count("*").alias("rows"))
    apart = sizes.groupBy("cluster").agg(F.count("*").alias("comps")).where("comps > 1").select("cluster")
    own = sizes.where(F.col("rows") > TILE // 2).select("cluster", "comp", F.lit(True).alias("own"))
    # Blocks: size bands, split by hash so that none exceeds about half a tile.
    band = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / F.log(F.lit(100.1 / percent))).cast("int")
    teamed = big.join(apart, "cluster").join(own, ["cluster", "comp"], "left").withColumn("band", band).withColumn(
        "team", F.when(F.col("own"), F.col("comp")))
    splits = teamed.groupBy("cluster", "team", "band").agg(F.count("*").alias("rows")).groupBy("cluster", "team").agg(
        F.max(F.ceil(F.col("rows") * 2 / TILE)).cast("int").alias("splits"))
    before = Window.partitionBy("cluster").orderBy("team").rowsBetween(Window.unboundedPreceding, -1)
    teams = materialise(splits.select(
        F.col("cluster").alias("of"), F.col("team").alias("mate"), "splits", F.coalesce(F.sum("splits").over(before), F.lit(0)).cast("int").alias("base"),
        F.sum("splits").over(Window.partitionBy("cluster")).cast("int").alias("parts")), "teams")
    placed = teamed.join(teams, (F.col("cluster") == F.col("of")) & F.col("team").eqNullSafe(F.col("mate"))).withColumn(
        "part", (F.col("base") + F.pmod(F.xxhash64("doc_id"), F.col("splits").cast("long"))).cast("int"))
    # (band, part) meets the parts of its own band and of the neighbouring ones, but not its own component's.
    met = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.col("team").isNull() | (p < F.col("base")) | (p >= F.col("base") + F.col("splits")))
    others = F.flatten(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.transform(met, lambda p: (F.col("band") + d) * F.col("parts") + p)))
    return placed.withColumn("block", F.col("band") * F.col("parts") + F.col("part")).withColumn("other", F.explode(others)).select(
        "cluster", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "doc_id",
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"), "n", "shingles", "comp")


def verified_links(docs: DataFrame, members: DataFrame, edges: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): links between the representatives in ``members`` (doc_id, cluster), a forest by tile.

    ``edges`` are the candidate edges, by names of sets, that made the clusters."""
    spark = docs.sparkSession

    def to_sets(batches):
        for rows, block in blocks(batches, "text"):
            sets, off = shingle_sets(block, n)
            data = sets.tobytes()
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(np.diff(off), pa.int64()), pa.array([data[8 * i:8 * j] for i, j in zip(off[:-1], off[1:])], pa.binary()), pa.array(set_digests(sets, off)[0])],
                names=["doc_id", "cluster", "n", "shingles", "name"],
            )

    sets = materialise(map_batches(
        docs.select("doc_id", "text").join(members, "doc_id").select("doc_id", "cluster", "text"),
        to_sets, "doc_id long, cluster long, n long, shingles binary, name long"), "sets")
    whole = materialise(sets.groupBy("cluster").agg(F.count("*").alias("all_rows")), "whole")
    small = sets.join(whole.where(F.col("all_rows") <= TILE), "cluster").select(
        "cluster", F.lit(0).alias("x"), F.lit(0).alias("y"), "doc_id", F.lit(-1).alias("side"), "n", "shingles", F.col("doc_id").alias("comp"))
    large = whole.where(F.col("all_rows") > TILE)
    if large.isEmpty():
        return tile_links(small, percent)
    big = sets.join(large, "cluster")
    first = materialise(edge_links(big, edges, percent), "first")
    for deal in range(DEALS + 1):
        # The links so far as stars, which the next runs of components needn't find again.
        first = connected_stars(first, "parts")
        placed = materialise(big.join(first.select(F.col("a").alias("doc_id"), F.col("b").alias("comp")), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id")), "big")
        apart = placed.groupBy("cluster").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("cluster")
        placed = placed.join(apart, "cluster")
        if deal == DEALS:
            break
        part = F.pmod(F.xxhash64("doc_id", F.lit(deal)), F.ceil(F.col("all_rows") / TILE)).cast("int")
        dealt = materialise(tile_links(placed.select(
            "cluster", part.alias("x"), part.alias("y"), "doc_id", F.lit(-1).alias("side"), "n", "shingles", "comp"), percent), "dealt")
        if dealt.isEmpty():
            break
        first = first.union(dealt)
    return tile_links(small.unionByName(_tiles(placed, percent)), percent).union(first)


def tile_links(tiles: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links in each tile."""

    def link(batches):
        for table in complete_groups(batches, ["cluster", "x", "y"]):
            keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("cluster", "x", "y")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            found = []
            for i, j in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])):
                if j - i > 1:
                    found += _links(table.slice(i, j - i), percent)
            if found:
                a, b = np.array(found, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    tiles = tiles.withColumn("tile", F.xxhash64("cluster", "x", "y"))
    return map_batches(
        tiles.repartition(partitions(tiles.sparkSession), "tile").sortWithinPartitions("tile", "cluster", "x", "y").drop("tile"), link, "a long, b long")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text, ...).

    component_id is the smallest doc_id reachable over links, the row's own included."""
    given = F.col("doc_id").cast("long")
    taken = {r[0] for r in docs.select(given.alias("doc_id")).where(F.col("doc_id").isin(NULL_IDS)).distinct().collect()}
    null = F.lit(next(x for x in NULL_IDS if x not in taken))
    docs = docs.select(F.coalesce(given, null).alias("doc_id"), F.col("text").cast("string").alias("text"))

    def describe(batches):
        for rows, block in blocks(batches):
            sets, off = shingle_sets(block, n)
            d1, d2 = set_digests(sets, off)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(off), pa.int64()), pa.array(d1), pa.array(d2)], names=["doc_id", "n_shingles", "d1", "d2"])

    described = materialise(map_batches(docs, describe, "doc_id long, n_shingles long, d1 long, d2 long"), "described")
    # A table of its own, so that Spark can split a set that many rows share when both sides meet.
    same = materialise(described.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")), "same")
    # Rows of one doc_id may hold several sets: each ties the doc_id to that set's representative.  Equal rows may stay.
    rep = materialise(described.where("n_shingles > 0").join(same, ["d1", "d2", "n_shingles"]).select("doc_id", "rep", "d1"), "rep")
    copies = rep.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # A shingle makes four bytes of digests or so at 0.9, and a small text ``sample_size`` digests under PIGEONHOLE.
    least = sample_size(percent) if percent < PIGEONHOLE else 1
    shingles = described.agg(F.sum(F.greatest("n_shingles", F.lit(least)))).first()[0] or 0
    edges = materialise(candidate_edges(docs, n, percent, buckets(docs.sparkSession, 8 * shingles)).distinct(), "edges")
    clusters = connected_components(edges, "candidates")
    members = rep.where("doc_id = rep").join(clusters, F.col("d1") == F.col("id")).groupBy("doc_id").agg(F.min("component").alias("cluster"))
    found = connected_stars(verified_links(docs, members, edges, n, percent).union(copies), "links")
    out = described.join(found, described.doc_id == found.a, "left").select(
        described.doc_id, "n_shingles", F.coalesce("b", described.doc_id).alias("component_id"))
    return out.select(F.nullif("doc_id", null).alias("doc_id"), "n_shingles", F.nullif("component_id", null).alias("component_id"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90)
