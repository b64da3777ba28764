"""Conversation structure repair by bidirectional Dijkstra over the edit lattice.

A conversation should read ``(s?(ua)+)?`` by its roles' initials.  The lattice's nodes are (rows read, what may come
next); its edges are the edits: Keep 0, Rerole to user or assistant 2, Delete 3, Insert an empty user or assistant
row 2.  Blank and duplicate rows must go; a truncated row that stays adds 1.  A forward and a reverse heap
take the cheaper side in turn until no cheaper or equal way is left, so all crossings of equal cost are known; the
one whose edits' initials read least is taken.  For one node and cost no audit begins another one (the same edits
read the same rows at the same cost, and more of them cost more), so the least of both halves is the least whole.

Rows are first grouped: equal rows of a turn become one with a count, and what occurs at several turns learns its
first one from a second aggregate.  Only these narrow rows, without texts, are range-partitioned by conversation,
turn, role and the text's SHA-256, which is also the order of rows of one turn.  A conversation that crosses a range
or has more than ``PIECE`` rows becomes pieces: for each state at its start and end a piece has the cheapest least
audit, and pieces are joined in order.  So a conversation of any number of rows is spread over tasks; the task
that joins it holds its audit, a character an edit, and never its texts.  Its texts then stream through one task,
a row at a time: a SHA-256 over a whole conversation can't be split.

Nulls in role and text count as one space (a blank row); null turns come first; a null conv_id is a conversation.
An empty table gives an empty one.  Extra columns of the input are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_batches, materialise, partitions

PIECE = 512
SEPARATORS = " \t\n\x0b\x0c\r"
#: States: nothing yet, after s, after u, after a.  What an initial leads to, and where a conversation may end.
_AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ENDS = (0, 3)
#: The state that a user or assistant row leads to, whichever is due.
_DUE = (2, 2, 3, 2)
_KEEP, _REROLE, _DELETE, _INSERT, _TRUNCATED = 0, 2, 3, 2, 1
_EDGES = ("su", "ua", "au")


def _edits(code: tuple[str, bool, bool]):
    """(label, cost, [state after for each state before, or None]) of the edits that read a row."""
    initial, must_go, truncated = code
    yield "D", _DELETE, (0, 1, 2, 3)
    if not must_go:
        more = _TRUNCATED if truncated else 0
        yield "K", _KEEP + more, tuple(after.get(initial) for after in _AFTER)
        yield "R", _REROLE + more, _DUE


def _least(rows, first: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest edits from state ``first`` before the rows to one of ``ends`` after them."""
    n = len(rows)
    edits = [list(_edits(code)) for code in rows]
    done: tuple[dict, dict] = ({}, {})  # node: (cost, least audit before it; least audit behind it)
    # Forward entries are (cost, rows read, audit, state), reverse ones count the rows still to read: edits without
    # cost read a row, so a node's candidates are all there before the first of them is taken.
    heaps: tuple[list, list] = ([(0, 0, "", first)], [(0, 0, "", q) for q in ends])
    best, audits = None, []

    def crossing(cost, audit):
        nonlocal best, audits
        if best is None or cost < best:
            best, audits = cost, [audit]
        elif cost == best:
            audits.append(audit)

    while True:
        for heap, settled in zip(heaps, done):
            while heap and _node(heap[0], heap is heaps[0], n) in settled:
                heapq.heappop(heap)
        if not heaps[0] or not heaps[1] or best is not None and heaps[0][0][0] + heaps[1][0][0] > best:
            # A side without entries has settled all that it reaches; so the other one's crossings are known too.
            break
        forward = heaps[0][0][0] <= heaps[1][0][0]
        heap, mine, other = (heaps[0], *done) if forward else (heaps[1], done[1], done[0])
        cost, _, audit, q = entry = heapq.heappop(heap)
        node = _node(entry, forward, n)
        mine[node] = cost, audit
        i = node[0]
        if node in other:
            crossing(cost + other[node][0], audit + other[node][1] if forward else other[node][1] + audit)
        steps = [("I", _INSERT, (i, _DUE[q]))] if forward else [("I", _INSERT, (i, p)) for p in range(4) if _DUE[p] == q]
        if forward and i < n:
            steps += [(label, price, (i + 1, after[q])) for label, price, after in edits[i] if after[q] is not None]
        elif not forward and i:
            steps += [(label, price, (i - 1, p)) for label, price, after in edits[i - 1] for p in range(4) if after[p] == q]
        for label, price, to in steps:
            if to in other:
                crossing(cost + price + other[to][0], audit + label + other[to][1] if forward else other[to][1] + label + audit)
            if to not in mine:
                entry = (cost + price, to[0], audit + label, to[1]) if forward else (cost + price, n - to[0], label + audit, to[1])
                heapq.heappush(heap, entry)
    return None if best is None else (best, min(audits))


def _node(entry, forward: bool, n: int) -> tuple[int, int]:
    return (entry[1] if forward else n - entry[1]), entry[3]


@functools.lru_cache(maxsize=4096)
def repair_rows(rows: tuple[tuple[str, bool, bool], ...]) -> tuple[int, str]:
    """Cost and audit of (initial, must go, truncated) of a whole conversation's rows."""
    return _least(rows, 0, _ENDS)


def _piece_ways(rows) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of a piece, for all states that it can lead to."""
    possible = [(first, last) for first in range(4) for last in range(4) if last > 1 or first <= last]
    ways = ((first, last, _least(rows, first, (last,))) for first, last in possible)
    return [(first, last, *way) for first, last, way in ways if way is not None]


def _joined(before: dict[int, tuple[int, str]], ways) -> dict[int, tuple[int, str]]:
    """Cost and audit by state, after one more piece."""
    out: dict[int, tuple[int, str]] = {}
    for first, last, cost, audit in ways:
        if first in before:
            way = before[first][0] + cost, before[first][1] + audit
            if last not in out or way < out[last]:
                out[last] = way
    return out


# Marking rows, with DataFrame functions.

def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


_KEY = ("conv_id", "turn", "role", "digest")


def _order() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in _KEY]


def _slim(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", _text("role").alias("role"), F.unhex(F.sha2(_text("text").cast("binary"), 256)).alias("digest"), _text("text").alias("text"))


def mark(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, copies, blank, first, truncated): one row for all equal rows of a turn.

    ``first``: role and text occur at no earlier turn, so one of the copies isn't a duplicate."""
    end = F.substring(F.rtrim(_text("text"), F.lit(SEPARATORS)), -1, 1)
    grouped = _slim(rows).withColumn("end", end).groupBy(*_KEY).agg(F.count("*").alias("copies"), F.first("end").alias("end"))
    grouped = materialise(grouped, "turns")
    what = ["conv_id", "role", "digest"]
    firsts = grouped.groupBy(*what).agg(F.min(F.struct("turn")).alias("at"), F.count("*").alias("turns")).where("turns > 1")
    key = F.struct(*(F.col(c) for c in what))
    joined = grouped.withColumn("key", key).join(firsts.select(key.alias("again"), "at"), F.col("key").eqNullSafe(F.col("again")), "left")
    first = F.col("at").isNull() | F.col("at.turn").eqNullSafe(F.col("turn"))
    blank = F.col("end") == ""
    truncated = ~blank & first & ~F.col("end").isin(".", "!", "?")
    return joined.select(*_KEY, "copies", blank.alias("blank"), first.alias("first"), truncated.alias("truncated"))


def faults(marked: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated) of every conversation."""
    whole = lambda c: F.col(c).cast("long")
    turns = marked.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("copies") - whole("first"))).alias("duplicate"), F.sum(whole("truncated")).alias("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    return turns.groupBy("conv_id").agg(gaps.alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))


def _batched(rows, names: list[str], types: list[pa.DataType], most: int = 1024):
    while held := list(itertools.islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def _rows(batches):
    """The first batch's schema (None without one), and all rows as tuples."""
    first = next(batches, None)
    each = (row for batch in itertools.chain([first], batches) for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))))
    return (None, iter(())) if first is None else (first.schema, each)


_WAY = {"before": pa.int32(), "after": pa.int32(), "cost": pa.int64(), "audit": pa.string()}
_PIECE = {"piece": pa.int64(), "illegal": pa.int64(), "head": pa.string(), "tail": pa.string(), "ways": pa.list_(pa.struct(_WAY.items()))}


def _cut(rows, piece: int):
    """Pieces of the conversations in a range of marked rows, named by their first row."""
    held: list[tuple[str, bool, bool]] = []
    opening = True  # the first conversation may have begun in the range before
    number, at = 0, None

    def closed(whole):
        pairs = sum(a[0] + b[0] not in _EDGES for a, b in zip(held, held[1:]))
        ways = [(0, _ENDS[-1], *repair_rows(tuple(held)))] if whole else _piece_ways(held)
        return (*at, number, pairs, held[0][0], held[-1][0], [dict(zip(_WAY, way)) for way in ways])

    for *key, copies, blank, first, truncated in rows:
        if held and key[0] != at[0]:
            yield closed(not opening and not number)
            held, number, opening = [], 0, False
        for k in range(copies):
            if len(held) >= piece:
                yield closed(False)
                held, number = [], number + 1
            at = at if held else key
            held.append((key[2][:1], blank or k > 0 or not first, truncated and k == 0))
    if held:  # the last one may go on in the next range
        yield closed(False)


def _join(rows):
    """(conv_id, illegal, cost, audit) from all pieces of each conversation, in order."""
    for conv, pieces in itertools.groupby(rows, key=lambda row: row[0]):
        state: dict[int, tuple[int, str]] = {0: (0, "")}
        illegal, before = 0, None
        for _, pairs, head, tail, ways in pieces:
            illegal += pairs + (before is not None and before + head not in _EDGES)
            before = tail
            state = _joined(state, [tuple(way.values()) for way in ways])
        yield conv, illegal, *min(state[q] for q in _ENDS if q in state)


def audits(marked: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, illegal, cost, audit) of every conversation, from pieces of at most ``piece`` rows."""
    tasks = partitions(marked.sparkSession)
    kinds = {c: marked.schema[c].dataType.simpleString() for c in _KEY}
    spread = marked.repartitionByRange(tasks, *_order()).sortWithinPartitions(*_order())

    def cut(batches):
        schema, rows = _rows(batches)
        if schema is not None:
            yield from _batched(_cut(rows, piece), [*_KEY, *_PIECE], [*(schema.field(c).type for c in _KEY), *_PIECE.values()])

    def join(batches):
        schema, rows = _rows(batches)
        if schema is not None:
            yield from _batched(_join(rows), ["conv_id", "illegal", "cost", "audit"], [schema.field(0).type, pa.int64(), pa.int64(), pa.string()])

    pieces = map_batches(spread, cut, ", ".join(f"{c} {kind}" for c, kind in kinds.items())
                         + ", piece long, illegal long, head string, tail string, ways array<struct<before int, after int, cost long, audit string>>")
    together = pieces.repartition(tasks, "conv_id").sortWithinPartitions(*_order(), "piece")
    return map_batches(together.select("conv_id", *(c for c in _PIECE if c != "piece")), join, f"conv_id {kinds['conv_id']}, illegal long, cost long, audit string")


# Applying the edits.

def _edited(audit: str, rows):
    """(edit, role, text) of the repaired conversation, row by row; ``rows`` gives (role, text) in order."""
    state = 0
    for edit in audit:
        role, text = next(rows) if edit != "I" else (None, "")
        if edit == "D":
            continue
        if edit == "K":
            state = _AFTER[state][role[:1]]
        else:
            state = _DUE[state]
            role = ("user", "assistant")[state - 2]
        yield edit, role, text


def _apply(rows: DataFrame, audited: DataFrame, work, names: list[str], types: list[pa.DataType], ddl: str) -> DataFrame:
    """``work(audited columns, repaired rows)`` of each conversation; its texts stream by in order, none is held."""
    what = F.struct(*(c for c in audited.columns if c != "conv_id"))
    slim = _slim(rows)
    texts = slim.withColumn("head", F.lit(None).cast(audited.select(what.alias("head")).schema["head"].dataType))
    heads = audited.select("conv_id", *(F.lit(None).cast(slim.schema[c].dataType).alias(c) for c in slim.columns[1:]), what.alias("head"))
    by = [_order()[0], F.col("head").isNull(), *_order()[1:]]  # a conversation's audit comes before its rows
    stream = heads.unionByName(texts).repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*by).select("conv_id", "role", "text", "head")

    def run(batches):
        schema, all_rows = _rows(batches)

        def each():
            for conv, group in itertools.groupby(all_rows, key=lambda row: row[0]):
                head = next(group)[3]
                for row in work(head, _edited(head["audit"], ((role, text) for _, role, text, _ in group))):
                    yield conv, *row

        if schema is not None:
            yield from _batched(each(), ["conv_id", *names], [schema.field(0).type, *types])

    return map_batches(stream, run, f"conv_id {slim.schema['conv_id'].dataType.simpleString()}, {ddl}")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _audited(rows: DataFrame, piece: int) -> DataFrame:
    marked = materialise(mark(rows), "marked")
    found = faults(marked).withColumnRenamed("conv_id", "of")
    return materialise(audits(marked, piece).join(found, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of").select("conv_id", *_COUNTS, "audit"), "audits")


def repair(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation in
    ``rows`` (conv_id, turn, role, text)."""
    names = [*_COUNTS, "audit", "repaired_sha256"]

    def digest(head, edited):
        whole = hashlib.sha256()
        for n, (_, role, text) in enumerate(edited):
            whole.update(f"{chr(10) if n else ''}{role}:{text}".encode())
        yield *head.values(), whole.hexdigest()

    return _apply(rows, _audited(rows, piece), digest, names, [pa.int64()] * len(_COUNTS) + [pa.string()] * 2,
                  ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string")


def repaired_turns(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations, row by row."""
    return _apply(rows, _audited(rows, piece), lambda head, edited: ((n, *row) for n, row in enumerate(edited)), ["place", "edit", "role", "text"],
                  [pa.int64(), pa.string(), pa.string(), pa.string()], "place long, edit string, role string, text string")


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` with nulls in role and text as one space, of which one in twenty each is dropped, emptied, left without
    ends of sentences, repeated or given to the user, by the CRC-32 of ``conv_id:turn``."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(_text("text"), ".!?", "")).otherwise(_text("text"))
    return rows.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(_text("role")).alias("role"), text.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = repair(damage(rows)).withColumnRenamed("conv_id", "of")
    joined = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
