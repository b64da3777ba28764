"""Batches of whole texts as one byte buffer, for vectorised work inside Spark tasks.

A :class:`Block` holds the UTF-8 bytes of a few hundred documents back to back, with their
offsets.  Every helper is linear in the bytes of the block and never looks across a document's
end.  Nulls count as empty texts.  Blocks are cut at ``MAX_BYTES`` (one longer text is a block
of its own), which bounds a task's memory by the longest single text.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_BYTES = 1 << 18
MAX_DOCS = 512
U64 = np.uint64
_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)

#: The word separators of all contracts: space and \t \n \v \f \r.
SEPARATORS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@functools.lru_cache(maxsize=4)
def _byte_codes(fold: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
    if fold:
        codes[ord("A"):ord("Z") + 1] = codes[ord("a"):ord("z") + 1]
    return codes


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; those for a usual block are kept for the next one."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, MAX_BYTES + (1 << 16)), base, dtype=U64)
        have[0] = 1
        have = np.cumprod(have)
        if n <= MAX_BYTES + (1 << 16):
            _POWERS[base] = have
    return have[:n]


@functools.lru_cache(maxsize=1)
def _is_word_byte() -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(SEPARATORS)] = False
    return table


class Block:
    """``n`` texts: ``data`` (uint8), ``off`` (n + 1 offsets), ``null`` (which were null)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, null: np.ndarray | None = None):
        self.data, self.off, self.n = data, off, len(off) - 1
        self.null = np.zeros(self.n, dtype=bool) if null is None else null

    @classmethod
    def of(cls, texts: pa.Array) -> "Block":
        null = np.asarray(texts.is_null())
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset)
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        return cls(raw[off[0]:off[-1]], off - off[0], null)

    @functools.cached_property
    def lengths(self) -> np.ndarray:
        return np.diff(self.off)

    def doc_of(self, counts: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(self.n), counts)

    def prefix_hash(self, fold: bool = False) -> np.ndarray:
        """h with h[j] - h[i] = the polynomial of bytes i..j-1, times a power for i."""
        out = np.zeros(len(self.data) + 1, dtype=U64)
        np.cumsum(_byte_codes(fold)[self.data] * _powers(_MUL, len(self.data)), out=out[1:])
        return out

    def span_hash(self, start: np.ndarray, end: np.ndarray, fold: bool = False, prefix: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of byte spans; equal spans have equal hashes wherever they stand."""
        h = self.prefix_hash(fold) if prefix is None else prefix
        return mix((h[end] - h[start]) * _powers(_INV, len(self.data) + 1)[start])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every word ``[^\\x20\\x09-\\x0D]+``, in order."""
        word = _is_word_byte()[self.data]
        before = np.empty_like(word)
        before[1:] = word[:-1]
        after = np.empty_like(word)
        after[:-1] = word[1:]
        if len(word):
            before[0] = after[-1] = False
            inner = self.off[1:-1]
            before[inner[inner < len(word)]] = False
            after[inner[inner > 0] - 1] = False
        start = np.flatnonzero(word & ~before)
        end = np.flatnonzero(word & ~after) + 1
        return start, end, np.searchsorted(self.off, start, side="right") - 1


def blocks(batches, column: str = "text", max_bytes: int = MAX_BYTES, max_docs: int = MAX_DOCS):
    """(rows, Block of ``column``) over Arrow batches, cut to the limits; no row is lost."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        lengths = np.asarray(pc.binary_length(batch.column(at)).fill_null(0), dtype=np.int64)
        total = np.cumsum(lengths)
        i = 0
        while i < batch.num_rows:
            base = total[i - 1] if i else 0
            j = min(max(i + 1, int(np.searchsorted(total, base + max_bytes, side="right"))), i + max_docs, batch.num_rows)
            rows = batch.slice(i, j - i)
            yield rows, Block.of(rows.column(at))
            i = j


def ngram_hashes(words: np.ndarray, first: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index and hash of every full window of n words; ``first`` has each document's first word."""
    at = np.flatnonzero(np.arange(len(words)) + n <= first[doc + 1])
    return at, chain(words, at, n)


def chain(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(at), n, dtype=U64)
    for k in range(n):
        h = mix(h * U64(_MUL) + words[at + k])
    return h


def complete_groups(batches, key: list[str]):
    """Tables of whole groups from batches sorted by ``key``; only the last group is held back.

    What is held is at most one group and one batch, so callers keep groups bounded upstream.
    """
    held: list[pa.RecordBatch] = []

    def values(batch, row):
        return tuple(batch.column(batch.schema.get_field_index(k))[row].as_py() for k in key)

    for batch in batches:
        if not batch.num_rows:
            continue
        last = values(batch, batch.num_rows - 1)
        if held and values(held[-1], held[-1].num_rows - 1) == last:
            held.append(batch)
            continue
        lo, hi = 0, batch.num_rows - 1  # first row of the last group
        while lo < hi:
            mid = (lo + hi) // 2
            if values(batch, mid) == last:
                hi = mid
            else:
                lo = mid + 1
        table = pa.Table.from_batches([*held, batch.slice(0, lo)]) if held or lo else None
        if table is not None and table.num_rows:
            yield table.combine_chunks()
        held = [batch.slice(lo)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for the edges a-b of one task."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = np.minimum(new, new[new])
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new
