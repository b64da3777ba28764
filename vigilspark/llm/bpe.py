"""Byte-level BPE by backtracking over longest matches.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary (built
by pyahocorasick) finds the longest token at every position in one pass.  The encoder takes longest
matches from the left; a token may follow another only if byte-pair merging would leave that pair
apart (memoised), else the next shorter prefix token is tried, and with none left the last token is
taken back.  Every position is left at most once for each token that ends there, so time is linear
in the text, also for a word of a million letters, and the ids are those of exact rank-ordered merges.

Null texts are empty and have no tokens; empty texts have no tokens.
"""

from __future__ import annotations

import base64
import contextlib
import functools
import hashlib
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .shared import column_name, extended, map_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Encoded words, and token pairs, that a worker keeps.  Words are kept in two generations: when the younger one is full
#: it replaces the older.  All stores are emptied when a task ends; what is forgotten only costs time.
WORDS, PAIRS = 120_000, 200_000
STORED_BYTES = 64


class Codec:
    """Encoder and decoder for one rank table (token bytes -> id, lower ids merge first)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.split = self.pattern.findall
        size = max(self.tokens) + 1
        self.table = [self.tokens.get(i, b"") for i in range(size)]
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.lengths = [len(t) for t in self.table]
        self.widths = np.array(self.lengths, dtype=np.int64)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._apart: dict[tuple[int, int], bool] = {}
        self._known: dict[int, bool] = {}
        self._store: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self.prefixes = [self._shorter(i) for i in range(size)]
        self.reached = [bool(t) and self.merged(i) for i, t in enumerate(self.table)]

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 without any."""
        text = self.table[token]
        return next((self.ranks[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ranks), -1)

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; None for one that no merge gives."""
        if token not in self._halves:
            text = self.table[token]
            found = None
            for cut in range(1, len(text)):
                left, right = self.ranks.get(text[:cut]), self.ranks.get(text[cut:])
                if left is not None and right is not None and left < token and right < token:
                    if self.merged(left) and self.merged(right) and self.apart(left, right, below=token):
                        found = left, right
                        break
            self._halves[token] = found
        return self._halves[token]

    def merged(self, token: int) -> bool:
        """Whether merging can reach the token."""
        return len(self.table[token]) == 1 or self.halves(token) is not None

    def apart(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether merging the two tokens' bytes leaves them side by side.

        ``below`` counts only merges of lower rank, as when the pair itself is about to merge."""
        key = (left, right) if below is None else (left, right, below)
        found = self._apart.get(key)
        if found is None:
            if len(self._apart) >= PAIRS:
                self._apart.clear()
            found = self._apart[key] = self._stay_apart(left, right, below)
        return found

    def _stay_apart(self, left: int, right: int, below: int | None) -> bool:
        # Undo merges from the latest on; a merge over the border that came earlier than the merge
        # just undone would have happened first.  On equal ranks the leftmost merge comes first.
        limit = len(self.table) if below is None else below
        while True:
            over = self.ranks.get(self.table[left] + self.table[right])
            if over is not None and over < limit:
                return False
            undo_left = left > right
            for _ in range(2):
                parts = self.halves(left if undo_left else right) if len(self.table[left if undo_left else right]) > 1 else None
                if parts is not None:
                    break
                undo_left = not undo_left
            else:
                return True
            if undo_left:
                limit, left = min(limit, left), parts[1]
            else:
                limit, right = min(limit, right + 1), parts[0]

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n, widths, shorter, reached, known = len(data), self.lengths, self.prefixes, self.reached, self._known
        longest = [0] * n
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - widths[token]] = token  # later ends are longer
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < n:
            while token >= 0:
                end = at + widths[token]
                if open_at[end]:
                    if last < 0:
                        fits = reached[token]
                    else:
                        key = last << 32 | token
                        fits = known.get(key)
                        if fits is None:
                            if len(known) >= PAIRS:
                                known.clear()
                            fits = known[key] = reached[token] and self._stay_apart(last, token, None)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = end, token
                if at < n:
                    token = longest[at]
            else:
                open_at[at] = 0
                token = out.pop()
                at -= widths[token]
                last = out[-1] if out else -1
                token = shorter[token]
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text as unsigned 32-bit integers."""
        words = self.split(text)
        parts = [*map(self._store.get, words)]
        if None in parts:
            parts = [self._word(word) if part is None else part for word, part in zip(words, parts)]
        return np.frombuffer(b"".join(parts), dtype="<u4")

    def _word(self, word: str) -> bytes:
        found = self._store.get(word) or self._older.get(word)
        if found is None:
            ids = self.encode_bytes(word.encode("utf-8"))
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= STORED_BYTES:
            if len(self._store) >= WORDS:
                self._older, self._store = self._store, {}
            self._store[word] = found
        return found

    def forget(self) -> None:
        """Empty the stores."""
        for store in (self._store, self._older, self._known, self._apart):
            store.clear()

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join([*map(self.table.__getitem__, ids.tolist())])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def default_vocabulary() -> tuple[str, str]:
    """Path and split pattern of the default public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


@functools.lru_cache(maxsize=2)
def codec(path_bytes: bytes, pattern: str) -> Codec:
    return Codec({base64.b64decode(t): int(r) for t, r in (line.split() for line in path_bytes.splitlines())}, pattern)


def shared_codec(spark: SparkSession, path: str | None = None, pattern: str | None = None):
    """A context that gives a task its worker's codec, and empties the codec's stores at the end.  The driver
    reads the vocabulary file, whose size doesn't grow with the data (checked: 64 MB at most), and broadcasts it."""
    standard = default_vocabulary() if path is None or pattern is None else (None, None)
    with open(path or standard[0], "rb") as f:
        raw = f.read((64 << 20) + 1)
    if len(raw) > 64 << 20:
        raise ValueError("the vocabulary file exceeds 64 MB")
    held, split = spark.sparkContext.broadcast(raw), pattern or standard[1]

    @contextlib.contextmanager
    def lent():
        bpe = codec(held.value, split)
        try:
            yield bpe
        finally:
            bpe.forget()

    return lent


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with ids (array of int), n_tokens and decoded (binary) for each row."""
    get = shared_codec(docs.sparkSession, path, pattern)
    ids, count, decoded = (column_name(docs, c) for c in ("ids", "n_tokens", "decoded"))
    schema = extended(docs, (ids, "array<int>"), (count, "long"), (decoded, "binary"))

    def encode(batches):
        with get() as bpe:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                coded = [bpe.encode(t or "") for t in texts]
                sizes = np.array([len(c) for c in coded], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.concatenate(coded).astype(np.int32) if coded else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(sizes), pa.array([bpe.decode(c) for c in coded], pa.binary())],
                    names=[f.name for f in schema])

    return map_batches(docs, encode, schema)


def token_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the ids stay in the task."""
    get = shared_codec(docs.sparkSession, path, pattern)

    def digest(batches):
        with get() as bpe:
            for batch in batches:
                count, ids, decoded = [], [], []
                for text in batch.column(1).to_pylist():
                    coded = bpe.encode(text or "")
                    count.append(len(coded))
                    ids.append(hashlib.sha256(coded).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(coded)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", "text"), digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
