"""WARC archives in Zstandard: one frame a record, and a dictionary in the leading skippable frame.

The writer makes real ``.warc.zst`` bytes: a skippable frame (magic 0x184D2A5D) with the dictionary, then
one frame for each record, in part files written by Spark itself, so archives can lie in any store that
Spark writes to.  (The text writer puts its separator after each value: an empty skippable frame, which
is plain ASCII and which every reader skips.)  The reader takes files through Spark's binaryFile source,
loads the dictionary, decodes frame by frame and validates each record: version line, header syntax,
required fields, Content-Length against the bytes there, block and payload digests.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest page_id is a
response, the others are revisits that refer to it and carry no payload.  Smaller payloads are always
responses.  Rows that share the smallest page_id are responses all.  A null html is an empty payload; a
null url is left out of the headers and null again when read; a null page_id never is the smallest
unless the group has no other.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_batches, prepare, shared_folder

DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame: magic 0x184D2A50 and four zero bytes of length.
SEPARATOR = b"P*M\x18\0\0\0\0"
#: The dictionary is fitted on a bounded sample: this many pages, this many bytes of each.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 8192, 64 << 10
LEVEL = 6
#: Records of one decoded batch, so that a file never is in memory decoded as a whole.
BATCH_BYTES = 4 << 20
#: An archive ends after so many frames, or as soon as it has so many bytes: readers take files whole.
ARCHIVE_FRAMES, ARCHIVE_BYTES = 20_000, 256 << 20
#: Bytes that a decoder is given first; what it leaves of them is copied, so a frame's cost doesn't grow with the file.
WINDOW = 8 << 10


class InvalidRecord(ValueError):
    """A record or an archive that breaks the format."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def build_record(kind: str, record_id: str, url: str | None, payload: bytes, digest: str, size: int, extra: list[tuple[str, str]]) -> bytes:
    """One WARC/1.1 record; ``payload`` is empty for a revisit, ``size`` and ``digest`` are the full one's."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\r\n]", lambda m: "%%%02X" % ord(m[0]), url)))
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
               ("WARC-Block-Digest", "sha1:" + sha1_base32(block)), ("WARC-Payload-Digest", "sha1:" + digest), *extra]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of one record; InvalidRecord if anything is off."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise InvalidRecord("no WARC version line or no end of header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise InvalidRecord(f"bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise InvalidRecord(f"no {name}")
    if not fields["content-length"].isdigit():
        raise InvalidRecord("Content-Length is not a number")
    size = int(fields["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise InvalidRecord(f"Content-Length {size} doesn't fit {len(rest) - 4} bytes")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha1:" + sha1_base32(block):
        raise InvalidRecord("the block's digest differs")
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    if fields["warc-type"] == "response" and "warc-payload-digest" in fields and fields["warc-payload-digest"] != "sha1:" + sha1_base32(payload):
        raise InvalidRecord("the payload's digest differs")
    return fields, payload


def read_archive(data):
    """Records of one ``.warc.zst`` file, given as anything with bytes, in order, validated; linear in the file."""
    data = view = memoryview(data)
    at, decoder = 0, zstandard.ZstdDecompressor()
    first = True
    while at < len(data):
        if len(data) - at < 4:
            raise InvalidRecord("bytes after the last frame")
        (magic,) = struct.unpack_from("<I", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if len(data) - at < 8:
                raise InvalidRecord("a skippable frame is cut off")
            (size,) = struct.unpack_from("<I", data, at + 4)
            body = view[at + 8:at + 8 + size]
            if len(body) != size:
                raise InvalidRecord("a skippable frame is cut off")
            if magic == DICTIONARY_MAGIC:
                if not first:
                    raise InvalidRecord("the dictionary frame doesn't lead")
                raw = bytes(body)
                if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
        else:
            one, parts, window = decoder.decompressobj(), [], WINDOW
            while not one.eof:
                if at >= len(data):
                    raise InvalidRecord("a frame is cut off")
                parts.append(one.decompress(view[at:at + window]))
                at, window = min(at + window, len(data)), 2 * window
            at -= len(one.unused_data)
            yield parse_record(b"".join(parts))
        first = False


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary for page records, fitted on SAMPLE_PAGES pages; b"" if there are too few."""
    rows = pages.where("html is not null").select(F.substring("html", 1, SAMPLE_BYTES)).limit(SAMPLE_PAGES).collect()
    samples = [build_record("response", str(uuid.UUID(int=i)), "http://example.org/", r[0].encode(), "A" * 32, len(r[0]), []) for i, r in enumerate(rows)]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little or too uniform to learn from
        return b""


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to archives under ``path``.

    Each archive begins with the dictionary.  Spark's writer begins a new file after ARCHIVE_FRAMES rows; one
    that reaches ARCHIVE_BYTES before is filled up with empty rows, of which only separators stay."""
    spark = prepare(pages.sparkSession)
    dictionary = spark.sparkContext.broadcast(train_dictionary(pages))
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"),
                        F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("bytes"))
    # Narrow: the smallest page_id of each payload; the pages then meet it by digest.
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    marked = rows.join(first, "digest", "left").select(
        "page_id", "url", "html", F.when((F.col("bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def encode(batches):
        held = dictionary.value
        packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(held)) if held else zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(held)) + held if held else b""
        rows, size = 0, 0  # of the file that is being written
        for batch in batches:
            frames = []
            for page_id, url, page, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                payload = page.encode("utf-8")
                digest = sha1_base32(payload)
                name = lambda i: str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{i}"))
                extra = [] if page_id is None else [("X-Page-ID", str(page_id))]
                if refers_to is not None:
                    extra += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{name(refers_to)}>"), ("X-Refers-To-Page-ID", str(refers_to))]
                extra.append(("X-Payload-Length", str(len(payload))))
                record = build_record("response" if refers_to is None else "revisit", name(page_id), url, payload if refers_to is None else b"", digest, len(payload), extra)
                if rows and size >= ARCHIVE_BYTES:
                    frames += [b""] * (ARCHIVE_FRAMES - rows)
                    rows = ARCHIVE_FRAMES
                if rows in (0, ARCHIVE_FRAMES):
                    frames.append(lead)
                    rows, size = 1, len(lead)
                frames.append(packer.compress(record))
                rows, size = rows + 1, size + len(frames[-1])
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    map_batches(marked, encode, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option(
        "lineSep", SEPARATOR.decode("ascii")).option("maxRecordsPerFile", ARCHIVE_FRAMES).text(path)


_RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Validated records of all archives under ``path``; an invalid record fails the read."""
    def decode(batches):
        rows, size = [], 0

        def flush():
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _RECORDS.split(", ")])

        for batch in batches:
            for content in batch.column(0):
                for fields, payload in read_archive(content.as_buffer()):
                    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    length = int(fields["x-payload-length"]) if "x-payload-length" in fields else len(payload)
                    if kind == "response" and length != len(payload):
                        raise InvalidRecord(f"X-Payload-Length {length} doesn't fit {len(payload)} bytes")
                    number = lambda k: int(fields[k]) if k in fields else None
                    rows.append((number("x-page-id"), fields.get("warc-target-uri"), kind, number("x-refers-to-page-id"), length, digest, payload if payloads and kind == "response" else None))
                    size += len(payload) + 200
                    if size >= BATCH_BYTES:
                        yield flush()
                        rows, size = [], 0
        if rows:
            yield flush()

    return map_batches(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content"), decode, _RECORDS)


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/vigilspark/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path, payloads=False).drop("payload")
