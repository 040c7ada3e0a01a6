"""WARC archives in Zstandard: a shared dictionary first, then one frame a record.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; every record is a Zstandard frame of its own, so that a record can
be read without those before it. The reader takes the dictionary from that
frame, decodes frame after frame and checks each record's version line, its
headers, the length of its block and, for full payloads, the digest.

Records whose payloads are equal and of at least ``min_dedup_bytes`` bytes are
stored once: the row with the largest id is the response, the others become
revisits that hold the HTTP head alone, whose Content-Length and digest are
still those of the full payload.

Defined cases: a null payload is an empty one; a null URL has no target header;
a null id sorts below all others and is written as ``null``; repeated rows with
the largest id of their group are the same page, and each is a response; an
empty table gives no archive and an empty result; a record that fails a check
comes back with its ``error`` and nulls for what could not be read, and reading
goes on with the next frame; a payload is never held while it is read, so
records may have any length; other columns are neither read nor returned.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm import files, scratch

DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Compressed bytes that are decoded at once, and bytes that a header block may have.
PIECE, MAX_HEAD = 16 << 10, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MANIFEST = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])
RECORDS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("error", pa.string()),
])


class BadRecord(ValueError):
    pass


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str) -> str:
    """No control characters or spaces, which would end a header."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, date: str) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if is_revisit else head + payload
    name = "null" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if is_revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _headers(head: bytes, first: str) -> dict[str, str]:
    """Fields of a header block; the first line must start with ``first``."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith(first):
        raise BadRecord(f"the first line is not {first}: {lines[0][:40]}")
    fields = {}
    for line in lines[1:]:
        name, mark, value = line.partition(":")
        if not mark or not name or name != name.strip():
            raise BadRecord(f"not a header field: {line[:40]}")
        if fields.setdefault(name.lower(), value.strip()) != value.strip():
            raise BadRecord(f"{name} occurs twice")
    return fields


def _length(fields: dict[str, str]) -> int:
    text = fields.get("content-length", "")
    if not (text.isascii() and text.isdigit()):
        raise BadRecord(f"Content-Length is missing or no number: {text[:20]}")
    return int(text)


def _page(urn: str) -> int | None:
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise BadRecord(f"not a page's record id: {urn[:40]}")
    name = urn[len("<urn:page:") : -1]
    try:
        return None if name == "null" else int(name)
    except ValueError:
        raise BadRecord(f"not a page's record id: {urn[:40]}") from None


class Parser:
    """One record, fed in pieces; of the payload only its length and digest are kept."""

    def __init__(self):
        self.head, self.fields, self.http = b"", None, None
        self.after, self.end, self.size, self.sha = 0, b"", 0, hashlib.sha1()

    def _block_head(self, first: str) -> dict[str, str] | None:
        """The header block at the start of what is held, which it is cut from; None while it does not end."""
        head, mark, rest = self.head.partition(b"\r\n\r\n")
        if not mark:
            if len(self.head) > MAX_HEAD:
                raise BadRecord(f"a header block has over {MAX_HEAD} bytes")
            return None
        self.head = rest
        return _headers(head, first)

    def feed(self, piece: bytes) -> None:
        if self.http is None:
            self.head += piece
            if self.fields is None:
                self.fields = self._block_head("WARC/1.")
                if self.fields is None:
                    return
            before = len(self.head)
            self.http = self._block_head("HTTP/")
            if self.http is None:
                return
            self.after += before - len(self.head)
            piece, self.head = self.head, b""
        self.after += len(piece)
        self.end += piece
        payload, self.end = self.end[:-4], self.end[-4:]  # the last four bytes end the record
        self.sha.update(payload)
        self.size += len(payload)

    def row(self) -> dict:
        """The record's row, once all of it was fed; raises BadRecord."""
        if self.http is None:
            raise BadRecord("the header block does not end")
        fields, kind = self.fields, self.fields.get("warc-type")
        if kind not in ("response", "revisit"):
            raise BadRecord(f"WARC-Type is {kind}")
        for name in ("warc-record-id", "warc-date", "warc-payload-digest"):
            if name not in fields:
                raise BadRecord(f"{name} is missing")
        if self.after != _length(fields) + 4 or self.end != b"\r\n\r\n":
            raise BadRecord(f"the block has {self.after - 4} bytes; Content-Length is {_length(fields)}")
        size, digest = _length(self.http), fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and self.size != size:
            raise BadRecord(f"the payload has {self.size} bytes; its Content-Length is {size}")
        if kind == "response" and base64.b32encode(self.sha.digest()).decode() != digest:
            raise BadRecord("the payload's digest differs")
        if kind == "revisit" and (self.size or fields.get("warc-profile") != PROFILE):
            raise BadRecord("a revisit holds a payload or has another profile")
        refers = _page(fields.get("warc-refers-to", "")) if kind == "revisit" else None
        return {"page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": refers, "error": None}


def parse(pieces: Iterable[bytes]) -> dict:
    """One record's row; raises BadRecord."""
    parser = Parser()
    for piece in pieces:
        parser.feed(piece)
    return parser.row()


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary


class Archive:
    """Frames of an archive, one after the other, each as an iterator of decoded pieces."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.block, self.at = blocks, b"", 0
        self.context = zstandard.ZstdDecompressor()
        start = self._take(8)
        if len(start) == 8 and struct.unpack("<I", start[:4])[0] == DICT_MAGIC:
            size = struct.unpack("<I", start[4:])[0]
            raw = self._take(size)
            if len(raw) < size:
                raise BadRecord("the dictionary frame is cut off")
            if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)  # it may itself be compressed
            self.context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        else:
            self.block, self.at = start + self.block[self.at :], 0

    def _more(self) -> bool:
        """Whether there is a byte to read."""
        while self.at >= len(self.block):
            self.block, self.at = next(self.blocks, None), 0
            if self.block is None:
                self.block, self.blocks = b"", iter(())
                return False
        return True

    def _take(self, n: int) -> bytes:
        out = []
        while n and self._more():
            out.append(self.block[self.at : self.at + n])
            self.at += len(out[-1])
            n -= len(out[-1])
        return b"".join(out)

    def _seek_frame(self) -> bool:
        """Go on to the next four bytes that start a frame."""
        magic, tail = struct.pack("<I", FRAME_MAGIC), b""
        while self._more():
            here = tail + self.block[self.at :]
            found = here.find(magic)
            if found >= 0:
                self.block, self.at = here[found:], 0
                return True
            tail, self.at = here[-3:], len(self.block)
        return False

    def frame(self) -> Iterator[bytes]:
        """Decoded pieces of the frame that starts here; after an error the next frame's start is sought."""
        frame, first = self.context.decompressobj(), True
        try:
            while not frame.eof:
                if not self._more():
                    raise BadRecord("the last frame is cut off")
                piece = self.block[self.at : self.at + PIECE]
                out = frame.decompress(piece)
                self.at += len(piece) - len(frame.unused_data)
                first = False
                yield out
        except zstandard.ZstdError as e:
            if first:
                self._take(4)  # this frame's own start
            self._seek_frame()
            raise BadRecord(f"not a readable frame: {e}") from None

    def records(self) -> Iterator[dict | BadRecord]:
        """Each record's row, or what is wrong with it."""
        while self._more():
            pieces, parser, wrong = self.frame(), Parser(), None
            try:
                for piece in pieces:
                    try:
                        if wrong is None:
                            parser.feed(piece)
                    except BadRecord as e:  # the rest of the frame is passed over
                        wrong = e
                yield wrong or parser.row()
            except BadRecord as e:
                yield wrong or e


def train(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A dictionary of the samples; of too few or too small ones none can be trained and it is empty."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _sample(pages: DataFrame, id_col: str, payload_col: str, rows: int, longest: int) -> list[bytes]:
    """About ``rows`` payloads less those of over ``longest`` bytes, the same in each run."""
    some = scratch.sampled(pages.select(id_col, payload_col), rows, id_col, payload_col)
    return sorted(r[0].encode() for r in some.where(F.octet_length(payload_col).between(1, longest)).select(payload_col).collect())


def payload_digest(payload) -> object:
    """Bare upper-case base32 of the SHA-1, by built-in functions."""
    digits = F.sha1(payload.cast("binary"))
    parts = [F.conv(F.substring(digits, 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    return F.concat(*[F.substr(F.lit(BASE32), F.shiftright(p, s).bitwiseAND(31) + 1, F.lit(1)) for p in parts for s in (15, 10, 5, 0)])


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_dedup_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", sample_rows: int = 200, sample_bytes: int = 64 << 10, roll_bytes: int = 32 << 20) -> DataFrame:
    """Write one record a row and return the archives' table (path, n_records, n_bytes).

    The dictionary is trained on about ``sample_rows`` payloads. Groups of
    equal payloads are found from digests alone; only groups of two rows or
    more are joined with the pages again, and Spark broadcasts them only while
    they are under its own threshold.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(payload_col), F.lit("")).alias("_payload"))
    dictionary = train(_sample(pages, id_col, payload_col, sample_rows, sample_bytes))

    keyed = rows.withColumn("_digest", F.unhex(F.sha1(F.col("_payload").cast("binary"))))
    groups = keyed.where(F.octet_length("_payload") >= min_dedup_bytes).groupBy("_digest").agg(F.max("_id").alias("_first"), F.count("*").alias("_n"))
    groups = scratch.stored(groups.where("_n > 1 and _first is not null").drop("_n"), "warc-groups")
    ready = keyed.join(groups, "_digest", "left").select("_id", "_url", "_payload", "_first")

    def put(batches):
        part, seq = TaskContext.get().partitionId(), 0
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)
        start = dictionary_frame(dictionary) if dictionary else b""
        held, n, size = [start], 0, len(start)

        def close():
            path = files.part_name(folder, part, seq, ".warc.zst")
            files.write(path, b"".join(held))
            return files.table({"path": [path], "n_records": [n], "n_bytes": [size]}, MANIFEST)

        for page_id, url, payload, first in files.column(batches, "_id", "_url", "_payload", "_first"):
            frame = packer.compress(record(page_id, url, payload.encode(), first, first is not None and page_id != first, date))
            held.append(frame)
            n, size = n + 1, size + len(frame)
            if size >= roll_bytes:
                yield close()
                seq, held, n, size = seq + 1, [start], 0, len(start)
        if n:
            yield close()

    scratch.make_dirs(spark, folder)
    return scratch.stored(ready.mapInArrow(put, "path string, n_records long, n_bytes long"), "warc-manifest")


def read_archives(archives: DataFrame, path_col: str = "path") -> DataFrame:
    """A row for each record of the archives at ``path_col``; tasks stream the files themselves."""
    n = max(1, min(10_000, archives.count()))

    def get(batches):
        for (path,) in files.column(batches, path_col):
            out = []
            try:
                for r in Archive(files.blocks(path)).records():
                    out.append(r if isinstance(r, dict) else dict.fromkeys(RECORDS.names) | {"error": f"{path}: {r}"})
                    if len(out) == 5000:
                        yield pa.RecordBatch.from_pylist(out, RECORDS)
                        out = []
            except BadRecord as e:  # the dictionary
                out.append(dict.fromkeys(RECORDS.names) | {"error": f"{path}: {e}"})
            yield pa.RecordBatch.from_pylist(out, RECORDS)

    return archives.select(path_col).repartitionByRange(n, path_col).mapInArrow(get, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, error string")


def op2_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = write_archives(pages, scratch.path(spark, "warc"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


OP2_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), keyed AS (
  SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex,
    max(page_id) OVER (PARTITION BY payload) AS first_id
  FROM payloads
), digits AS (
  SELECT page_id, payload_bytes, first_id,
    list_transform(range(8), lambda g: ('0x' || substr(hex, 5 * g + 1, 5))::INT) AS parts
  FROM keyed
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(parts, lambda v:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31) + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to,
  CAST(NULL AS VARCHAR) AS error
FROM digits
"""
