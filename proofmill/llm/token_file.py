"""Token ids in binary files: one frame a document, all with one trained dictionary.

A file holds a magic, a JSON header (id width, end id, SHA-256 of the
dictionary, documents and ids), a Zstandard frame for each document's serialized
ids, the index (document ids with a validity byte, offset, frame length and
number of ids of each frame) and a footer that says where the index starts. The
dictionary, trained on the serialized ids of a bounded sample, stands beside the
files under its hash; a reader refuses another one. One document is read with
the footer, the index and its own frame.

Documents are range-sorted by id, so that files follow one another in the order
of ids; the ids before a document are its file's total before it, from prefix
sums over the files, plus those before it in the file.

Defined cases: a null or empty text has the end id alone; a null document id
sorts first; repeated rows are written as often as they occur; an empty table
gives no file and an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm import files, scratch

MAGIC = b"PMTOKEN1"
MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
#: Pieces of text whose ids a task keeps; others are encoded each time.
MEMO_PIECES = 1_200_000
#: Texts whose unseen pieces are encoded together.
TEXTS_AT_ONCE = 400


class Encoder:
    """Serialized ids of texts, by the tokenizers library.

    Its byte-level pre-tokenizer starts a piece at a space before a character
    that is no blank, and takes a line end between two such characters alone. A
    text whose blanks all stand so is cut there and the pieces' ids are kept.
    Every other text, and one that may hold a special token, is encoded as it is.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        vocabulary = self.tokenizer.get_vocab()
        self.width = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        self.memo: dict[str, bytes | None] = {}  # None: a blank that may join its neighbours
        self.led = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that start with a space (byte-level: U+0120)
        self.led[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.width).tobytes()

    def _fresh(self, pieces: list[str]) -> dict[str, bytes | None]:
        """Ids of the pieces, encoded together: each starts with a space, or else stands alone in a line."""
        out: dict[str, bytes | None] = {}
        spaced, lines = [], []
        for p in pieces:
            word = p[1:] if p[:1] == " " else p
            if word and word == word.strip():
                (spaced if p[0] == " " else lines).append(p)
            else:
                out[p] = self.whole(p) if p == "\n" else None
        if spaced:
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(spaced)], add_special_tokens=False)[0].ids, self.width)
            out |= self._cut(spaced, ids, np.flatnonzero(self.led[ids]))
        if lines:
            ids = np.array(self.tokenizer.encode_batch_fast(["".join("\n" + x for x in lines)], add_special_tokens=False)[0].ids, self.width)
            end = np.frombuffer(self.whole("\n"), self.width)[0]
            at = np.flatnonzero(ids == end)
            keep = np.ones(len(ids), bool)
            keep[at] = False
            out |= self._cut(lines, ids[keep], at - np.arange(len(at)))
        return out

    def _cut(self, pieces: list[str], ids: np.ndarray, at: np.ndarray) -> dict[str, bytes]:
        if len(at) != len(pieces):  # then this vocabulary cuts in another way
            return {p: self.whole(p) for p in pieces}
        data, w = ids.tobytes(), ids.itemsize
        ends = [*at.tolist(), len(ids)]
        return {p: data[a * w : e * w] for p, a, e in zip(pieces, ends, ends[1:], strict=False)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Serialized ids of each text; unseen pieces of all of them are encoded at once."""
        cut: list[list[str] | None] = []
        for text in texts:
            pieces = None
            if self.cuts and text and "\0" not in text and not any(t in text for t in self.special):
                pieces = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
                if pieces[-1] == "":
                    pieces.pop()  # after a line end
            cut.append(pieces)
        memo = self.memo
        fresh = self._fresh(list(set().union(*[p for p in cut if p]).difference(memo)))
        memo |= fresh
        out = []
        for text, pieces in zip(texts, cut, strict=True):
            try:
                out.append(b"".join([memo[p] for p in pieces]) if pieces else self.whole(text))
            except TypeError:  # one of them is None
                out.append(self.whole(text))
        if len(memo) > MEMO_PIECES:
            for p in fresh:
                del memo[p]
        return out


class Writer:
    """One file, held until it is full."""

    def __init__(self, dictionary: bytes, width: str, end_id: int, level: int = 1):
        self.packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=level)
        self.hash, self.width, self.end = hashlib.sha256(dictionary).hexdigest(), width, np.array([end_id], width).tobytes()
        self.end_id = end_id
        self.clear()

    def clear(self) -> None:
        self.frames, self.ids, self.lengths, self.counts, self.size = [], [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        raw = ids + self.end
        frame = self.packer.compress(raw)
        self.frames.append(frame)
        self.ids.append(doc_id)
        self.lengths.append(len(frame))
        self.counts.append(len(raw) // len(self.end))
        self.size += len(frame)

    def data(self) -> bytes:
        head = json.dumps({"ids": self.width, "end_id": self.end_id, "dictionary_sha256": self.hash, "n_docs": len(self.ids), "n_tokens": sum(self.counts)}).encode()
        start = len(MAGIC) + 4 + len(head)
        offsets = start + np.concatenate([[0], np.cumsum(self.lengths)])
        index = [
            np.array([x is not None for x in self.ids], "u1").tobytes(),
            np.array([x or 0 for x in self.ids], "<i8").tobytes(),
            offsets[:-1].astype("<u8").tobytes(),
            np.array(self.lengths, "<u4").tobytes(),
            np.array(self.counts, "<u8").tobytes(),
        ]
        foot = np.array([offsets[-1], len(self.ids)], "<u8").tobytes() + MAGIC
        return b"".join([MAGIC, np.array([len(head)], "<u4").tobytes(), head, *self.frames, *index, foot])


class Reader:
    """Documents of one file; raises ValueError where the file, its index or the dictionary is not right."""

    def __init__(self, data: bytes, dictionary: bytes):
        if data[:8] != MAGIC or data[-8:] != MAGIC or len(data) < 36:
            raise ValueError("not a token file, or cut off")
        n = int(np.frombuffer(data[8:12], "<u4")[0])
        self.head = json.loads(data[12 : 12 + n])
        if self.head["dictionary_sha256"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError("the file was written with another dictionary")
        at, count = map(int, np.frombuffer(data[-24:-8], "<u8"))
        if count != self.head["n_docs"] or len(data) != at + 29 * count + 24:
            raise ValueError("the index does not have the header's number of documents")
        fields = []
        for kind in ("u1", "<i8", "<u8", "<u4", "<u8"):
            size = count * np.dtype(kind).itemsize
            fields.append(np.frombuffer(data[at : at + size], kind))
            at += size
        valid, ids, self.offsets, self.lengths, self.counts = fields
        self.ids = [int(i) if v else None for i, v in zip(ids, valid, strict=True)]
        self.data, self.unpacker = data, zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def tokens(self, i: int) -> np.ndarray:
        frame = self.data[int(self.offsets[i]) : int(self.offsets[i]) + int(self.lengths[i])]
        ids = np.frombuffer(self.unpacker.decompress(frame), self.head["ids"])
        if len(ids) != self.counts[i] or ids[-1] != self.head["end_id"]:
            raise ValueError(f"document {self.ids[i]} does not have the index's number of ids, or no end")
        return ids.astype("<u4")


def read_document(path: str, dictionary: bytes, doc_id: int | None) -> np.ndarray | None:
    """One document's ids from the footer, the index and its frame alone; None where it is not in the file. A null id finds the first document without one."""
    store, at = files.store_of(path)
    size = store.get_file_info(at).size
    start, n = map(int, np.frombuffer(files.read(path, size - 24, 16), "<u8"))
    index = files.read(path, start, 29 * n)
    n_head = int(np.frombuffer(files.read(path, 8, 4), "<u4")[0])
    head = json.loads(files.read(path, 12, n_head))
    if head["dictionary_sha256"] != hashlib.sha256(dictionary).hexdigest():
        raise ValueError("the file was written with another dictionary")
    found = np.flatnonzero((np.frombuffer(index[n : 9 * n], "<i8") == (doc_id or 0)) & (np.frombuffer(index[:n], "u1") == (doc_id is not None)))
    if not len(found):
        return None
    i = found[0]
    offset, length = np.frombuffer(index[9 * n : 17 * n], "<u8")[i], np.frombuffer(index[17 * n : 21 * n], "<u4")[i]
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    return np.frombuffer(unpacker.decompress(files.read(path, int(offset), int(length))), head["ids"]).astype("<u4")


def _sample(rows: DataFrame, tokenizer: str, n: int, longest: int) -> list[bytes]:
    """Serialized ids of about ``n`` texts less those of over ``longest`` bytes, the same in each run."""
    some = scratch.sampled(rows, n, "id", "text").where(F.octet_length("text").between(1, longest))
    return Encoder(tokenizer).encode(sorted(r.text for r in some.select("text").collect()))


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 400, sample_bytes: int = 32 << 10, dictionary_bytes: int = 64 << 10, roll_bytes: int = 32 << 20) -> tuple[DataFrame, bytes]:
    """Write the files and return their table (part, seq, path, n_docs, n_tokens), which is in order of ids, and the dictionary."""
    from proofmill.llm.warc import train

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dictionary = train(_sample(rows, tokenizer, sample_docs, sample_bytes), dictionary_bytes)
    scratch.make_dirs(spark, folder)
    files.write(f"{folder}/{hashlib.sha256(dictionary).hexdigest()}.zdict", dictionary)

    def put(batches):
        encoder, part, seq = Encoder(tokenizer), TaskContext.get().partitionId(), 0
        writer = Writer(dictionary, encoder.width, end_id)

        def close():
            path = files.part_name(folder, part, seq, ".tok")
            files.write(path, writer.data())
            out = files.table({"part": [part], "seq": [seq], "path": [path], "n_docs": [len(writer.ids)], "n_tokens": [sum(writer.counts)]}, MANIFEST)
            writer.clear()
            return out

        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(i, TEXTS_AT_ONCE)
                encoded = encoder.encode([t or "" for t in some.column("text").to_pylist()])
                for doc_id, ids in zip(some.column("id").to_pylist(), encoded, strict=True):
                    writer.add(doc_id, ids)
                if writer.size >= roll_bytes:
                    yield close()
                    seq += 1
        if writer.ids:
            yield close()

    # the hash parts rows that share an id
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").drop("tie")
    return scratch.stored(dealt.mapInArrow(put, "part int, seq int, path string, n_docs long, n_tokens long"), "token-manifest"), dictionary


def read_tokens(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Every document of the files: its start among all ids, their number and CRC-32, and the ids themselves if asked for."""
    n = max(1, min(10_000, manifest.count()))
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def get(batches):
        dictionary = {}
        for path, start in files.column(batches, "path", "start"):
            data = files.read(path)
            n_head = int(np.frombuffer(data[8:12], "<u4")[0])
            name = json.loads(data[12 : 12 + n_head])["dictionary_sha256"]
            if name not in dictionary:
                dictionary[name] = files.read(f"{folder}/{name}.zdict")
            reader = Reader(data, dictionary[name])
            starts = start + np.concatenate([[0], np.cumsum(reader.counts.astype(np.int64))])
            step = 200 if with_ids else 5000
            for i in range(0, len(reader.ids), step):
                some = range(i, min(i + step, len(reader.ids)))
                ids = [reader.tokens(k) for k in some]
                columns = [pa.array(reader.ids[some.start : some.stop], pa.int64()), pa.array(starts[some.start : some.stop]), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return placed.select("path", "start").repartitionByRange(n, "path").mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_table(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write all documents' ids and read the files back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    folder = scratch.path(docs.sparkSession, "tokens")
    manifest, _ = write_tokens(docs, folder, str(tokenizer), end_id)
    return read_tokens(manifest, folder)


def op10_token_file(spark, sf_dir: str) -> DataFrame:
    return token_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
