"""Benchmark decontamination with a positional inverted index of the training texts.

The index is cut by documents: each shard holds, for every term, the sorted
positions of that term in the shard's documents (delta-coded, in one row of a
table in the shared folder). Positions of two documents are never adjacent. With
a vocabulary the index keeps the postings of those terms alone, which is all that
a search for them needs.

A search takes the terms' frequencies over the whole index, and for each window
of test words intersects the lists of its terms, each shifted by the term's
place in the window, from the rarest term up; it ends at the first empty
intersection. Every surviving position starts an exact phrase match. Proximity
matches of a window are the occurrences of its rarest term that have each other
term within ``slop`` positions, and that are no exact matches.

Defined cases: a null or wordless text has no words and no hits; a null or
wordless item has no window; a null id stays null; repeated documents each get
their row; repeated items count once each; with no items, or no documents, no
row is hit; other columns are neither read nor returned.
"""

from __future__ import annotations

import pickle
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm import files, scratch

WINDOW = 10
#: Words that a shard holds about; its lists are what a task holds at once.
SHARD_WORDS = 500_000
#: Test words that a task holds at once, at 8 bytes; a larger test set is searched in blocks of items.
MAX_TEST_WORDS = 2_000_000
#: Upper case to lower, and everything that ends a word to a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

INDEX = pa.schema([
    ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())),
    ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("postings", pa.binary()), ("shard", pa.string()),
])
#: What a search returns of each document.
FOUND = ["doc_id", "n_words", "n_hit", "items", "near_items", "spans"]
INDEX_DDL = "doc_ids array<long>, n_words array<long>, terms array<string>, counts array<long>, postings binary, shard string"


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class ShardBuilder:
    """Postings of documents as they come."""

    def __init__(self, vocabulary: set[bytes] | None):
        self.ids = {t: i for i, t in enumerate(sorted(vocabulary))} if vocabulary is not None else {}
        self.fixed = vocabulary is not None
        self.names = sorted(vocabulary) if vocabulary is not None else []
        self.clear()

    def clear(self) -> None:
        self.doc_ids, self.n_words, self.found, self.at = [], [], [], 0
        if not self.fixed:
            self.ids, self.names = {}, []

    def add(self, doc_id: int | None, terms: list[bytes]) -> None:
        if self.fixed:
            get = self.ids.get
            own = np.fromiter((get(t, -1) for t in terms), np.int64, len(terms))
        else:
            own = np.fromiter((self.ids.setdefault(t, len(self.ids)) for t in terms), np.int64, len(terms))
        places = np.flatnonzero(own >= 0)
        self.found.append((own[places], places + self.at))
        self.doc_ids.append(doc_id)
        self.n_words.append(len(terms))
        self.at += len(terms) + 1  # so that no window runs over the end

    def batch(self) -> pa.RecordBatch:
        names = self.names if self.fixed else list(self.ids)
        ids = np.concatenate([x for x, _ in self.found]) if self.found else np.zeros(0, np.int64)
        at = np.concatenate([x for _, x in self.found]) if self.found else np.zeros(0, np.int64)
        order = np.argsort(ids, kind="stable")  # positions stay ascending within a term
        ids, at = ids[order], at[order]
        terms, first, counts = np.unique(ids, return_index=True, return_counts=True)
        steps = np.diff(at, prepend=0)
        steps[first] = at[first]
        packed = zstandard.ZstdCompressor(level=1).compress(steps.astype("<u4").tobytes())
        row = {"doc_ids": [self.doc_ids], "n_words": [self.n_words], "terms": [[names[i].decode("utf-8", "surrogatepass") for i in terms]], "counts": [counts.tolist()], "postings": [packed], "shard": [uuid.uuid4().hex]}
        self.clear()
        return files.table(row, INDEX)


def build_index(docs: DataFrame, vocabulary: set[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """Write the index to the shared folder; a row for each shard."""

    def put(batches):
        shard = ShardBuilder(vocabulary)
        for doc_id, text in files.column(batches, "id", "text"):
            shard.add(doc_id, words(text))
            if shard.at >= shard_words:
                yield shard.batch()
        if shard.doc_ids:
            yield shard.batch()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return scratch.stored(rows.mapInArrow(put, INDEX_DDL), "phrase-index")


class Query:
    """Windows of items as flat arrays: some 25 bytes a word of test text.

    ``tokens`` holds all items' words as numbers of the sorted ``terms``; window
    w is tokens[start[w] : start[w] + length[w]] and is of the items
    owners[owner_at[w] : owner_at[w + 1]], which are places in ``items``.
    """

    def __init__(self, items: list[tuple[int | None, list[bytes]]], size: int):
        self.items = [i for i, _ in items]
        self.terms = pa.array(sorted({t for _, words_ in items for t in words_}), pa.binary())
        number = {t: n for n, t in enumerate(self.terms.to_pylist())}
        lengths = np.array([len(w) for _, w in items], np.int64)
        self.tokens = np.fromiter((number[t] for _, w in items for t in w), np.int32, int(lengths.sum()))
        item = np.repeat(np.arange(len(items)), lengths)
        place = np.arange(len(item)) - (np.cumsum(lengths) - lengths)[item]
        starts = np.flatnonzero((place <= lengths[item] - size) | (place == 0))  # a short item is one window
        own, length = item[starts], np.minimum(lengths[item[starts]], size).astype(np.int32)
        runs = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.tokens, np.full(size, -1, np.int32)]), size)[starts]
        runs[np.arange(size) >= length[:, None]] = -1
        _, first, window = np.unique(runs.view(f"V{4 * size}").ravel(), return_index=True, return_inverse=True)
        self.start, self.length = starts[first].astype(np.int32), length[first]
        pairs = np.unique(window.ravel() * max(1, len(items)) + own)
        self.owners = (pairs % max(1, len(items))).astype(np.int32)
        self.owner_at = np.concatenate([[0], np.cumsum(np.bincount(pairs // max(1, len(items)), minlength=len(first)))]).astype(np.int64)
        self.counts: np.ndarray | None = None

    def numbers(self, terms: pa.Array) -> np.ndarray:
        """The test's numbers of an index row's terms, -1 for others."""
        return np.asarray(pc.index_in(terms, value_set=self.terms).fill_null(-1))


class Shared:
    """An object in the shared folder, read once by each Python worker that needs it."""

    _last: tuple[str, object] | None = None

    def __init__(self, spark, value):
        self.path = scratch.path(spark, "phrase-query")
        scratch.make_dirs(spark, scratch.folder(spark))
        files.write(self.path, zstandard.ZstdCompressor(level=1).compress(pickle.dumps(value)))

    def get(self):
        if Shared._last is None or Shared._last[0] != self.path:
            Shared._last = None
            with zstandard.ZstdDecompressor().stream_reader(files.read(self.path)) as stream:
                Shared._last = (self.path, pickle.load(stream))
        return Shared._last[1]


def frequencies(index: DataFrame, query: Query) -> np.ndarray:
    """Occurrences of the test terms over the whole index; other terms are dropped where the index is read."""
    shared = Shared(index.sparkSession, query)

    def count(batches):
        asked = shared.get()
        for batch in batches:
            for i in range(batch.num_rows):
                terms = batch.column("terms")[i].values.cast(pa.binary())
                numbers, counts = asked.numbers(terms), np.asarray(batch.column("counts")[i].values)
                keep = numbers >= 0
                yield pa.RecordBatch.from_arrays([pa.array(numbers[keep].astype(np.int64)), pa.array(counts[keep])], names=["term", "n"])

    pairs = index.select("terms", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(query.terms), np.int64)
    out[np.asarray(pairs.column("term"))] = np.asarray(pairs.column("n"))
    return out


class Shard:
    """The lists of one row of the index; ``numbers`` gives its terms those of a query, -1 for others."""

    def __init__(self, row: dict, numbers: np.ndarray | None = None):
        self.doc_ids, self.n_words = row["doc_ids"], np.asarray(row["n_words"], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.n_words + 1)])
        counts = np.asarray(row["counts"], np.int64)
        ends = np.cumsum(counts)
        names = [t.encode("utf-8", "surrogatepass") for t in row["terms"]] if numbers is None else numbers.tolist()
        self.where = {t: (e - n, e) for t, n, e in zip(names, counts.tolist(), ends.tolist(), strict=True) if t != -1}
        self.steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["postings"], max_output_size=4 * int(counts.sum()) + 1), "<u4")
        self.lists: dict = {}

    def list(self, term) -> np.ndarray:
        if term not in self.lists:
            a, e = self.where[term]
            self.lists[term] = np.cumsum(self.steps[a:e], dtype=np.int64)
        return self.lists[term]

    def exact(self, terms: list[tuple]) -> np.ndarray:
        """Starts of the window, whose terms come as (term, offset)."""
        starts = self.list(terms[0][0]) - terms[0][1]
        for term, offset in terms[1:]:
            if not len(starts):
                break
            other = self.list(term)
            at = np.searchsorted(other, starts + offset)
            at[at == len(other)] = 0
            starts = starts[other[at] == starts + offset]
        return starts

    def near(self, terms: list[tuple], slop: int) -> np.ndarray:
        """Occurrences of the rarest term that have all others near and in the same document."""
        here = self.list(terms[0][0])
        doc = np.searchsorted(self.starts, here, "right")
        low, high = np.maximum(here - slop, self.starts[doc - 1]), np.minimum(here + slop, self.starts[doc] - 1)
        for term in dict.fromkeys(t for t, _ in terms[1:]):
            other = self.list(term)
            keep = np.searchsorted(other, low) < np.searchsorted(other, high, "right")
            here, low, high = here[keep], low[keep], high[keep]
            if not len(here):
                break
        return here

    def candidates(self, query: Query) -> np.ndarray:
        """Windows all of whose terms this shard has."""
        held = np.zeros(len(query.terms) + 1, bool)
        held[list(self.where)] = True
        absent = np.concatenate([[0], np.cumsum(~held[query.tokens])])
        return np.flatnonzero(absent[query.start + query.length] == absent[query.start])


def _by_name(items: Iterable) -> list:
    """Item ids as strings sort, a null one as None."""
    return sorted(set(items), key=str)


def search(index: DataFrame, items: list[tuple[int | None, list[bytes]]], size: int = WINDOW, slop: int | None = 20, placed: bool = False) -> DataFrame:
    """A row for each document: n_words, n_hit, the items whose windows occur, those with a window only near (unless ``slop`` is None), and the hit spans.

    With ``placed`` also its shard and its place there, which tell rows apart whatever their ids.
    """
    query = Query(items, size)
    query.counts = frequencies(index, query)
    shared = Shared(index.sparkSession, query)

    def find(batches):
        asked = shared.get()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: np.asarray(batch.column(n)[i].values) for n in ("n_words", "counts")}
                row |= {"doc_ids": batch.column("doc_ids")[i].values, "postings": batch.column("postings")[i].as_py()}
                shard = Shard(row, asked.numbers(batch.column("terms")[i].values.cast(pa.binary())))
                hit, found, close = np.zeros(shard.starts[-1] + 1, np.int64), defaultdict(set), defaultdict(set)
                for w in shard.candidates(asked).tolist():
                    first, n = int(asked.start[w]), int(asked.length[w])
                    tokens = asked.tokens[first : first + n]
                    order = np.lexsort((np.arange(n), tokens, asked.counts[tokens]))  # from the rarest up
                    terms = [(int(tokens[k]), int(k)) for k in order]
                    starts = shard.exact(terms)
                    own = asked.owners[asked.owner_at[w] : asked.owner_at[w + 1]].tolist()
                    if len(starts):
                        np.add.at(hit, starts, 1)
                        np.add.at(hit, starts + n, -1)
                        for d in np.unique(np.searchsorted(shard.starts, starts, "right") - 1):
                            found[d].update(own)
                    if slop is not None:
                        for d in np.unique(np.searchsorted(shard.starts, shard.near(terms, slop), "right") - 1):
                            close[d].update(own)
                inside = np.cumsum(hit) > 0
                sums = np.concatenate([[0], np.cumsum(inside)])
                n_hit = sums[shard.starts[1:]] - sums[shard.starts[:-1]]
                edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
                first, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
                spans = defaultdict(list)
                for d, a, e in zip(np.searchsorted(shard.starts, first, "right") - 1, first, end, strict=True):
                    spans[d].append((int(a - shard.starts[d]), int(e - shard.starts[d])))
                name = batch.column("shard")[i].as_py()
                for at in range(0, len(shard.n_words), 5000):
                    some = range(at, min(at + 5000, len(shard.n_words)))
                    hits = [_by_name(asked.items[k] for k in found[d]) if d in found else [] for d in some]
                    near = [sorted({asked.items[k] for k in close[d]} - set(h), key=lambda k: (k is None, k or 0)) if d in close else [] for d, h in zip(some, hits, strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        shard.doc_ids[some.start : some.stop],
                        pa.array(shard.n_words[some.start : some.stop]),
                        pa.array(n_hit[some.start : some.stop]),
                        pa.array(hits, pa.list_(pa.int64())),
                        pa.array(near, pa.list_(pa.int64())),
                        pa.array([[{"first": a, "end": e} for a, e in spans[d]] if d in spans else [] for d in some], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                        pa.array([name] * len(some), pa.string()),
                        pa.array(some, pa.int64()),
                    ], names=[*FOUND, "shard", "place"])

    found = index.mapInArrow(find, "doc_id long, n_words long, n_hit long, items array<long>, near_items array<long>, spans array<struct<first: long, end: long>>, shard string, place long")
    return found if placed else found.select(*FOUND)


def merged(parts: DataFrame) -> DataFrame:
    """The rows of several blocks of items as one search would give them."""

    def joined(spans, span):
        last = F.try_element_at(spans, F.lit(-1))
        longer = F.struct(last["first"].alias("first"), F.greatest(last["end"], span["end"]).alias("end"))
        apart = last.isNull() | (last["end"] < span["first"])
        return F.when(apart, F.concat(spans, F.array(span))).otherwise(F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(longer)))

    def all_of(name):
        return F.flatten(F.collect_list(name)).alias(name)

    rows = parts.groupBy("shard", "place").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), all_of("items"), all_of("near_items"), all_of("spans"))
    none = F.array().cast("array<struct<first: long, end: long>>")
    rows = rows.withColumn("spans", F.aggregate(F.array_sort("spans"), none, joined))
    by_name = F.transform(F.array_sort(F.transform(F.array_distinct("items"), lambda i: F.struct(F.coalesce(i.cast("string"), F.lit("None")).alias("s"), i.alias("i")))), lambda x: x["i"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    rows = rows.withColumn("near_items", F.array_sort(F.array_except("near_items", "items"))).withColumn("items", by_name)
    return rows.withColumn("n_hit", n_hit).select(*FOUND)


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items' words in blocks of up to 8 * MAX_TEST_WORDS bytes, one at a time on the driver; a larger item is a block of its own."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    block, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r.text.encode("utf-8", "surrogatepass"))
        if block and size + n > 8 * MAX_TEST_WORDS:
            yield block
            block, size = [], 0
        if w := words(r.text):
            block.append((r.id, w))
            size += n
    yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int | None = 20, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """Build the index and search all items in it: of all terms where ``full`` or for several blocks of items, else of the test terms."""
    parts = blocks(benchmark)
    items, second = next(parts), next(parts, None)
    if second is None:
        index = build_index(docs, None if full else {t for _, terms in items for t in terms}, id_col, text_col)
        return search(index, items, size, slop)
    index, found = build_index(docs, None, id_col, text_col), None
    for block in chain([items, second], parts):
        part = scratch.stored(search(index, block, size, slop, placed=True), "phrase-found")
        found = part if found is None else found.unionByName(part)
    return merged(found)


def op9_phrase_index(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), full=True)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.transform("items", lambda i: i.cast("string")), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP9_SQL = """
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (
    SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)
), doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
    FROM doc_words, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)
), matches AS (
  SELECT d.doc_id, d.i, d.n, t.item_id FROM doc_windows d JOIN item_windows t USING (n, phrase)
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM matches) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM matches) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(i.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hits h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""
