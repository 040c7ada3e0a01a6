"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard.

A text's set holds the distinct runs of ``shingle`` words (ASCII-lower-cased), as
64-bit hashes; a text with fewer words has its whole sequence as one run. Two
permutations give all signature coordinates: the first, sigma, scatters a
shingle over D places, the second, pi, is shifted by one place more for each
coordinate, so that coordinate k of a set is the least pi[(sigma(x) + k) mod D].
The coordinates are cut into bands; texts that share a band are candidates, and
every link is confirmed on the full sets.

Texts with equal sets form a class, which takes part once, as one node; the
classes come from one aggregation whose map side already folds copies. Bands
that only one class has are dropped before anything else is done with them. In
a band's bucket each class is compared with the one that meets most others in
all its bands, so that a bucket of copies costs one comparison a class.
Components are built from the confirmed links. In buckets that still hold
several components, all pairs of classes from different components are compared
by their sizes and by one byte of each coordinate, block by block; pairs that
may reach the threshold are confirmed on the spot and the components are joined.
So no pair that shares a band is lost unless a path of links joins it already.

Joins of tables that both grow with the input are sort-merge joins by hint, at
every size, and what they read is written before, so that Spark can split the
rows of a hot key over tasks.

``threshold`` is a percentage: 100 * |A and B| >= threshold * |A or B|. With 40
bands of 6 coordinates a pair at 80 % is missed with a probability of 5e-6, at
85 % of 1e-8; the byte filter wants 67.5 % of 240 coordinates, which at 80 % is near five
deviations off.

Defined cases: a null or wordless text has an empty set and is linked with
nothing; every row goes by its own text, also where rows share an id; a
component's id is the least id of its rows, null if all are null, and a row with
a null id links like any other but is never kept; repeated rows have the same
component and the same ``kept``; an empty table gives an empty result; other
columns are neither read nor returned by ``near_groups``, while ``one_of_each``
returns all columns of its input whatever their names.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.llm import scratch

BANDS, ROWS = 40, 6
PLACES = 1 << 22  # D
MEMO_WORDS = 500_000
#: Classes of a bucket that are compared with as many others at once, and bytes of their texts.
BLOCK = 2048
BLOCK_BYTES = 32 << 20
SEED = 20240229

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, shingle: int):
        self.shingle = shingle
        self.memo: dict[bytes, int] = {}
        self.factors = [_U(f) for f in np.random.default_rng(SEED).integers(1, 1 << 63, max(shingle, 2), dtype=np.int64) * 2 + 1]

    def ids(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        try:
            return np.array([memo[w] for w in words], np.uint64)
        except KeyError:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            for w in set(words):
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([memo[w] for w in words], np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        ids = self.ids(words)
        if len(ids) < self.shingle:  # the whole sequence
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
        n = len(ids) - self.shingle + 1
        out = np.zeros(n, np.uint64)
        for k in range(self.shingle):
            out = _mix(out + ids[k : k + n] * self.factors[k])
        return np.unique(out)


class Signer:
    """Circulant MinHash of shingle sets."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.k = bands, rows, bands * rows
        pi = np.random.default_rng(SEED).permutation(PLACES).astype(np.int32)
        wrapped = np.concatenate([pi, pi[: self.k]])
        self.shifted = np.lib.stride_tricks.sliding_window_view(wrapped, self.k)  # row i: pi at i, i + 1, ...
        self.factors = _mix(np.arange(1, rows + 1, dtype=np.uint64)) | _U(1)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        places = (_mix(shingles ^ _U(SEED)) >> _U(42)).astype(np.int64)  # sigma: 22 bits
        best = None
        for i in range(0, len(places), 2048):
            low = self.shifted[places[i : i + 2048]].min(axis=0)
            best = low if best is None else np.minimum(best, low)
        return best

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        cut = signature.reshape(self.bands, self.rows).astype(np.uint64)
        keys = _mix((cut * self.factors).sum(axis=1, dtype=np.uint64) + _mix(np.arange(1, self.bands + 1, dtype=np.uint64)))
        return keys.view(np.int64)

    @staticmethod
    def bytes_of(signature: np.ndarray) -> bytes:
        return (_mix(signature.astype(np.uint64)) & _U(255)).astype(np.uint8).tobytes()


def keys_of(id_col: Column, text_col: Column) -> list[Column]:
    """128 bits that tell rows apart by id and text, and that any scan of the texts gives again."""
    return [F.coalesce(id_col.cast("long"), F.xxhash64(F.lit(1), text_col)).alias("k1"), F.xxhash64(text_col).alias("k2")]


def sketches(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """row, id, k1, k2, n_shingles, set_key (of the whole set), bands and marks (a byte of each coordinate), one pass over the texts.

    ``row`` numbers the rows of this pass alone: write the result before using it.
    """

    def make(batches):
        shingler, signer = Shingler(shingle), Signer()
        for batch in batches:
            sizes, keys, bands, marks = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingler(text)
                sizes.append(len(s))
                if not len(s):
                    keys.append(None), bands.append([]), marks.append(b"")
                    continue
                signature = signer(s)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(signer.band_keys(signature))
                marks.append(signer.bytes_of(signature))
            made = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("row", "id", "k1", "k2")], *made], names=["row", "id", "k1", "k2", "n_shingles", "set_key", "bands", "marks"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), *keys_of(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text"))
    return rows.mapInArrow(make, "row long, id long, k1 long, k2 long, n_shingles long, set_key binary, bands array<long>, marks binary")


def texts_of(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of ``nodes`` (node, k1, k2)."""
    texts = docs.select(*keys_of(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text"))
    return texts.join(nodes.select("node", "k1", "k2").hint("merge"), ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("node", "text")


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets reach the threshold.

    A hot text's pairs are split by Spark's skew handling; rows arrive in order
    of a, whose set is kept.
    """
    both = pairs.hint("merge").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.hint("merge").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def check(batches):
        shingler, kept = Shingler(shingle), OrderedDict()

        def of(node, text):
            if node not in kept:
                kept[node] = shingler(text)
                if len(kept) > 64:
                    kept.popitem(last=False)
            return kept[node]

        for batch in batches:
            keep = []
            a_ids, b_ids = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for a, b, ta, tb in zip(a_ids, b_ids, batch.column("text_a"), batch.column("text_b"), strict=True):
                x = kept[a] if a in kept else of(a, ta.as_py())
                y = kept[b] if b in kept else of(b, tb.as_py())
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= threshold * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every linked id, root being the least id of its component.

    Alternating star steps, until every component is a star: an id's neighbours
    are moved to its least neighbour. Each step's tables are written, so lineage
    does not grow and a hot id's edges can be split; nothing but a yes or no a
    round comes to the driver.
    """

    def with_least(edges: DataFrame) -> DataFrame:
        """(u, v, m), m being the least neighbour of u."""
        least = scratch.stored(edges.groupBy("u").agg(F.min("v").alias("m")), "near-least")
        used.append(least)
        return edges.hint("merge").join(least, "u")

    def stars(edges: DataFrame) -> bool:
        """Whether every u has one v, which is no u itself."""
        ends = F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        roles = edges.select(F.explode(ends).alias("e")).groupBy("e.id").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
        return roles.where("up > 1 or up + down > 1").isEmpty()

    used: list[DataFrame] = []
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = scratch.stored(edges, "near-edges")
    while not stars(edges):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u != v").distinct()
        large = scratch.stored(large, "near-large")
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = with_least(large).select(F.explode(ends).alias("e")).select("e.*").where("u != v").distinct()
        new = scratch.stored(small, "near-edges")
        scratch.drop(edges, large, *used)
        edges, used = new, []
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _blocks(members: DataFrame, width: int, size: str) -> DataFrame:
    """Members of a bucket once for each two blocks that they are of: (band, i, j) is what one task compares.

    A block has about ``width`` members, and about BLOCK_BYTES of ``size`` at most.
    """
    n = members.groupBy("band").agg(F.greatest(F.ceil(F.count("*") / F.lit(width)), F.ceil(F.sum(size) / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"))
    n = scratch.stored(n.where("blocks > 1"), "near-blocks")  # few: all other buckets are one block
    rows = members.hint("merge").join(n, "band", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")


def leftover_links(members: DataFrame, texts: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """Confirmed links (a, b) between classes of different components that share a bucket.

    ``members``: band, id (of the node), root, n_shingles, bands, marks. No pair leaves a task
    unless it is a link. First the classes that have a possible partner are
    told by sizes and marks alone, then their texts are compared; a pair is
    compared in the first band that both share.
    """
    wanted = threshold / 100 - 0.125

    def partners(table: pa.Table):
        """(x, partners of x) of one group."""
        side, i, j, band = table.column("block").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py(), table.column("band")[0].as_py()
        ids, roots, n = (table.column(c).to_numpy() for c in ("id", "root", "n_shingles"))
        marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(len(ids), -1)
        bands = np.array(table.column("bands").combine_chunks().flatten()).reshape(len(ids), -1)
        k = int(np.flatnonzero(bands[0] == band)[0])
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        for x in left:
            y = right[(roots[right] != roots[x]) & (100 * np.minimum(n[right], n[x]) >= threshold * np.maximum(n[right], n[x]))]
            y = y[ids[y] > ids[x]] if i == j else y
            y = y[~(bands[y, :k] == bands[x, :k]).any(axis=1)] if k else y
            y = y[(marks[y] == marks[x]).mean(axis=1) >= wanted] if len(y) else y
            if len(y):
                yield x, y

    def possible(table: pa.Table) -> pa.Table:
        found = np.zeros(table.num_rows, bool)
        for x, y in partners(table):
            found[x], found[y] = True, True
        return table.select(["band", "id"]).filter(pa.array(found))

    def linked(table: pa.Table) -> pa.Table:
        shingler, sets, texts = Shingler(shingle), OrderedDict(), table.column("text")
        ids = table.column("id").to_numpy()

        def of(r):
            if r not in sets:
                sets[r] = shingler(texts[int(r)].as_py())
                if len(sets) > 2 * BLOCK:
                    sets.popitem(last=False)
            return sets[r]

        a, b, joined = [], [], {}
        for x, ys in partners(table):
            for y in ys:
                if joined.get(x, x) == joined.get(y, y + len(ids)):
                    continue  # both are linked with one that was before
                s, t = of(x), of(y)
                same = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * same >= threshold * (len(s) + len(t) - same):
                    a.append(min(ids[x], ids[y])), b.append(max(ids[x], ids[y]))
                    joined[x] = joined.setdefault(y, joined.get(x, x))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    slim = members.withColumn("size", F.lit(600))
    some = _blocks(slim, 4 * BLOCK, "size").drop("size").groupBy("band", "i", "j").applyInArrow(possible, "band long, id long").distinct()
    some = scratch.stored(some, "near-possible")
    rows = members.hint("merge").join(some, ["band", "id"]).hint("merge").join(texts.withColumnRenamed("node", "id"), "id").withColumn("size", F.octet_length("text"))
    return _blocks(rows, BLOCK, "size").drop("size").groupBy("band", "i", "j").applyInArrow(linked, "a long, b long").distinct()


def _bands(classes: DataFrame, *columns: str) -> DataFrame:
    return classes.select(*columns, F.explode("bands").alias("band"))


def _grouped(docs: DataFrame, shingle: int, threshold: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, k1, k2, n_shingles, set_key), and for each set of several rows or with a link (set_key, component_id, s1, s2).

    s1 and s2 are the keys of the component's first row, that of the least id (null last).
    """
    made = scratch.stored(sketches(docs, shingle, id_col, text_col), "near-sketches")
    # rows of a set have equal bands and marks, whichever is first
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("first")
    node = F.min(F.struct("row", "k1", "k2")).alias("node")
    classes = made.where("set_key is not null").groupBy("set_key").agg(node, first, F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "marks")])
    classes = scratch.stored(classes.select("set_key", F.col("node.row").alias("node"), "node.k1", "node.k2", "first", "n", "n_shingles", "bands", "marks"), "near-classes")

    met = scratch.stored(_bands(classes).groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "near-met")
    shared = _bands(classes, "node").hint("merge").join(met, "band").groupBy("node").agg(F.sum("n").alias("score"), F.collect_list("band").alias("bands"))
    shared = scratch.stored(shared.hint("merge").join(classes.select("node", "k1", "k2", "n_shingles"), "node"), "near-shared")
    # what most others meet in most bands, as the text that all were copied from, is the one to compare with
    hubs = _bands(shared, "node", "n_shingles", "score").groupBy("band").agg(F.min(F.struct((-F.col("score")).alias("s"), "node", "n_shingles")).alias("hub"))
    hubs = scratch.stored(hubs.select("band", F.col("hub.node").alias("hub"), F.col("hub.n_shingles").alias("hub_n")), "near-hubs")
    near_sizes = F.expr(f"100 * least(n_shingles, hub_n) >= {threshold} * greatest(n_shingles, hub_n)")
    hub_pairs = _bands(shared, "node", "n_shingles").hint("merge").join(hubs, "band").where(F.col("node") != F.col("hub")).where(near_sizes)
    pairs = scratch.stored(hub_pairs.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "near-pairs")
    texts = scratch.stored(texts_of(shared, docs, id_col, text_col), "near-texts")
    links = scratch.stored(confirmed(pairs, texts, shingle, threshold), "near-links")
    roots = components(links)
    scratch.drop(met, hubs, pairs, links)

    members = shared.select("node", "bands").hint("merge").join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = scratch.stored(members, "near-members")
    mixed = _bands(members, "root").groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("band")
    mixed = _bands(members, F.col("node").alias("id"), "root").hint("merge").join(scratch.stored(mixed, "near-mixed"), "band")
    mixed = scratch.stored(mixed, "near-mixed")
    marked = classes.select(F.col("node").alias("id"), "n_shingles", "bands", "marks").hint("merge").join(mixed.select("id").distinct(), "id")
    marked = scratch.stored(mixed.hint("merge").join(scratch.stored(marked, "near-marked"), "id"), "near-marked")
    more = scratch.stored(leftover_links(marked, texts, shingle, threshold), "near-links")
    if not more.isEmpty():
        roots = components(roots.select(F.col("id").alias("b"), F.col("root").alias("a")).unionByName(more))
    scratch.drop(shared, texts, members, mixed, marked, more)

    named = classes.select("set_key", "node", "first", "n").hint("merge").join(roots.withColumnRenamed("id", "node"), "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    heads = scratch.stored(named.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("rows")).where("rows > 1"), "near-heads")
    of_set = named.select("set_key", "root").hint("merge").join(heads, "root").select("set_key", F.col("first.id").alias("component_id"), F.col("first.k1").alias("s1"), F.col("first.k2").alias("s2"))
    of_set = scratch.stored(of_set, "near-sets")
    scratch.drop(classes, heads)
    return made.select("id", "k1", "k2", "n_shingles", "set_key"), of_set


def near_groups(docs: DataFrame, shingle: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the least id that links reach) and kept for every row."""
    rows, of_set = _grouped(docs, shingle, threshold, id_col, text_col)
    out = rows.hint("merge").join(of_set, "set_key", "left").withColumn("component_id", F.when(F.col("s1").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row of the least id (null last) stays.

    Rows that share an id go by their own texts; of repeated rows one stays,
    that with the least other columns; rows without words all stay.
    """
    rows, of_set = _grouped(docs, shingle, threshold, id_col, text_col)
    judged = rows.select("set_key", "k1", "k2").hint("merge").join(of_set, "set_key")
    judged = judged.groupBy("k1", "k2").agg(F.max(F.expr("k1 = s1 and k2 = s2")).alias("stays"), F.count("*").alias("rows"))
    out = scratch.stored(judged.where("not stays or rows > 1"), "near-dropped")
    names = [f"_near_{len(docs.columns)}_{k}" for k in ("k1", "k2")]
    while set(names) & set(docs.columns):
        names = [n + "_" for n in names]
    keyed = docs.withColumns(dict(zip(names, keys_of(F.col(id_col), F.col(text_col)), strict=True)))
    out = out.toDF(*names, "stays", "rows")
    single = keyed.hint("merge").join(out.select(*names), names, "left_anti").select(*docs.columns)
    twice = out.where("stays")
    if twice.isEmpty():
        return single
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    again = keyed.hint("merge").join(twice.select(*names), names, "left_semi").groupBy(*names).agg(F.min(row).alias("row"))
    return single.unionByName(again.select("row.*"))


def op8_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, threshold=80)
