"""Language identification by compression.

For each language a raw-content Zstandard dictionary is cut from labelled texts.
A text is lower-cased, reduced to its letters and cut into blocks; each block is
compressed with every language's dictionary, and the language with the smallest
sum of sizes is chosen. Blocks are short, so that the dictionary counts in all
parts of a long text. The margin is what the best sum saves of the second best;
where it is below ``min_margin`` the text is rejected.

The dictionaries are fitted on about ``sample_rows`` rows of each language, from
each a slice of ``slice_chars`` characters at a random place; every text is
classified whole. There may be any number of languages; each takes its
dictionary and a compressor in every Python worker, and ``sample_rows`` slices
on the driver while they are cut.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and
rejected; equal sums go to the language with more labelled rows, then to the
smaller name, with score 0; a null language teaches nothing; without labelled
rows every text is ``und``; repeated rows each get their row; other columns are
neither read nor returned by ``identify``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: The margin under which a text is rejected: two languages explain it equally well. Of held-out documents at sf0.1, 1 %
#: have a margin under 7.4 %; most texts of no learned language have one under 1 %.
MIN_MARGIN = 0.01


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split())


class Classifier:
    """Compressors by language, best-known language first."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 6, block: int = 1024):
        self.block, self.packers = block, []
        for lang, raw in dictionaries.items():
            learned = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            learned.precompute_compress(level)
            self.packers.append((lang, zstandard.ZstdCompressor(level=level, dict_data=learned, write_checksum=False, write_content_size=False, write_dict_id=False).compress))

    def sums(self, text: str) -> list[int]:
        data = normal(text)
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        return [sum([len(pack(b)) for b in blocks]) for _, pack in self.packers]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.packers or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        sums = self.sums(text)
        best = min(sums)
        rest = sorted(sums)[1:]
        return self.packers[sums.index(best)][0], 1 - best / rest[0] if rest else 1.0


def held_out(id_col: Column) -> Column:
    """The fold that nothing is learned from; a null id is not in it."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = 100, slice_chars: int = 1000, dictionary_bytes: int = 16 << 10, max_broadcast_languages: int = 50_000) -> dict[str, bytes]:
    """Dictionaries by language, from the rows whose hash falls in the share that makes about ``sample_rows``."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    counts = {r.lang: r.n for r in sizes.collect()}
    if not counts:
        return {}
    draw, start = F.xxhash64("text", F.lit(1)), 1 + F.pmod(F.xxhash64("text", F.lit(2)), F.greatest(F.lit(1), F.char_length("text") - slice_chars))
    part = F.substr("text", start.cast("int"), F.lit(slice_chars)).alias("part")
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, sample_rows / n) * (1 << 30)) for lang, n in counts.items()], "lang string, upto double")
    drawn = F.pmod(F.col("k"), F.lit(1 << 30)) < F.col("upto")
    if len(counts) <= max_broadcast_languages:  # no row is moved
        chosen = known.withColumn("k", draw).join(F.broadcast(shares), "lang").where(drawn).select("lang", "k", part)
    else:  # the same rows by a join of slices, whose large languages Spark splits
        chosen = known.select("lang", draw.alias("k"), part).hint("merge").join(shares, "lang").where(drawn).select("lang", "k", "part")
    slices = chosen.distinct().collect()
    learned: dict[str, bytearray] = {lang: bytearray() for lang in sorted(counts, key=lambda x: (-counts[x], x))}
    for r in sorted(slices, key=lambda r: (r.k, r.part)):
        if len(learned[r.lang]) < dictionary_bytes:
            learned[r.lang] += normal(r.part) + b" "
    return {lang: bytes(raw[:dictionary_bytes]) for lang, raw in learned.items() if len(raw) >= 8}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN) -> Column:
    """A struct column: lang_pred, score and rejected, from the text alone."""

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classifier = Classifier(dictionaries)
        for texts in batches:
            found = [classifier.predict(t) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([x == UNDETERMINED or s < min_margin for x, s in found], pa.bool_())],
                names=["lang_pred", "score", "rejected"],
            )

    return predict(F.col(text_col))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionaries = fit(docs.where(~held_out(F.col("doc_id"))))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(docs, dictionaries).alias("p")).select("doc_id", "held_out", "p.*")
