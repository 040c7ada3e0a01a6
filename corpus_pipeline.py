"""Five stages from raw documents to token files, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next one's documents. All but the last return the columns of
``documents``, whatever further columns there are and whatever their names.

Every row is judged by itself: ids may be null, or shared by different texts.
Texts are taken whole, however long. An empty table gives an empty result of the
same columns in every stage; ``documents`` may lack nothing but rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm import language_id, mixing, near_dup, phrase_index, scratch, token_file


def _unused(docs: DataFrame, name: str) -> str:
    """``name`` with as many underscores as make it a new column, whatever the case of the others."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language no dictionary tells from the second best.

    A null, empty or letterless text has no language and goes; of two best
    languages with equal sums neither is told, and the row goes; repeated rows
    go or stay together; a null ``lang`` teaches nothing, and where all are null
    every row goes.
    """
    name = _unused(docs, "_language")
    dictionaries = language_id.fit(docs)
    judged = docs.withColumn(name, language_id.identify(docs, dictionaries))
    return judged.where(~F.col(name)["rejected"]).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies, that of the least id (null last).

    Of repeated rows one stays, that with the least other columns; rows that
    share an id go by their own texts; null and wordless texts have no copies
    and all stay.
    """
    return near_dup.one_of_each(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item; a row goes by its own text, whatever its id.

    Null and wordless texts hold none and stay; repeated rows go or stay
    together; without items every row stays.
    """
    key = _unused(docs, "_text_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col("text")))
    found = phrase_index.decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=None, id_col=key)
    hit = scratch.stored(found.where("n_hit > 0").select(F.col("doc_id").alias(key)).distinct(), "phrase-hits")
    return keyed.join(hit, key, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take and repeat documents so that the sources meet their weights.

    A null source is one, after the others; rows of a null or wordless text
    count nothing towards a budget; rows that share an id share a key and are
    taken together.
    """
    return mixing.mix(docs).select(*docs.columns)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in files; a row for each document as the files have it.

    A null or empty text has the end id alone; null ids come first; repeated
    rows are written as often as they occur.
    """
    return token_file.token_table(docs)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_text),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_token_files),
]

#: Compression, hashing and tokenization are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote, and its tables, go once the next one has been written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        at = scratch.path(spark, "pipeline")
        with scratch.scope(spark):
            stage(spark, docs, sf_dir).write.parquet(at)
        if before:
            scratch.remove(spark, before)
        docs, before = spark.read.parquet(at), at
    made = STAGES[-1][1](spark, docs, sf_dir)  # the files are written; the rows are read from them
    scratch.remove(spark, before)
    return made
