"""Contiguous shards of near-equal bytes from global byte-size prefix sums.

Rows are dealt into ranges of their order, each range's total is summed, the
totals' prefix sums are added to the running sums within the ranges, and the
global sums are cut at equal targets. A row belongs to the shard that holds its
middle byte, so a shard misses its target by at most half a row at either end.

Defined cases: a null text has no bytes (its size is the overhead) and the
checksum of no bytes; a null id sorts first; repeated rows each take a place of
their own next to one another; an empty table gives an empty result; other
columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm import scratch


def byte_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Only the few bytes a row needs are shuffled, never its text. The two tables
    that are broadcast have a row for each range and for each shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("_tie"),
    )
    ranged = scratch.stored(slim.repartitionByRange(id_col, "_tie").withColumn("_range", F.spark_partition_id()), "shard-ranges")

    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = ranged.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    starts = totals.select(
        "_range",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0"),
        F.sum("_bytes").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    )
    within = Window.partitionBy("_range").orderBy(F.col(id_col), F.col("_tie"))
    placed = (
        ranged.withColumn("_end", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_row", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), "_range")
        .withColumn("_row", F.col("_row") + F.col("_row0"))
        .withColumn("shard", F.expr(f"cast(least({n_shards - 1}, ((2 * (_byte0 + _end) - size) * {n_shards}L) div greatest(1L, 2 * _all)) as int)"))
    )
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(
        id_col,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_row") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_byte_shards(spark, sf_dir: str) -> DataFrame:
    return byte_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)


#: CRC-32 of the text's bytes from its table, which is made from the polynomial; the rest are prefix sums.
OP6_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), sized AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, h ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, h) AS n
  FROM sized
), dealt AS (
  SELECT *, least(39, ((2 * upto - size) * 40) // greatest(1, 2 * total))::INT AS shard FROM placed
)
SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(size - 16), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])))::BIGINT AS text_crc32,
  'bytes' AS law, shard, n - min(n) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INT) AS grown_shard
FROM dealt, crc
"""
