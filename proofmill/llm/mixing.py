"""Mixing sources to target weights.

Each row gets a hash-random key. Rows are range-sorted by it within their
source, prefix sums of their sizes are built from the ranges' totals, and the
order is cut at the source's exact budget. A budget over the source's size takes
the source whole once for each full epoch and cuts the rest. Rows are taken
whole: after the last row that fits, the row of the cut's range whose size comes
nearest to what is still missing is taken too, if that brings the sum nearer.

Targets: the sources share the total size by weight; none exceeds
``max_repeats`` times its source's size, and what is over is shared again by
weight until none exceeds. That is one level for all sources below their
bounds, found by a prefix sum over the sources in order of bound to weight.

Defined cases: a null text has size 0; a null source is a source, after all
others; a null id has a key like any other; repeated rows share a key and are
taken together; an empty table, or one without words, gives targets of 0; other
columns are neither read nor returned by ``plan_mix``, while ``mix`` returns all
columns of its input whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm import scratch
from proofmill.llm.words import word_count

#: Rows of a source that a range of keys holds about; ranges are what is sorted in one task.
RANGE_ROWS = 2_000
#: As many per-source rows are sent to every task; more are joined by shuffle.
MAX_BROADCAST_SOURCES = 50_000


def key_of(id_col: Column, seed: int) -> Column:
    """60 random bits of the id."""
    text = F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """``sources`` (source, source_size) with target, the double that each source's sum should meet."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*map(F.lit, weights))
    ranked = sources.withColumn("weight", F.element_at(pattern, (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("bound", F.lit(float(max_repeats)) * F.col("source_size"))
    order = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    levels = (
        ranked.withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("bounds_before", F.coalesce(F.sum("bound").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights_from", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("bounds_before")) / F.col("weights_from"))
        .withColumn("level", F.when(F.col("bound") / F.col("weight") >= F.col("level"), F.col("level")))
        .withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    return levels.select("source", "source_size", "rows", F.least("bound", F.col("weight") * F.coalesce("level", F.lit(0.0))).alias("target"))


def _joined(left: DataFrame, right: DataFrame, n: int, how: str = "inner") -> DataFrame:
    right = right.withColumnRenamed("source", "_source")
    right = F.broadcast(right) if n <= MAX_BROADCAST_SOURCES else right
    return left.join(right, left.source.eqNullSafe(right._source), how).drop("_source")


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """(rows, plan, number of sources): sizes by id and key, and per source the epochs, the cut and the last row.

    Texts are read once; all else works on the ids, sources, keys and sizes.
    """
    slim = scratch.stored(docs.select(F.col(id_col), F.col(source_col).alias("source"), key_of(F.col(id_col), seed).alias("key"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    plan = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), weights, max_repeats)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = scratch.stored(plan.withColumn("ranges", F.ceil(F.col("rows") / F.lit(RANGE_ROWS))), "mix-targets")
    n = plan.count()

    dealt = _joined(slim, plan.select("source", "ranges", "rest"), n).withColumn("range", F.expr("((key >> 28) * ranges) >> 32"))
    by_range = Window.partitionBy("source").orderBy("range")  # a row for each range
    totals = dealt.groupBy("source", "range", "rest").agg(F.sum("size").alias("in_range"))
    totals = totals.withColumn("before", F.coalesce(F.sum("in_range").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = totals.where("rest > 0 and before <= rest and rest < before + in_range").select("source", F.col("range").alias("cut_range"), "before")

    near = _joined(dealt, cut, n).where("range = cut_range")
    units = near.groupBy("source", "key", "rest", "before").agg(F.sum("size").alias("size"))
    sums = units.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("key")))
    taken = F.col("upto") <= F.col("rest")
    fit = sums.groupBy("source").agg(
        F.max(F.when(taken, F.col("key"))).alias("cut_key"),
        F.max(F.when(taken, F.col("upto"))).alias("cut_sum"),
        F.max("before").alias("before"),
        F.max("rest").alias("rest"),
    )
    fit = fit.withColumn("gap", F.col("rest") - F.coalesce("cut_sum", "before")).select("source", F.col("cut_key"), "gap")
    last = _joined(units, fit, n).where("(cut_key is null or key > cut_key) and abs(size - gap) < gap")
    last = last.groupBy("source").agg(F.min_by("key", F.struct(F.abs(F.col("size") - F.col("gap")), "key")).alias("last_key"))
    # below the cut's range all rows are taken, in it those up to cut_key
    cuts = _joined(_joined(cut.select("source", "cut_range"), fit.drop("gap"), n, "left"), last, n, "left")
    plan = scratch.stored(_joined(plan, cuts, n, "left"), "mix-plan")
    return slim, plan, n


def times_of() -> Column:
    """How often a row joined with its source's plan is taken."""
    more = F.expr("((key >> 28) * ranges) >> 32 < cut_range or key <= cut_key or key = last_key")
    return (F.col("epochs") + F.coalesce(more, F.lit(False)).cast("long")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All columns of the rows that the mix takes, a row as often as it is taken; rows are not shuffled."""
    _, plan, n = plan_mix(docs, weights, max_repeats, seed, id_col, source_col, text_col)
    of_plan = ["source", "epochs", "ranges", "cut_range", "cut_key", "last_key"]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).alias("source"), key_of(F.col(id_col), seed).alias("key"))
    times = _joined(row, plan.select(*of_plan), n).select("row", times_of().alias("times")).where("times > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth")).select("row.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    slim, plan, n = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = _joined(slim, plan.drop("rows"), n)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * times_of()).alias("taken"))


OP3_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':7'), 1, 15))::BIGINT AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source
), ranked AS (
  SELECT *, (((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1)::DOUBLE AS weight,
    3.0::DOUBLE * source_size AS bound FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(bound) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked WINDOW o AS (ORDER BY bound / weight, source NULLS LAST)
), chosen AS (
  SELECT coalesce(first(level ORDER BY bound / weight, source NULLS LAST) FILTER (bound / weight >= level), 0.0) AS level FROM levels
), plan AS (
  SELECT source, source_size, least(bound, weight * chosen.level) AS target, (n + 1999) // 2000 AS ranges FROM ranked, chosen
), epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM plan
), dealt AS (
  SELECT s.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    ((s.key >> 28) * e.ranges) >> 32 AS rng
  FROM sized s JOIN epochs e ON s.source IS NOT DISTINCT FROM e.source
), sums AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key) AS upto FROM dealt
), cut AS (
  SELECT source, min(rng) FILTER (upto > rest) AS cut_range, max(rest) - coalesce(max(upto) FILTER (upto <= rest), 0) AS gap
  FROM sums GROUP BY source
), units AS (
  SELECT source, key, rng, sum(size) AS size FROM sums WHERE rest > 0 AND upto > rest GROUP BY source, key, rng
), last AS (
  SELECT u.source, first(u.key ORDER BY abs(u.size - c.gap), u.key) AS last_key
  FROM units u JOIN cut c ON u.source IS NOT DISTINCT FROM c.source AND u.rng = c.cut_range
  WHERE abs(u.size - c.gap) < c.gap GROUP BY u.source
)
SELECT s.doc_id, s.size, s.source_size, s.target,
  (s.size * (s.epochs + CASE WHEN s.rest > 0 AND (s.upto <= s.rest OR s.key = l.last_key) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sums s LEFT JOIN last l ON s.source IS NOT DISTINCT FROM l.source
"""
