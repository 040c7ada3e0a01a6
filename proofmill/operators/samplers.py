"""Seeded samplers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.operators.joins import matched


def balanced(rows: DataFrame, id_col: str, n_classes: int | Column, seed: str | Column, by: list[str] | None = None) -> DataFrame:
    """With ``class`` from 0 up; classes' sizes differ by one at most in each group of ``by``.

    A row's rank is that of its hash. Ranks are counted in 4,096 ranges of the
    hash, whose starts come from prefix sums of their sizes, so that a large
    group is spread over tasks.
    """
    by, columns = by or [], rows.columns
    order = F.md5(F.concat(F.lit(seed) if isinstance(seed, str) else seed, F.col(id_col).cast("string")))
    keyed = rows.withColumns({"_hash": order, "_classes": F.lit(n_classes) if isinstance(n_classes, int) else n_classes}).withColumn("_range", F.substring("_hash", 1, 3))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = keyed.groupBy(*by, "_range").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*by, "_range").orderBy("_hash", id_col)
    ranked = matched(keyed.withColumn("_rank", F.row_number().over(within) - 1), starts, [*by, "_range"])
    return ranked.withColumn("class", (F.col("_start") + F.col("_rank")) % F.col("_classes")).select(*columns, F.col("class").cast("long").alias("class"))


def split_counts(totals: DataFrame, mix: tuple[tuple[str, float], ...], total: str = "total") -> DataFrame:
    """A row for each name of the mix: parts by largest remainder that add up to ``total``; ties go in the mix's order."""
    parts = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), (F.col(total) * F.lit(w)).alias("exact")) for i, (n, w) in enumerate(mix)])
    based = F.transform(parts, lambda p: F.struct(p["ord"].alias("ord"), p["name"].alias("name"), F.floor(p["exact"]).alias("base"), F.round(p["exact"] - F.floor(p["exact"]), 9).alias("rem")))
    short: Column = F.col(total) - F.aggregate(based, F.lit(0).cast("long"), lambda s, p: s + p["base"])
    ranked = F.array_sort(F.transform(based, lambda p: F.struct((-p["rem"]).alias("r"), p["ord"].alias("ord"), p["name"].alias("name"), p["base"].alias("base"))))
    given = F.transform(ranked, lambda p, i: F.struct(p["name"].alias("name"), (p["base"] + (i < short).cast("long")).alias("part")))
    return totals.select("*", F.explode(given).alias("g")).select(*totals.columns, "g.*")


def audit_sample(rows: DataFrame, stratum: str, id_col: str, per_stratum: int, seed: str) -> DataFrame:
    """The ``per_stratum`` rows of each stratum that a hash puts first; Spark limits groups before it shuffles."""
    order = F.sha2(F.concat(F.lit(seed), F.col(id_col).cast("string")).cast("binary"), 256)
    window = Window.partitionBy(stratum).orderBy(order, id_col)
    return rows.withColumn("place", F.row_number().over(window)).where(F.col("place") <= per_stratum)


def shuffled(rows: DataFrame, id_col: str, order: str, seed: Column, by: list[str]) -> DataFrame:
    """With ``place`` from 1 up: the order as written where ``seed`` is null, else that of a seeded hash."""
    key = F.md5(F.concat(seed.cast("string"), F.lit(":order:"), F.col(id_col).cast("string")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(key.asc_nulls_first(), order)))
