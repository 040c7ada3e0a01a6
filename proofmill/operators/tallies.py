"""Tallies: numerators and denominators by key, pooled by adding counts and never by averaging ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.functions import constants as C
from proofmill.functions.stats import floor_of, share, wilson
from proofmill.operators.gate import kind_of
from proofmill.operators.verdicts import populations


def precision_rates() -> dict[str, tuple[Column, Column]]:
    """key: (numerator, denominator) conditions over rows with verdict, method and field."""
    p = populations(F.col("verdict"), F.col("method"))
    firm = F.col("field").isin(*C.DEALBREAKER_FIELDS)
    return {
        "precision": (p["scored"] & p["credited"], p["scored"]),
        "hallucination_rate": (p["scored"] & (F.col("verdict") == "unsupported"), p["scored"]),
        "offsheet_rate": (p["judged"] & (F.col("verdict") == "supported_offsheet"), p["judged"]),
        "abstention_rate": (F.col("verdict") == "abstained", p["scorable"]),
        "precision_dealbreakers": (p["scored"] & p["credited"] & firm, p["scored"] & firm),
    }


def recall_rates() -> dict[str, tuple[Column, Column]]:
    """The same over rows with captured, elicited and field."""
    hit, every = F.col("captured"), F.lit(True)
    firm, exact = F.col("field").isin(*C.DEALBREAKER_FIELDS), F.col("field").isin(*C.EXACT_FIELDS)
    return {
        "recall": (hit, every),
        "recall_elicited": (hit & F.col("elicited"), F.col("elicited")),
        "recall_dealbreakers": (hit & firm, firm),
        "recall_exact": (hit & exact, exact),
    }


def tally(rows: DataFrame, by: list[str], rates: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(by, key, num, den): all rates in one pass with one shuffle of partial counts."""
    sums = [F.count_if(x).alias(f"{k}_{part}") for k, pair in rates.items() for x, part in zip(pair, ("n", "d"), strict=True)]
    wide = rows.groupBy(*by).agg(*sums)
    each = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"{k}_n").alias("num"), F.col(f"{k}_d").alias("den")) for k in rates])
    return wide.select(*by, F.explode(each).alias("t")).select(*by, "t.*")


def valued(tallies: DataFrame) -> DataFrame:
    """With value and, for rates, Wilson bounds; a zero denominator has none, and a count is its numerator."""
    kind = kind_of(F.col("key"))
    is_rate, is_count = F.coalesce(kind == "rate", F.lit(False)), F.coalesce(kind == "count", F.lit(False))
    low, high = wilson(F.when(is_rate, F.col("num")), F.when(is_rate, F.col("den")))
    value = F.when(is_count, F.col("num").cast("double")).otherwise(share(F.col("num"), F.col("den")))
    return tallies.withColumns({"value": value, "lo": F.round(low, 9), "hi": F.round(high, 9)})


def zero_filled(tallies: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """A row for each of ``values``, 0 / 0 where there was none."""
    every = tallies.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return F.broadcast(every).join(tallies, column, "left").withColumns({"num": F.coalesce("num", F.lit(0)), "den": F.coalesce("den", F.lit(0))})


def pool(tallies: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of all extractions by key; the number that has the key, and the number with a denominator.

    Where the tallies have a ``kind``, a key of two kinds is an error.
    """
    num = F.sum("num")
    if "kind" in tallies.columns:
        mixed = F.count_distinct("kind") > 1
        num = F.when(mixed, F.raise_error(F.concat(F.lit("tallies of different kinds: "), F.first("key"))).cast("long")).otherwise(num)
    return tallies.groupBy(*(by or []), "key").agg(num.alias("num"), F.sum("den").alias("den"), F.count("*").alias("n_tallies"), F.count_if(F.col("den") > 0).alias("n_defined"))


def variance_floor(runs: DataFrame, by: list[str], value: str = "value", requested: DataFrame | None = None) -> DataFrame:
    """Mean, deviation and floor of a metric over runs; nulls are no observations.

    A requested key without any observation has the least floor and no runs.
    """
    found = runs.groupBy(*by).agg(F.avg(value).alias("baseline_mean"), F.stddev_samp(value).alias("sigma"), F.count(value).alias("runs"))
    if requested is not None:
        found = requested.select(*by).distinct().join(found, by, "left").withColumn("runs", F.coalesce("runs", F.lit(0)))
    return found.withColumn("floor", floor_of(F.col("sigma")))


def pairwise_jaccard(items: DataFrame, runs: int, run: str = "run", item: str = "item") -> DataFrame:
    """Sum of intersections over sum of unions of all pairs of ``runs`` runs, from counts alone.

    An item in k of r runs is in k (k - 1) / 2 intersections and in as many
    unions as there are pairs less those of runs without it, so no pair of runs
    is ever joined. A run without any item has no row in ``items`` and counts all the same.
    """
    held = items.groupBy(item).agg(F.count_distinct(run).alias("k"))
    both = held.groupBy("k").agg(F.count("*").alias("n"), F.lit(runs).cast("long").alias("r"))
    return both.agg(
        F.sum(F.expr("n * (k * (k - 1) div 2)")).alias("num"),
        F.sum(F.expr("n * (r * (r - 1) div 2 - (r - k) * (r - k - 1) div 2)")).alias("den"),
    ).withColumn("value", share(F.col("num"), F.col("den")))
