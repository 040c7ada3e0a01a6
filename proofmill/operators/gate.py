"""The regression gate between two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.functions import constants as C


def kind_of(key: Column) -> Column:
    """rate, count or ratio; null for a key the registry does not know."""
    prefix, suffix = F.substring_index(key, ".", 1), F.regexp_extract(key, r"^[^.]*\.(.+)$", 1)
    known = F.create_map(*[F.lit(x) for pair in C.DYNAMIC_KINDS.items() for x in pair])
    return (
        F.when(key.isin(*C.STATIC_RATES), "rate")
        .when(key.isin(*C.STATIC_COUNTS), "count")
        .when(suffix != "", F.try_element_at(known, prefix))
    )


def diff(baseline: DataFrame, candidate: DataFrame, floors: DataFrame, gated_keys: tuple[str, ...] = C.GATED_KEYS, gated: bool = True) -> DataFrame:
    """A row for each key of either side: delta, floor, whether it is gated and its verdict."""
    both = baseline.select("key", F.col("value").alias("baseline")).join(candidate.select("key", F.col("value").alias("candidate")), "key", "full")
    rows = both.join(floors.select("key", "floor"), "key", "left")
    is_gated = F.col("key").isin(*gated_keys) & F.lit(gated)
    verdict = (
        F.when(F.col("baseline").isNull() | F.col("candidate").isNull(), "missing")
        .when(~is_gated, "ungated")
        .when(F.col("candidate") < F.col("baseline") - F.col("floor"), "regression")
        .otherwise("pass")
    )
    return rows.select("key", "baseline", "candidate", (F.col("candidate") - F.col("baseline")).alias("delta"), "floor", is_gated.alias("gated"), verdict.alias("verdict"))


def invalid_reason(rows: DataFrame, gated_keys: tuple[str, ...] = C.GATED_KEYS, gated: bool = True) -> str | None:
    """Why a diff cannot be judged, the first of: an empty side, unknown keys, a gated key without a value on a side or without a floor."""
    found = rows.agg(
        F.count("baseline").alias("b"), F.count("candidate").alias("c"), F.array_sort(F.collect_set(F.when(kind_of(F.col("key")).isNull(), F.col("key")))).alias("unknown"),
        *[F.max(F.when(F.col("key") == k, F.col(side).isNotNull().cast("int"))).alias(f"{side}_{i}") for i, k in enumerate(gated_keys) for side in ("baseline", "candidate", "floor")],
    ).first()
    if not found.b:
        return "baseline has no metrics"
    if not found.c:
        return "candidate has no metrics"
    if found.unknown:
        return f"unknown metric keys: {found.unknown}"
    for i, key in enumerate(gated_keys if gated else ()):
        for side, what in (("baseline", "is undefined in the baseline"), ("candidate", "is undefined in the candidate"), ("floor", "has no measured floor")):
            if not found[f"{side}_{i}"]:
                return f"gated metric {key} {what}"
    return None


def exit_code(rows: DataFrame, gated_keys: tuple[str, ...] = C.GATED_KEYS, gated: bool = True) -> int:
    """2 where the comparison is not valid, 1 on a regression, else 0. ``rows`` is a diff."""
    if invalid_reason(rows, gated_keys, gated):
        return 2
    return int(not rows.where("verdict = 'regression'").isEmpty())


def derived_verdict(baseline: Column, candidate: Column, floor: Column, gated: Column) -> Column:
    """The verdict of a diff's row that came without one."""
    return F.when(baseline.isNull() | candidate.isNull(), "unknown").when(~gated, "ungated").when(candidate < baseline - floor, "regression").otherwise("pass")


def expected_keys(spark, fields=C.SCORED_FIELDS, exact_fields=C.EXACT_FIELDS, disclosures=C.DISCLOSURES[:3], styles=C.STYLES, question_ids=()) -> DataFrame:
    """(key, kind) of every metric that an aggregate should have."""
    pairs = [("recall_by_field", fields), ("precision_by_field", fields), ("exact_floor", exact_fields), ("recall_exact_by_field", exact_fields), ("recall_by_disclosure", disclosures), ("followup_share_by_style", styles), ("yield", question_ids), ("yield_per_minute", question_ids)]
    keys = [*C.STATIC_RATES, *C.STATIC_COUNTS, *[f"{p}.{x}" for p, xs in pairs for x in xs]]
    return spark.createDataFrame([(k,) for k in sorted(set(keys))], "key string").withColumn("kind", kind_of(F.col("key")))
