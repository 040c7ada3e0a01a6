"""Profiles to claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.functions import constants as C
from proofmill.functions.text import dedupe_key, is_blank


def _claim(field: str, kind: str, place: int):
    def of(value: Column, item: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), value.cast("string").alias("value"), F.lit(place).alias("place"), item.alias("item"))

    return of


def unpivot(profiles: DataFrame, id_col: str = "extraction_id") -> DataFrame:
    """(extraction_id, field, kind, value, claim_ord, claim_id): one row for each value of a scored field.

    ``profiles`` has a column for each field it knows: an array is a row an
    item, anything else one row. Nulls and blank strings go, the first of equal
    values stays, and ids follow the order of fields and items. One shuffle, by
    extraction.
    """
    kinds = dict(profiles.dtypes)
    rows = []
    for place, field in enumerate(C.SCORED_FIELDS):
        if field not in kinds:
            continue
        kind = kinds[field]
        item = kind[6:-1] if kind.startswith("array") else kind
        name = {"string": "str", "boolean": "bool"}.get(item, "int")
        values = F.col(field) if kind.startswith("array") else F.array(field)
        rows.append(F.transform(F.coalesce(values, F.array().cast(f"array<{item}>")), _claim(field, name, place)))
    flat = profiles.select(id_col, F.explode(F.concat(*rows)).alias("c")).select(id_col, "c.*")
    flat = flat.where(F.col("value").isNotNull() & ((F.col("kind") != "str") | ~is_blank(F.col("value")))).withColumn("same", dedupe_key(F.col("kind"), F.col("value")))
    first = Window.partitionBy(id_col, "field", "kind", "same").orderBy("item")
    order = Window.partitionBy(id_col).orderBy("place", "item")
    kept = flat.withColumn("nth", F.row_number().over(first)).where("nth = 1").withColumn("claim_ord", F.row_number().over(order))
    return kept.select(id_col, "field", "kind", "value", "claim_ord", F.format_string("c%02d", "claim_ord").alias("claim_id"))


def deduped(claims: DataFrame, id_col: str = "extraction_id") -> DataFrame:
    """(extraction_id, claims_deduped): values that were left out as repeats of another."""
    same = dedupe_key(F.col("kind"), F.col("value"))
    return claims.where(F.col("value").isNotNull() & ((F.col("kind") != "str") | ~is_blank(F.col("value")))).groupBy(id_col).agg((F.count("*") - F.count_distinct("field", "kind", same)).alias("claims_deduped"))


def unscored_present(profiles: DataFrame, id_col: str = "extraction_id") -> DataFrame:
    """(extraction_id, unscored_present): the fields of a profile that are kept but never scored."""
    known = [c for c in profiles.columns if c in C.UNSCORED_FIELDS]
    present = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in known])) if known else F.array().cast("array<string>")
    return profiles.select(id_col, present.alias("unscored_present"))


def judged_payload(rows: DataFrame, id_col: str) -> DataFrame:
    """What a judge is shown of facts or claims: id, field and value of the judged fields alone."""
    return rows.where(F.col("field").isin(*C.JUDGED_FIELDS)).select(*[c for c in ("extraction_id", "persona_id") if c in rows.columns], id_col, "field", "value")
