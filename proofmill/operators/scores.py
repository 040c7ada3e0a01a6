"""Every metric of every extraction as tallies (key, kind, num, den), and their aggregate.

A tally's value is num / den for rates and ratios and num for counts; nothing is
divided before the last step, so pooling is adding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.functions import constants as C
from proofmill.functions.stats import share, wilson
from proofmill.operators.gate import kind_of
from proofmill.operators.joins import matched
from proofmill.operators.tallies import precision_rates, recall_rates

TALLY = ("key", "kind", "num", "den")


def _long(wide: DataFrame, key: list[str], rates: dict[str, tuple[Column, Column]], kind: str = "rate") -> DataFrame:
    each = [F.struct(F.lit(k).alias("key"), F.lit(kind).alias("kind"), n.cast("long").alias("num"), d.cast("long").alias("den")) for k, (n, d) in rates.items()]
    return wide.select(*key, F.explode(F.array(*each)).alias("t")).select(*key, "t.*")


def _counted(rows: DataFrame, key: list[str], rates: dict[str, tuple[Column, Column]], every: DataFrame) -> DataFrame:
    """All rates of ``rows`` by ``key`` in one pass; an extraction without rows has zeros."""
    sums = [F.count_if(x).alias(f"_{i}{p}") for i, pair in enumerate(rates.values()) for x, p in zip(pair, "nd", strict=True)]
    wide = matched(every.select(*key), rows.groupBy(*key).agg(*sums), key, "left").na.fill(0)
    return _long(wide, key, {k: (F.col(f"_{i}n"), F.col(f"_{i}d")) for i, k in enumerate(rates)})


def precision_tallies(alignments: DataFrame, extractions: DataFrame, key: list[str]) -> DataFrame:
    """The precision family and, for every scored field, precision_by_field."""
    rates = precision_rates()
    hit, asked = rates["precision"]
    by_field = {f"precision_by_field.{f}": (hit & (F.col("field") == f), asked & (F.col("field") == f)) for f in C.SCORED_FIELDS}
    return _counted(alignments, key, rates | by_field, extractions)


def recall_tallies(covered: DataFrame, extractions: DataFrame, key: list[str]) -> DataFrame:
    """The recall family, by field, by exact field, and by the disclosures that a sheet has. ``covered``: field, disclosure, disclosed_turn_id, counts."""
    rows = covered.withColumns({"captured": F.col("counts"), "elicited": F.col("disclosed_turn_id").isNotNull()})
    cuts = [(f"recall_by_field.{f}", F.col("field") == f) for f in C.SCORED_FIELDS] + [(f"recall_exact_by_field.{f}", F.col("field") == f) for f in C.EXACT_FIELDS]
    whole = _counted(rows, key, recall_rates() | {k: (F.col("captured") & cut, cut) for k, cut in cuts}, extractions)
    told = rows.groupBy(*key, F.concat(F.lit("recall_by_disclosure."), "disclosure").alias("key")).agg(F.count_if("captured").alias("num"), F.count("*").alias("den"))
    return whole.unionByName(told.select(*key, "key", F.lit("rate").alias("kind"), "num", "den"))


def judge_tallies(health: DataFrame, extractions: DataFrame, key: list[str]) -> DataFrame:
    names = ["judged_claims", "errors", "span_invalid", "span_invalid_first_pass"]
    wide = matched(extractions.select(*key), health.select(*key, *names), key, "left").na.fill(0, names)
    judged = F.col("judged_claims")
    rates = {"judge_error_rate": F.col("errors") + F.col("span_invalid"), "span_invalid_rate_first_pass": F.col("span_invalid_first_pass"), "span_invalid_rate_final": F.col("span_invalid")}
    return _long(wide, key, {k: (n, judged) for k, n in rates.items()})


def yield_tallies(covered: DataFrame, clean_turns: DataFrame, key: list[str]) -> DataFrame:
    """Facts by question, and by spoken minute of it; ``covered`` has ``credited``. Follow-ups and the interviewer's words count."""
    words = clean_turns.where("question_id is not null").groupBy(*key, "question_id").agg(F.sum("word_count").alias("words"))
    got = covered.where("credited and question_id is not null").groupBy(*key, "question_id").agg(F.count("*").alias("n"))
    rows = matched(words, got, [*key, "question_id"], "full").na.fill(0, ["words", "n"])
    each = F.array(
        F.struct(F.concat(F.lit("yield."), "question_id").alias("key"), F.lit("count").alias("kind"), F.col("n").alias("num"), F.lit(0).cast("long").alias("den")),
        F.struct(F.concat(F.lit("yield_per_minute."), "question_id").alias("key"), F.lit("ratio").alias("kind"), (F.col("n") * C.WORDS_PER_MINUTE).alias("num"), F.col("words").alias("den")),
    )
    return rows.select(*key, F.explode(each).alias("t")).select(*key, "t.*")


def followup_tallies(covered: DataFrame, extractions: DataFrame, key: list[str]) -> DataFrame:
    """followup_share, and the same under the persona's style (``extractions`` has ``style``)."""
    rows = covered.where("credited and via_followup is not null").groupBy(*key).agg(F.count_if("via_followup").alias("n"), F.count("*").alias("d"))
    wide = matched(extractions.select(*key, "style"), rows, key, "left").na.fill(0, ["n", "d"])
    names = F.explode(F.array(F.lit("followup_share"), F.concat(F.lit("followup_share_by_style."), "style")))
    return wide.select(*key, names.alias("key"), F.lit("rate").alias("kind"), F.col("n").alias("num"), F.col("d").alias("den"))


def audit_tallies(mismatches: DataFrame, untagged: DataFrame, deduped: DataFrame, extractions: DataFrame, key: list[str]) -> DataFrame:
    """disclosure_mismatch, and the counts untagged_capture and claims_deduped."""
    spoken = mismatches.where("state != 'unverifiable'").groupBy(*key).agg(F.count_if(F.col("state") == "mismatched").alias("m"), F.count("*").alias("c"))
    wide = matched(matched(extractions.select(*key), spoken, key, "left"), untagged.groupBy(*key).agg(F.count("*").alias("u")), key, "left")
    wide = matched(wide, deduped.select(*key, "claims_deduped"), key, "left").na.fill(0)
    zero = F.lit(0)
    counts = _long(wide, key, {"untagged_capture": (F.col("u"), zero), "claims_deduped": (F.col("claims_deduped"), zero)}, "count")
    return _long(wide, key, {"disclosure_mismatch": (F.col("m"), F.col("c"))}).unionByName(counts)


def scores(tallies: DataFrame, key: list[str]) -> DataFrame:
    """(key..., metrics, n) as files hold them: an undefined rate is absent from metrics and 0 in n; counts have no n."""
    count = F.col("kind") == "count"
    value = F.when(count, F.col("num").cast("double")).otherwise(share(F.col("num"), F.col("den")))
    rows = tallies.withColumn("value", value)
    pairs = lambda ok, name: F.map_from_entries(F.array_sort(F.collect_list(F.when(ok, F.struct("key", name)))))
    return rows.groupBy(*key).agg(pairs(F.col("value").isNotNull(), "value").alias("metrics"), pairs(~count, "den").alias("n"))


def exact_floors(facts: DataFrame) -> DataFrame:
    """What one constant answer scores on each exact field, by typed values."""
    counts = facts.where(F.col("field").isin(*C.EXACT_FIELDS)).groupBy("field", "kind", "value").agg(F.count("*").alias("n"))
    found = counts.groupBy("field").agg(F.max("n").alias("num"), F.sum("n").alias("den"))
    return found.select(F.concat(F.lit("exact_floor."), "field").alias("key"), F.lit("rate").alias("kind"), "num", "den")


def key_union(tallies: DataFrame, expected: DataFrame, floors: DataFrame) -> DataFrame:
    """All keys of tallies, floors and those expected, with their kinds; null for a key that no registry knows."""
    keys = tallies.select("key").union(expected.select("key")).union(floors.select("key")).distinct()
    return keys.withColumn("kind", kind_of(F.col("key")))


def unknown_keys(keys: DataFrame) -> DataFrame:
    return keys.where("kind is null").select("key")


def aggregate(tallies: DataFrame, expected: DataFrame, floors: DataFrame) -> DataFrame:
    """(key, kind, value, n, lo, hi, num, den): the pooled value of every key, null where it is undefined.

    ``floors`` take the place of tallies under their keys. A key that the
    registry does not know is an error, and so is one of two kinds.
    """
    own = tallies.join(F.broadcast(floors.select("key")), "key", "left_anti").select("key", "kind", "num", "den").unionByName(floors.select("key", "kind", "num", "den"))
    pooled = own.groupBy("key").agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.min("kind").alias("_lo"), F.max("kind").alias("_hi"))
    rows = key_union(tallies, expected, floors).join(pooled, "key", "left").na.fill(0, ["num", "den"])
    wrong = F.col("kind").isNull() | (F.col("_lo").isNotNull() & ((F.col("_lo") != F.col("kind")) | (F.col("_hi") != F.col("kind"))))
    rows = rows.withColumn("kind", F.when(wrong, F.raise_error(F.concat(F.lit("not a metric of one known kind: "), "key"))).otherwise(F.col("kind")))
    is_rate, is_count = F.col("kind") == "rate", F.col("kind") == "count"
    low, high = wilson(F.when(is_rate, F.col("num")), F.when(is_rate, F.col("den")))
    value = F.when(is_count, F.col("num").cast("double")).otherwise(share(F.col("num"), F.col("den")))
    return rows.select("key", "kind", value.alias("value"), F.when(~is_count, F.col("den")).alias("n"), F.round(low, 9).alias("lo"), F.round(high, 9).alias("hi"), "num", "den")


def lifts(pooled: DataFrame) -> DataFrame:
    """(field, recall, floor, lift) of the exact fields; null where either side is."""
    of = lambda prefix: F.max(F.when(F.col("key").startswith(prefix + "."), F.col("value")))
    rows = pooled.where(F.col("key").rlike(r"^(recall_exact_by_field|exact_floor)\.")).groupBy(F.substring_index("key", ".", -1).alias("field"))
    return rows.agg(of("recall_exact_by_field").alias("recall"), of("exact_floor").alias("floor")).withColumn("lift", F.col("recall") - F.col("floor"))


def per_persona(tallies: DataFrame, key: list[str], keys: DataFrame) -> DataFrame:
    """(key..., metric, value, n): a row for each extraction and each key of the aggregate, null where the extraction lacks it.

    ``keys`` (key, kind) are the few of an aggregate: every extraction's list of them is a literal, not a join.
    """
    names = sorted((r.key, r.kind) for r in keys.collect())
    listed = F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(kind).alias("kind")) for k, kind in names])
    found = tallies.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("num", "den")))).alias("m"))
    rows = found.select(*key, "m", F.explode(listed).alias("x")).select(*key, "x.*", F.try_element_at("m", F.col("x.metric")).alias("t"))
    is_count = F.col("kind") == "count"
    value = F.when(is_count, F.col("t.num").cast("double")).otherwise(share(F.col("t.num"), F.col("t.den")))
    return rows.select(*key, "metric", value.alias("value"), F.when(~is_count, F.col("t.den")).alias("n"))


def excluded(statuses: DataFrame) -> DataFrame:
    """(status, n) of extractions that are not ok; one without a status is ok."""
    return statuses.where(F.coalesce("status", F.lit("ok")) != "ok").groupBy("status").agg(F.count("*").alias("n"))


def suffixes(pooled: DataFrame, prefix: str) -> DataFrame:
    """What stands after ``prefix`` in any key, with a value or not."""
    return pooled.where(F.col("key").startswith(prefix + ".")).select(F.substr("key", F.lit(len(prefix) + 2)).alias("suffix")).distinct()
