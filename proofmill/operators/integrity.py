"""Constraints as violation counts: a good table has none.

Rules of single rows are conditions of a bad row, by table; rules of whole
sheets, scripts, transcripts or extractions are counted over groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.functions import constants as C
from proofmill.functions.text import word_count
from proofmill.operators.gate import kind_of


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n) for each rule, all in one pass; a rule is the condition of a bad row."""
    wide = rows.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()])
    each = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules])
    return wide.select(F.explode(each).alias("x")).select("x.*")


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def fact_rules() -> dict[str, Column]:
    return {
        "decoy_without_contradict": F.col("decoy_value").isNotNull() & (F.col("disclosure") != "contradict"),
        "fact_of_unknown_field": ~F.col("field").isin(*C.SCORED_FIELDS),
    }


def sheet_violations(facts: DataFrame, sheets: DataFrame, key: list[str]) -> DataFrame:
    """Rules of facts, fact ids that repeat, and exact fields that a sheet does not have exactly once."""
    exact = facts.where(F.col("field").isin(*C.EXACT_FIELDS)).groupBy(*key, "field").agg(F.count("*").alias("n"))
    wanted = sheets.select(*key, F.explode(F.array(*map(F.lit, C.EXACT_FIELDS))).alias("field"))
    off = wanted.join(exact, [*key, "field"], "left").where("coalesce(n, 0) != 1")
    return violations(facts, fact_rules()).unionByName(_count("repeated_fact_id", repeated(facts, [*key, "fact_id"]))).unionByName(_count("exact_field_not_once", off))


def _count(rule: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.lit(rule).alias("rule"), F.count("*").alias("n")).select("rule", "n")


def script_violations(questions: DataFrame, key: list[str]) -> DataFrame:
    """Questions (key, question_id, targets): ids that repeat, and targets that are no field."""
    unknown = F.size(F.array_except("targets", F.array(*map(F.lit, C.ALL_FIELDS)))) > 0
    return violations(questions, {"unknown_target": unknown}).unionByName(_count("repeated_question_id", repeated(questions, [*key, "question_id"])))


def turn_rules() -> dict[str, Column]:
    told = F.coalesce("disclosed_fact_ids", F.array().cast("array<string>"))
    return {
        "word_count_off": F.col("word_count") != word_count(F.col("text")),
        "interviewer_discloses": (F.col("speaker") != "user") & (F.size(told) > 0),
        "followup_without_question": F.col("is_followup") & F.col("question_id").isNull(),
        "fact_disclosed_twice": F.size(told) != F.size(F.array_distinct(told)),
    }


def header_rules() -> dict[str, Column]:
    """Rules of transcripts (noise_rate, noise_seed, source_transcript_id, simulated_minutes) beside the words of their turns."""
    noised = F.col("noise_rate") > 0
    return {
        "noised_without_seed": noised & F.col("noise_seed").isNull(),
        "noised_without_source": noised & F.col("source_transcript_id").isNull(),
        "clean_with_source": ~noised & F.col("source_transcript_id").isNotNull(),
        "minutes_off": F.abs(F.col("simulated_minutes") - F.bround(F.col("words") / float(C.WORDS_PER_MINUTE), 4)) > 1e-4,
    }


def extraction_rules() -> dict[str, Column]:
    """Rules of extractions (status, has_profile, n_claims)."""
    fine = F.col("status") == "ok"
    return {"status_against_profile": fine != F.col("has_profile"), "claims_of_a_failure": ~fine & (F.col("n_claims") > 0)}


def alignment_rules() -> dict[str, Column]:
    verdict, exact, span = F.col("verdict"), F.col("method") == "exact", F.col("span_turn_id").isNotNull()
    matched = F.col("matched_fact_id").isNotNull()
    return {
        "span_without_turn": F.col("span_text").isNotNull() & ~span,
        "exact_is_judge_only": exact & verdict.isin(*C.JUDGE_ONLY),
        "exact_cites": exact & span,
        "offsheet_with_fact": (verdict == "supported_offsheet") & matched,
        "offsheet_without_span": (verdict == "supported_offsheet") & ~span,
        "supported_without_fact": (verdict == "supported") & ~matched,
        "supported_without_span": (verdict == "supported") & ~exact & ~span,
    }


def coverage_rules() -> dict[str, Column]:
    return {"uncaptured_with_claim": ~F.col("captured") & F.col("by_claim_id").isNotNull()}


def tally_rules() -> dict[str, Column]:
    """Rules of tallies (key, kind, num, den)."""
    return {
        "negative_tally": (F.col("num") < 0) | (F.col("den") < 0),
        "count_with_denominator": (F.col("kind") == "count") & (F.col("den") != 0),
        "rate_over_one": (F.col("kind") == "rate") & (F.col("num") > F.col("den")),
        "unknown_key": kind_of(F.col("key")).isNull(),
    }


def score_rules() -> dict[str, Column]:
    """Rules of score files (metrics, n: maps): known keys, and a denominator beside each rate and ratio."""
    known = lambda k: kind_of(k).isNotNull()
    needs = lambda k: F.coalesce(kind_of(k) != "count", F.lit(False))
    return {
        "score_of_unknown_key": F.exists(F.array_union(F.map_keys("metrics"), F.map_keys("n")), lambda k: ~known(k)),
        "score_without_denominator": F.exists(F.map_keys("metrics"), lambda k: needs(k) & ~F.map_contains_key("n", k)),
    }
