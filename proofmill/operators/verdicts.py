"""Verdicts on claims, as column expressions over joined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.functions import constants as C
from proofmill.functions.text import span_normalize, values_match, word_count
from proofmill.operators.joins import matched


def abstains(field: Column, claim: Column, truth: Column) -> Column:
    """The claim declines to answer a field that can be unsure, while the truth is not."""
    return field.isin(*C.UNSURE_FIELDS) & (claim == C.UNSURE) & (truth != C.UNSURE)


def exact_verdict(field: Column, claim_kind: Column, claim: Column, truth_kind: Column, truth: Column) -> Column:
    return (
        F.when(values_match(claim_kind, claim, truth_kind, truth), "supported")
        .when(abstains(field, claim, truth), "abstained")
        .otherwise("unsupported")
    )


def span_reason(turn_id: Column, span: Column, speaker: Column, text: Column) -> Column:
    """Why a quoted span is no evidence, or ok; speaker and text are those of the cited turn, null where there is none."""
    normal = span_normalize(span)
    return (
        F.when(turn_id.isNull() | span.isNull(), "none_cited")
        .when(normal == "", "empty")
        .when(word_count(span) > C.MAX_SPAN_WORDS, "too_long")
        .when(speaker.isNull(), "no_such_turn")
        .when(speaker != "user", "not_user")
        .when(~F.contains(span_normalize(text), normal), "not_verbatim")
        .otherwise("ok")
    )


def judge_verdict(has_entry: Column, cited_fact: Column, fact_fits: Column, reason: Column) -> tuple[Column, Column]:
    """(verdict, fact reference is bad). The order matters: a match without a span is unsupported."""
    fits = F.coalesce(fact_fits, F.lit(False))
    verdict = (
        F.when(~has_entry, "judge_error")
        .when(reason == "none_cited", "unsupported")
        .when(reason != "ok", "span_invalid")
        .when(cited_fact.isNotNull() & fits, "supported")
        .otherwise("supported_offsheet")
    )
    return verdict, has_entry & cited_fact.isNotNull() & ~fits


def populations(verdict: Column, method: Column) -> dict[str, Column]:
    """Errors are states: scorable leaves them out, scored also abstentions; judged is what a judge scored."""
    scorable = ~verdict.isin(*C.ERRORS)
    scored = scorable & (verdict != "abstained")
    return {"scorable": scorable, "scored": scored, "judged": scored & (method == "judge"), "credited": verdict.isin(*C.CREDITED)}


def exact_alignments(claims: DataFrame, facts: DataFrame, key: list[str]) -> DataFrame:
    """``claims`` (key, field, kind, value) of exact fields with their verdict and fact.

    ``facts`` has (key, fact_id, field, kind, value), one of each exact field. A
    claim whose field has no fact keeps its row, with no verdict and a problem.
    """
    truth = facts.where(F.col("field").isin(*C.EXACT_FIELDS)).select(*key, "field", "fact_id", F.col("kind").alias("_kind"), F.col("value").alias("_value"))
    rows = matched(claims.where(F.col("field").isin(*C.EXACT_FIELDS)), truth, [*key, "field"], "left")
    known = F.col("fact_id").isNotNull()
    verdict = F.when(known, exact_verdict(F.col("field"), F.col("kind"), F.col("value"), F.col("_kind"), F.col("_value")))
    rows = rows.withColumns({"verdict": verdict, "problem": F.when(~known, "no_truth")})
    return rows.withColumn("matched_fact_id", F.when(F.col("verdict") == "supported", F.col("fact_id"))).drop("_kind", "_value", "fact_id")
