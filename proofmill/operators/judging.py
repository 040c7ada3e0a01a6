"""Judge entries to alignments: the last entry of a claim counts, and misquoted spans are asked for once more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.functions import constants as C
from proofmill.operators.joins import matched
from proofmill.operators.verdicts import judge_verdict, span_reason

ENTRY = ("matched_fact_id", "span_turn_id", "span_text", "specificity")


def last_entries(entries: DataFrame, key: list[str]) -> DataFrame:
    """Of several entries on a claim the last one."""
    return entries.groupBy(*key, "claim_id").agg(F.max_by(F.struct(*ENTRY), F.col("entry_ord")).alias("e")).select(*key, "claim_id", "e.*", F.lit(True).alias("has_entry"))


def judged(claims: DataFrame, entries: DataFrame, facts: DataFrame, turns: DataFrame, key: list[str]) -> DataFrame:
    """Alignments of the judged claims: key, claim_id, field, method, verdict, matched_fact_id, span_turn_id, span_text, specificity, bad_reference.

    ``claims``: key, claim_id, field. ``facts``: key, fact_id, field. ``turns``:
    key, turn_id, speaker, text. A claim without an entry is a judge error; a
    cited fact must exist and be of the claim's field; the span must stand in
    the cited user turn.
    """
    mine = claims.where(F.col("field").isin(*C.JUDGED_FIELDS)).select(*key, "claim_id", "field")
    rows = matched(mine, last_entries(entries, key), [*key, "claim_id"], "left").withColumn("has_entry", F.coalesce("has_entry", F.lit(False)))
    fits = facts.select(*key, F.col("fact_id").alias("matched_fact_id"), "field", F.lit(True).alias("fits"))
    cited = turns.select(*key, F.col("turn_id").alias("span_turn_id"), "speaker", "text")
    rows = matched(matched(rows, fits, [*key, "matched_fact_id", "field"], "left"), cited, [*key, "span_turn_id"], "left")
    rows = rows.withColumn("reason", span_reason(F.col("span_turn_id"), F.col("span_text"), F.col("speaker"), F.col("text")))
    verdict, bad = judge_verdict(F.col("has_entry"), F.col("matched_fact_id"), F.col("fits"), F.col("reason"))
    rows = rows.withColumns({"verdict": verdict, "bad_reference": bad})
    quoted = F.col("verdict").isin("span_invalid", "supported", "supported_offsheet")
    return rows.select(
        *key, "claim_id", "field", F.lit("judge").alias("method"), "verdict", F.when(F.col("verdict") == "supported", F.col("matched_fact_id")).alias("matched_fact_id"),
        *[F.when(quoted, F.col(c)).alias(c) for c in ("span_turn_id", "span_text")], "specificity", "bad_reference",
    )


def retried(first: DataFrame, again: DataFrame, facts: DataFrame, turns: DataFrame, key: list[str]) -> DataFrame:
    """``first`` with the second judging of its span_invalid claims that ``again`` has an entry for, and ``first_pass`` to tell which those were."""
    failing = first.where("verdict = 'span_invalid'").select(*key, "claim_id", "field")
    answered = matched(failing, again.select(*key, "claim_id").distinct(), [*key, "claim_id"], "left_semi")
    names = [c for c in first.columns if c not in (*key, "claim_id")]
    second = judged(answered, again, facts, turns, key).select(*key, "claim_id", F.struct(*names).alias("second"))
    rows = matched(first.withColumn("first_pass", F.col("verdict") == "span_invalid"), second, [*key, "claim_id"], "left")
    now = [F.when(F.col("second").isNotNull(), F.col(f"second.{c}")).otherwise(F.col(c)).alias(c) for c in names if c != "bad_reference"]
    bad = (F.col("bad_reference").cast("int") + F.coalesce(F.col("second.bad_reference").cast("int"), F.lit(0))).alias("bad_references")
    return rows.select(*key, "claim_id", *now, bad, "first_pass")


def cited_turns(alignments: DataFrame, turns: DataFrame, key: list[str]) -> DataFrame:
    """The user turns that misquoted spans name, as lines for a second asking: (key, lines)."""
    from proofmill.operators.transcripts import rendered

    asked = alignments.where("verdict = 'span_invalid'").select(*key, F.col("span_turn_id").alias("turn_id")).distinct()
    return rendered(matched(turns.where("speaker = 'user'"), asked, [*key, "turn_id"], "left_semi"), key)


def health(alignments: DataFrame, key: list[str]) -> DataFrame:
    """Calls, judged claims, errors, invalid spans at first and in the end, and bad references of judged alignments."""
    found = alignments.where("method = 'judge'").groupBy(*key).agg(
        (1 + F.max(F.col("first_pass").cast("int"))).cast("long").alias("calls"), F.count("*").alias("judged_claims"), F.count_if(F.col("verdict") == "judge_error").alias("errors"),
        F.count_if(F.col("verdict") == "span_invalid").alias("span_invalid"), F.count_if("first_pass").alias("span_invalid_first_pass"), F.sum("bad_references").alias("invalid_fact_refs"),
    )
    return found


def pooled_health(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums, the error rate (0 without judged claims) and whether it is above the bound."""
    sums = [F.sum(c).alias(c) for c in ("calls", "judged_claims", "errors", "span_invalid", "span_invalid_first_pass")]
    rate = F.coalesce(F.try_divide((F.col("errors") + F.col("span_invalid")).cast("double"), F.col("judged_claims").cast("double")), F.lit(0.0))
    return found.groupBy(*(by or [])).agg(*sums).withColumn("error_rate", rate).withColumn("degraded", F.col("error_rate") > C.DEGRADED_ABOVE)
