"""Which facts were disclosed and captured, and audits of what the user claims to have disclosed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.functions import constants as C
from proofmill.functions.text import anchor_tokens, token_set
from proofmill.operators.joins import matched


def disclosures(turns: DataFrame, key: list[str]) -> DataFrame:
    """(key, fact_id) with the first user turn that discloses it: disclosed_turn_id, question_id, via_followup."""
    told = turns.where("speaker = 'user'").select(*key, F.explode("disclosed_fact_ids").alias("fact_id"), F.struct("turn_ord", "turn_id", "question_id", "is_followup").alias("t"))
    return told.groupBy(*key, "fact_id").agg(F.min("t").alias("t")).select(*key, "fact_id", F.col("t.turn_id").alias("disclosed_turn_id"), "t.question_id", F.col("t.is_followup").alias("via_followup"))


def coverage(facts: DataFrame, alignments: DataFrame, turns: DataFrame, key: list[str]) -> DataFrame:
    """Each fact with the first supported claim on it, exact ones before judged ones, and the turn that disclosed it."""
    order = F.struct((F.col("method") != "exact").alias("m"), "claim_id")
    won = alignments.where("verdict = 'supported' and matched_fact_id is not null").groupBy(*key, F.col("matched_fact_id").alias("fact_id")).agg(F.min_by("claim_id", order).alias("by_claim_id"))
    rows = matched(matched(facts, won, [*key, "fact_id"], "left"), disclosures(turns, key), [*key, "fact_id"], "left")
    return rows.withColumn("captured", F.col("by_claim_id").isNotNull())


def rechecked(covered: DataFrame, alignments: DataFrame, key: list[str]) -> DataFrame:
    """With ``counts``: captured, and the claim it cites is supported (or none is cited); and ``problem`` where the claim has no alignment."""
    cited = alignments.select(*key, F.col("claim_id").alias("by_claim_id"), F.col("verdict").alias("_verdict"))
    rows = matched(covered, cited, [*key, "by_claim_id"], "left")
    named = F.col("by_claim_id").isNotNull()
    good = F.col("captured") & (~named | F.coalesce(F.col("_verdict") == "supported", F.lit(False)))
    return rows.withColumns({"counts": good, "problem": F.when(F.col("captured") & named & F.col("_verdict").isNull(), "no_alignment")}).drop("_verdict")


def unknown_facts(covered: DataFrame, facts: DataFrame, key: list[str]) -> DataFrame:
    """Coverage of facts that no sheet has."""
    return matched(covered, facts.select(*key, "fact_id"), [*key, "fact_id"], "left_anti")


def mismatches(facts: DataFrame, turns: DataFrame, key: list[str]) -> DataFrame:
    """(key, fact_id, state) of judged, specific and tagged facts: spoken, mismatched, or unverifiable without an anchor.

    All turns that tag the fact are searched for any of its anchors. ``turns`` must be those of clean transcripts.
    """
    asked = facts.where(F.col("field").isin(*C.JUDGED_FIELDS) & (F.col("specificity") == "specific")).select(*key, "fact_id", anchor_tokens(F.when(F.col("kind") == "str", F.col("value"))).alias("anchors"))
    tagged = turns.select(*key, F.explode("disclosed_fact_ids").alias("fact_id"), token_set(F.col("text")).alias("tokens"))
    rows = matched(tagged, asked, [*key, "fact_id"]).groupBy(*key, "fact_id").agg(F.first("anchors").alias("anchors"), F.max(F.arrays_overlap("anchors", "tokens")).alias("hit"))
    return rows.select(*key, "fact_id", F.when(F.size("anchors") == 0, "unverifiable").when(F.col("hit"), "spoken").otherwise("mismatched").alias("state"))


def untagged(covered: DataFrame, alignments: DataFrame, turns: DataFrame, key: list[str]) -> DataFrame:
    """(key, fact_id, note) of facts captured by a judged span that no turn tags, or that stands before the transcript's first tag."""
    tags = turns.select(*key, F.explode("disclosed_fact_ids").alias("fact_id")).distinct().withColumn("tagged", F.lit(True))
    firsts = turns.where(F.size("disclosed_fact_ids") > 0).groupBy(*key).agg(F.min("turn_ord").alias("first_tagged"))
    cited = alignments.where("method = 'judge' and verdict = 'supported' and span_turn_id is not null").select(*key, F.col("claim_id").alias("by_claim_id"), F.col("span_turn_id").alias("turn_id"))
    rows = matched(matched(covered.where("captured").select(*key, "fact_id", "by_claim_id"), cited, [*key, "by_claim_id"]), turns.select(*key, "turn_id", "turn_ord"), [*key, "turn_id"], "left")
    rows = matched(matched(rows, tags, [*key, "fact_id"], "left"), firsts, key, "left")
    note = F.when(F.col("tagged").isNull(), "no turn tags it").when(F.col("turn_ord") < F.col("first_tagged"), "cited before the first tag")
    return rows.select(*key, "fact_id", note.alias("note")).where("note is not null")
