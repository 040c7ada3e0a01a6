"""Interviews: canned answers and decisions played through a script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.functions import constants as C
from proofmill.functions.text import is_blank, status_in, word_count
from proofmill.operators.joins import matched


def sanitized(reported: Column, known: Column) -> tuple[Column, Column]:
    """Reported ids that exist, each once in the order reported, and those that were made up."""
    return F.array_distinct(F.filter(reported, lambda f: F.array_contains(known, f))), F.filter(reported, lambda f: ~F.array_contains(known, f))


def follow_up(answer: Column, targets: Column, addressed: Column, proposed: Column, trigger: int = C.FOLLOWUP_TRIGGER_WORDS) -> tuple[Column, Column]:
    """Targets that were addressed, and the follow-up that is asked: a proposed one after a short answer or with a target left; none is made up."""
    done = F.filter(F.coalesce(addressed, F.array().cast("array<string>")), lambda t: F.array_contains(targets, t))
    wanted = (word_count(answer) < trigger) | (F.size(F.array_except(targets, done)) > 0)
    return done, F.when(wanted & ~is_blank(proposed), F.trim(proposed))


def simulate(personas: DataFrame, script: list[dict], answers: DataFrame, decisions: DataFrame, trigger: int = C.FOLLOWUP_TRIGGER_WORDS) -> tuple[DataFrame, DataFrame]:
    """Turns of the interviews that came to their end, and for each persona its status and counts.

    ``personas``: persona_id, known (its fact ids). ``script``: questions in
    order, each with question_id, text, targets and max_followups. ``answers``:
    persona_id, question_id, k, utterance, reported, error, of the question
    itself (k = 0) and its follow-ups. ``decisions``: persona_id, question_id,
    k, addressed, followup, error, of what is asked before answer k.

    An answer that fails, or has no words, fails its persona; a decision that
    fails ends the question and is counted. All questions are played side by
    side: whether answer k is reached depends on the question's own decisions
    up to k, as the agents see none but them.
    """
    key = ["persona_id", "question_id", "k"]
    steps = F.array(*[F.struct(F.lit(n).alias("place"), F.lit(q["question_id"]).alias("question_id"), F.lit(q["text"]).alias("question"), F.array(*map(F.lit, q["targets"])).alias("targets"), F.lit(k).alias("k")) for n, q in enumerate(script) for k in range(q.get("max_followups", 1) + 1)])
    rows = personas.select("persona_id", "known", F.explode(steps).alias("s")).select("persona_id", "known", "s.*")
    said = answers.select(*key, "utterance", "reported", F.col("error").alias("answer_error"))
    asked = decisions.select(*key, "addressed", "followup", F.col("error").alias("decision_error"))
    rows = matched(matched(rows, said, key, "left"), asked, key, "left")
    question = Window.partitionBy("persona_id", "question_id").orderBy("k")
    _, wanted = follow_up(F.lag("utterance").over(question), F.col("targets"), F.col("addressed"), F.col("followup"), trigger)
    rows = rows.withColumn("asks", F.when(F.col("k") == 0, F.col("question")).when(F.col("decision_error").isNull(), wanted))
    rows = rows.withColumn("reached", F.min(F.col("asks").isNotNull().cast("int")).over(question) == 1)
    rows = rows.withColumn("tried", F.coalesce(F.lag("reached").over(question), F.lit(True)))
    empty = F.col("utterance").isNull() | is_blank(F.coalesce("utterance", F.lit("")))
    problem = F.when(F.col("reached"), F.coalesce(F.col("answer_error"), F.when(empty, "user agent returned an empty utterance")))
    told, invented = sanitized(F.coalesce("reported", F.array().cast("array<string>")), F.col("known"))
    rows = rows.withColumns({"problem": problem, "told": told, "invented": invented})

    first = F.min(F.when(F.col("problem").isNotNull(), F.struct("place", "k", "problem")))
    results = rows.groupBy("persona_id").agg(
        first["problem"].alias("problem"),
        F.count_if(F.col("tried") & (F.col("k") > 0) & F.col("decision_error").isNotNull()).alias("followup_errors"),
        F.sum(F.when(F.col("reached"), F.size("invented")).otherwise(0)).alias("invented"),
    )
    results = results.select("persona_id", F.when(F.col("problem").isNull(), "ok").otherwise(status_in(F.col("problem"))).alias("status"), "followup_errors", "invented")

    none = F.array().cast("array<string>")
    pair = F.array(F.struct(F.lit("interviewer").alias("speaker"), F.col("asks").alias("text"), none.alias("disclosed")), F.struct(F.lit("user").alias("speaker"), F.trim("utterance").alias("text"), F.col("told").alias("disclosed")))
    whole = Window.partitionBy("persona_id").orderBy("place", "k", "side")
    turns = matched(rows.where("reached"), results.where("status = 'ok'").select("persona_id"), "persona_id")
    turns = turns.select("persona_id", "place", "k", "question_id", F.posexplode(pair).alias("side", "t")).withColumn("turn_ord", F.row_number().over(whole))
    turns = turns.select(
        "persona_id", "turn_ord", F.format_string("t%03d", "turn_ord").alias("turn_id"), "t.speaker", "question_id", (F.col("k") > 0).alias("is_followup"),
        "t.text", word_count(F.col("t.text")).alias("word_count"), F.col("t.disclosed").alias("disclosed_fact_ids"),
    )
    return turns, results
