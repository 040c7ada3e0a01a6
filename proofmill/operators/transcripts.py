"""Transcripts as text, and which of them a count of minutes may read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.functions import constants as C


def rendered(turns: DataFrame, key: list[str]) -> DataFrame:
    """(key, lines): ``[turn speaker] text``, a line a turn, in their order."""
    line = F.concat(F.lit("["), F.col("turn_id"), F.lit(" "), F.col("speaker"), F.lit("] "), F.col("text"))
    found = turns.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("turn_ord", line.alias("line")))).alias("x"))
    return found.select(*key, F.array_join("x.line", "\n").alias("lines"))


def headers(turns: DataFrame, key: list[str]) -> DataFrame:
    """(key, turns, words, simulated_minutes)."""
    found = turns.groupBy(*key).agg(F.count("*").alias("turns"), F.sum("word_count").alias("words"))
    return found.withColumn("simulated_minutes", F.bround(F.col("words") / float(C.WORDS_PER_MINUTE), 4))


def source_problems(scored: DataFrame, clean: DataFrame) -> DataFrame:
    """(transcript_id, problem) of scored transcripts whose clean source may not be read for times.

    Both: transcript_id, persona_id, noise_rate, source_transcript_id. A noised
    transcript needs its source, which must be clean and of the same persona.
    """
    source = clean.select(F.col("transcript_id").alias("source_transcript_id"), F.col("persona_id").alias("_persona"), F.col("noise_rate").alias("_rate"), F.col("source_transcript_id").alias("_source"))
    rows = scored.join(source, "source_transcript_id", "left")
    noised = (F.col("noise_rate") > 0) | F.col("source_transcript_id").isNotNull()
    problem = (
        F.when(noised & F.col("_rate").isNull(), "no_source")
        .when(F.col("_rate").isNotNull() & ((F.col("_rate") > 0) | F.col("_source").isNotNull()), "source_is_noised")
        .when(F.col("_persona") != F.col("persona_id"), "source_of_another_persona")
    )
    return rows.select("transcript_id", problem.alias("problem")).where("problem is not null")


def unclean(transcripts: DataFrame) -> DataFrame:
    """Transcripts that an audit of disclosures must not read."""
    return transcripts.where("noise_rate > 0 or source_transcript_id is not null").select("transcript_id")
