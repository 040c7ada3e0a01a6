"""Transcription noise: one seeded draw decides whether a word is hit, another how."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.functions import constants as C
from proofmill.functions.misheard import CONFUSIONS, HOMOPHONES, MIN_CLIPPED
from proofmill.functions.stats import draw
from proofmill.functions.text import match_case, noise_token, split_token, strip_punctuation, tokens, word_count


def operation_of(u: Column) -> Column:
    """The operation whose cumulative weight is first above the draw."""
    upto, out = 0.0, None
    for name, weight in C.OPERATION_WEIGHTS[:-1]:
        upto = round(upto + weight, 10)
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return out.otherwise(C.OPERATION_WEIGHTS[-1][0])


def words_of_turns(turns: DataFrame) -> DataFrame:
    """(transcript_id, turn_ord, wi, word) of user turns, wi from 0."""
    return turns.where("speaker = 'user'").select("transcript_id", "turn_ord", F.posexplode(tokens(F.col("text"))).alias("wi", "word"))


def edits(words: DataFrame, rate: float, seed: int = 7) -> DataFrame:
    """Every word with fired and its operation (null where not). A word's draws depend on its place alone."""
    if not 0 <= rate <= 1:
        raise ValueError(f"a noise rate is between 0 and 1: {rate}")
    key = [f"{seed}:", F.col("transcript_id"), ":", F.col("turn_ord"), ":", F.col("wi")]
    fired = draw(*key, ":a") < rate
    return words.withColumn("fired", fired).withColumn("operation", F.when(F.col("fired"), operation_of(draw(*key, ":b"))))


def sentence_index(words: DataFrame) -> DataFrame:
    """With the number of sentence ends before each word of its turn."""
    ends = F.regexp_replace("word", "[\"')\\]}]+$", "").rlike("[.!?]$").cast("int")
    before = Window.partitionBy("transcript_id", "turn_ord").orderBy("wi").rowsBetween(Window.unboundedPreceding, -1)
    return words.withColumn("sentence", F.coalesce(F.sum(ends).over(before), F.lit(0)).cast("long"))


def struck(edited: DataFrame) -> DataFrame:
    """A punctuation hit strips all words of its sentence; only the first that finds punctuation there changes it."""
    whole = Window.partitionBy("transcript_id", "turn_ord", "sentence")
    hit = F.col("operation") == "punctuation"
    has = F.col("word").rlike("[.,;:!?]")
    first = F.row_number().over(Window.partitionBy("transcript_id", "turn_ord", "sentence", F.coalesce(hit, F.lit(False))).orderBy("wi"))
    rows = edited.withColumn("stripped", F.coalesce(F.max(hit.cast("int")).over(whole), F.lit(0)) > 0)
    return rows.withColumn("changed", F.coalesce(hit, F.lit(False)) & (first == 1) & (F.max(has.cast("int")).over(whole) > 0))


def noised_words(edited: DataFrame) -> DataFrame:
    """(transcript_id, turn_ord, word_count) after the edits: a drop takes a word, a filler adds its words."""
    filler = filler_of([F.col("transcript_id"), ":", F.col("turn_ord"), ":", F.col("wi")])
    left = F.when(F.col("operation") == "drop", 0).when(F.col("operation") == "filler", 1 + F.size(F.split(filler, " "))).otherwise(1)
    return edited.groupBy("transcript_id", "turn_ord").agg(F.sum(left).alias("word_count"))


def filler_of(key: list) -> Column:
    fillers = F.array(*map(F.lit, C.FILLERS))
    return F.element_at(fillers, (F.floor(draw(*key, ":f") * len(C.FILLERS)) + 1).cast("int"))


def sites(word: Column) -> Column:
    """Places where a confusion of letters fits the lower-cased word: (at, n, r) in order of confusions, then of places."""

    def of(pattern: str, other: str) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.substr(word, i, F.lit(len(pattern))) == pattern)
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(len(pattern)).alias("n"), F.lit(other).alias("r")))

    return F.when(word == "", F.array().cast("array<struct<at: int, n: int, r: string>>")).otherwise(F.concat(*[of(*c) for c in CONFUSIONS]))


def character_variant(core: Column, u: Column) -> Column:
    """One confusion of letters chosen by the draw; else the last letter of a longer word goes; else the word stays."""
    fits = sites(F.lower(core))
    site = F.get(fits, F.floor(u * F.size(fits)).cast("int"))
    changed = F.concat(F.substr(core, F.lit(1), site["at"] - 1), site["r"], F.substr(core, site["at"] + site["n"]))
    clipped = F.when(F.char_length(core) >= MIN_CLIPPED, F.substr(core, F.lit(1), F.char_length(core) - 1)).otherwise(core)
    return F.coalesce(F.when(F.size(fits) > 0, changed), clipped)


def swapped(token: Column, u: Column) -> tuple[Column, Column]:
    """A mishearing of the token in its case and punctuation, and where it is from: dictionary, character or unchanged."""
    parts = split_token(token)
    core = parts["core"]
    words = F.create_map(*[x for w, others in HOMOPHONES.items() for x in (F.lit(w), F.array(*map(F.lit, others)))])
    known = F.try_element_at(words, F.lower(core))
    heard = F.get(known, F.floor(u * F.size(known)).cast("int"))
    other = F.when(known.isNotNull(), match_case(core, heard)).otherwise(character_variant(core, u))
    source = F.when(core == "", "unchanged").when(known.isNotNull(), "dictionary").when(other == core, "unchanged").otherwise("character")
    return F.when(core == "", token).otherwise(F.concat(parts["lead"], other, parts["trail"])), source


def noised_pieces(edited: DataFrame) -> DataFrame:
    """Edited words (with stripped, by ``struck``) and what each becomes: piece (null if dropped), result, source and filler."""
    key = [F.col("transcript_id"), ":", F.col("turn_ord"), ":", F.col("wi")]
    op, (other, source) = F.col("operation"), swapped(F.col("word"), draw(*key, ":s"))
    rows = edited.withColumns({
        "result": F.when(op == "homophone", other), "source": F.when(op == "homophone", source), "filler": F.when(op == "filler", filler_of(key)),
    })
    said = F.coalesce("result", "word")
    said = F.when(F.col("stripped"), strip_punctuation(said)).otherwise(said)
    return rows.withColumn("piece", F.when(op == "drop", None).when(op == "filler", F.concat("filler", F.lit(" "), said)).otherwise(said))


def noised_turns(turns: DataFrame, rate: float, seed: int = 7) -> DataFrame:
    """``turns`` with the user's texts noised and their words counted anew; all else, disclosures too, stays."""
    pieces = noised_pieces(struck(sentence_index(edits(words_of_turns(turns), rate, seed))))
    made = pieces.groupBy("transcript_id", "turn_ord").agg(F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("wi", "piece")))).alias("p"))
    rows = turns.join(made.select("transcript_id", "turn_ord", F.array_join("p.piece", " ").alias("_noised")), ["transcript_id", "turn_ord"], "left")
    text = F.when(F.col("speaker") == "user", F.coalesce("_noised", F.lit(""))).otherwise(F.col("text"))
    return rows.withColumn("text", text).withColumn("word_count", word_count(F.col("text"))).drop("_noised").select(*turns.columns)


def noised_headers(headers: DataFrame, turns: DataFrame, rate: float, seed: int = 7) -> DataFrame:
    """Headers of the noised copies (transcript_id, persona_id, noise_rate, noise_seed, source_transcript_id, simulated_minutes).

    ``headers`` are of clean transcripts (transcript_id, persona_id, noise_rate);
    noising a noised one is an error. At rate 0 the copy is the transcript itself.
    """
    clean = F.when(F.col("noise_rate") > 0, F.raise_error(F.concat(F.lit("already noised: "), F.col("transcript_id").cast("string")))).otherwise(F.col("transcript_id").cast("string"))
    words = turns.groupBy("transcript_id").agg(F.sum("word_count").alias("words"))
    named = F.concat(F.col("clean"), F.lit("__"), noise_token(F.lit(rate))) if rate else F.col("clean")
    rows = headers.join(words, "transcript_id").withColumn("clean", clean)
    return rows.select(
        named.alias("transcript_id"), "persona_id", F.lit(float(rate)).alias("noise_rate"), F.lit(seed if rate else None).cast("int").alias("noise_seed"),
        (F.col("clean") if rate else F.lit(None).cast("string")).alias("source_transcript_id"), F.bround(F.col("words") / float(C.WORDS_PER_MINUTE), 4).alias("simulated_minutes"),
    )


def edit_logs(pieces: DataFrame, rate: float, seed: int = 7) -> DataFrame:
    """(transcript_id, log): for each transcript the edits of its turns as JSON, where they fired and what they did."""
    punctuation = F.col("operation") == "punctuation"
    edit = F.struct(F.col("wi").alias("word_index"), "word", "operation", "result", "source", "filler", F.when(punctuation, F.col("sentence")).alias("sentence_index"), F.when(punctuation, F.col("changed")).alias("changed"))
    by_turn = pieces.groupBy("transcript_id", "turn_ord").agg(F.count("*").alias("words"), F.count_if("fired").alias("edit_count"), F.sort_array(F.collect_list(F.when(F.col("fired"), edit))).alias("edits"))
    whole = by_turn.groupBy("transcript_id").agg(F.sum("words").alias("user_words"), F.sum("edit_count").alias("edit_count"), F.sort_array(F.collect_list(F.struct("turn_ord", "words", "edit_count", "edits"))).alias("turns"))
    return whole.select("transcript_id", "user_words", "edit_count", F.to_json(F.struct("edit_count", F.lit(float(rate)).alias("noise_rate"), F.lit(seed).alias("noise_seed"), F.col("transcript_id").alias("source_transcript_id"), "turns", "user_words")).alias("log"))
