"""Evaluation views over the driver's tables: facts, alignments, coverage, turns.

Each view exists twice, as a DataFrame and as SQL text for an independent
engine. All random parts are draws from a row's own keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.functions import constants as C
from proofmill.functions.stats import draw
from proofmill.functions.text import word_count

FIELD_BY_PRIORITY = {"1-URGENT": "relationship_goal", "2-HIGH": "wants_kids", "3-MEDIUM": "occupation", "4-NOT SPECIFIED": "interests", "5-LOW": "dealbreakers"}


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    fact, by = F.col("o_orderkey"), F.create_map(*[F.lit(x) for p in FIELD_BY_PRIORITY.items() for x in p])
    d, v = draw("d:", fact), draw("v:", fact)
    truth = F.col("o_orderstatus")
    rows = o.select(
        F.col("o_custkey").alias("persona_id"), fact.alias("fact_id"), F.element_at(by, F.col("o_orderpriority")).alias("field"), truth.alias("value"),
        F.when(d < 0.6, "volunteer").when(d < 0.9, "needs_followup").otherwise("hedge").alias("disclosure"),
        F.when(draw("s:", fact) < 0.6, "specific").otherwise("generic").alias("specificity"),
        (draw("e:", fact) < 0.85).alias("elicited"), (draw("f:", fact) < 0.3).alias("via_followup"),
        F.concat(F.lit("q"), F.lpad((fact % 10 + 1).cast("string"), 2, "0")).alias("question_id"),
        (draw("c:", fact) < 0.85).alias("claimed"), F.when(v < 0.8, truth).when(v < 0.88, "unsure").otherwise("X").alias("claim"),
    )
    return rows.join(c, rows.persona_id == c.c_custkey, "left").drop("c_custkey").withColumnRenamed("c_mktsegment", "style")


def alignments(spark, sf_dir: str) -> DataFrame:
    """Facts that are claimed, with method and verdict."""
    rows = facts(spark, sf_dir).where("claimed")
    exact = F.col("field").isin(*C.EXACT_FIELDS)
    match = F.col("claim") == F.col("value")
    j = draw("j:", F.col("fact_id"))
    by_value = F.when(match, "supported").when(F.col("field").isin(*C.UNSURE_FIELDS) & (F.col("claim") == "unsure"), "abstained").otherwise("unsupported")
    by_judge = F.when(j < 0.05, "judge_error").when(j < 0.1, "span_invalid").when(match, "supported").when(draw("o:", F.col("fact_id")) < 0.5, "supported_offsheet").otherwise("unsupported")
    return rows.withColumns({"method": F.when(exact, "exact").otherwise("judge"), "verdict": F.when(exact, by_value).otherwise(by_judge)})


def coverage(spark, sf_dir: str) -> DataFrame:
    """Facts with captured."""
    return facts(spark, sf_dir).withColumn("captured", F.col("claimed") & (F.col("claim") == F.col("value")))


def turns(spark, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.select(
        F.col("conv_id").alias("transcript_id"), F.col("turn").alias("turn_ord"), "role",
        F.when(F.col("role") == "user", "user").otherwise("interviewer").alias("speaker"),
        F.concat(F.lit("q"), F.lpad((F.floor(F.col("turn") / 4) + 1).cast("string"), 2, "0")).alias("question_id"),
        (F.col("turn") % 4 >= 2).alias("is_followup"), "text", word_count(F.col("text")).alias("word_count"),
    )


def u(key: str) -> str:
    """The draw in SQL."""
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


#: White space in the other engine's expressions, whose own class lacks what Unicode has beyond ASCII.
BLANKS_SQL = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]"


def tokens_sql(text: str = "text") -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{BLANKS_SQL}+'), lambda w: w <> '')"


EXACT_SQL = ", ".join(f"'{f}'" for f in C.EXACT_FIELDS)
FIRM_SQL = ", ".join(f"'{f}'" for f in C.DEALBREAKER_FIELDS)
FACTS_SQL = f"""facts AS (
  SELECT o_custkey AS persona_id, o_orderkey AS fact_id,
    CASE o_orderpriority {" ".join(f"WHEN '{p}' THEN '{f}'" for p, f in FIELD_BY_PRIORITY.items())} END AS field,
    o_orderstatus AS value, c_mktsegment AS style,
    CASE WHEN {u("'d:' || o_orderkey")} < 0.6 THEN 'volunteer' WHEN {u("'d:' || o_orderkey")} < 0.9 THEN 'needs_followup' ELSE 'hedge' END AS disclosure,
    CASE WHEN {u("'s:' || o_orderkey")} < 0.6 THEN 'specific' ELSE 'generic' END AS specificity,
    {u("'e:' || o_orderkey")} < 0.85 AS elicited, {u("'f:' || o_orderkey")} < 0.3 AS via_followup,
    'q' || lpad((o_orderkey % 10 + 1)::VARCHAR, 2, '0') AS question_id,
    {u("'c:' || o_orderkey")} < 0.85 AS claimed,
    CASE WHEN {u("'v:' || o_orderkey")} < 0.8 THEN o_orderstatus WHEN {u("'v:' || o_orderkey")} < 0.88 THEN 'unsure' ELSE 'X' END AS claim
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""
ALIGNMENTS_SQL = f"""alignments AS (
  SELECT *, CASE WHEN field IN ({EXACT_SQL}) THEN 'exact' ELSE 'judge' END AS method,
    CASE WHEN field IN ({EXACT_SQL}) THEN CASE WHEN claim = value THEN 'supported' WHEN claim = 'unsure' AND field IN ('relationship_goal', 'wants_kids') THEN 'abstained' ELSE 'unsupported' END
      WHEN {u("'j:' || fact_id")} < 0.05 THEN 'judge_error' WHEN {u("'j:' || fact_id")} < 0.1 THEN 'span_invalid'
      WHEN claim = value THEN 'supported' WHEN {u("'o:' || fact_id")} < 0.5 THEN 'supported_offsheet' ELSE 'unsupported' END AS verdict
  FROM facts WHERE claimed)"""
COVERAGE_SQL = "coverage AS (SELECT *, claimed AND claim = value AS captured FROM facts)"
TURNS_SQL = f"""turns AS (
  SELECT conv_id AS transcript_id, turn AS turn_ord, role, CASE WHEN role = 'user' THEN 'user' ELSE 'interviewer' END AS speaker,
    'q' || lpad((turn // 4 + 1)::VARCHAR, 2, '0') AS question_id, turn % 4 >= 2 AS is_followup, text, len({tokens_sql()})::BIGINT AS word_count
  FROM conversations)"""
