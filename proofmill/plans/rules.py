"""Integrity rules over seeded faults, one query a table, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofmill.functions import constants as C
from proofmill.functions.stats import draw
from proofmill.operators import integrity, transcripts
from proofmill.operators.joins import matched
from proofmill.plans.lab import TALLIES_SQL
from proofmill.sources import lab as L
from proofmill.sources.evaluation import tokens_sql, u

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def _u(tag: str, *columns: str):
    parts = [f"{tag}:"]
    for c in columns:
        parts += [F.col(c), ":"]
    return draw(*parts)


def _s(tag: str, *columns: str) -> str:
    return u(f"'{tag}:' || " + " || ':' || ".join(columns) + " || ':'")


def _counts(source: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) AS n FROM {source} WHERE {bad}" for r, bad in rules.items())


P, PF = ("persona_id",), ("persona_id", "fact_id")


@query("sheet_rules", f"""WITH {L.FACTS_SQL}, bad AS (SELECT f.* REPLACE (CASE WHEN kind = 'str' AND fact_id > 'f05' AND {_s("L2b", *PF)} < 0.01 THEN 'hobby' ELSE field END AS field), CASE WHEN {_s("L1", *PF)} < 0.01 THEN 'decoy' END AS decoy_value FROM facts f, (VALUES (0), (1)) v(again)
  WHERE NOT (fact_id < 'f06' AND {_s("L2a", *PF)} < 0.01) AND (again = 0 OR {_s("L2c", *PF)} < 0.005))
{_counts("bad", {"decoy_without_contradict": "decoy_value IS NOT NULL AND disclosure <> 'contradict'", "fact_of_unknown_field": "field = 'hobby'"})}
UNION ALL SELECT 'repeated_fact_id', count(*) FROM (SELECT 1 FROM bad GROUP BY persona_id, fact_id HAVING count(*) > 1)
UNION ALL SELECT 'exact_field_not_once', count(*) FROM (SELECT s.persona_id, e.field FROM sheets s, (SELECT unnest([{', '.join(repr(f) for f in C.EXACT_FIELDS)}]) AS field) e LEFT JOIN bad b ON b.persona_id = s.persona_id AND b.field = e.field GROUP BY ALL HAVING count(b.fact_id) <> 1)""")
def sheet_rules(spark, sf_dir):
    lab = L.lab(spark, sf_dir)
    first = F.col("fact_id") < "f06"
    rows = lab.facts.where(~(first & (_u("L2a", *PF) < 0.01)))
    rows = rows.withColumn("again", F.explode(F.when(_u("L2c", *PF) < 0.005, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("again")
    rows = rows.withColumns({"decoy_value": F.when(_u("L1", *PF) < 0.01, "decoy"), "field": F.when((F.col("kind") == "str") & ~first & (_u("L2b", *PF) < 0.01), "hobby").otherwise(F.col("field"))})
    return integrity.sheet_violations(rows, lab.sheets, ["persona_id"])


_Q = ", ".join(f"('{q['question_id']}', ['{q['targets'][0]}', '{q['targets'][1]}'])" for q in L.SCRIPT)


@query("script_rules", f"""WITH q AS (SELECT c_custkey, CASE WHEN {_s("L3a", "c_custkey", "question_id")} < 0.01 THEN 'q01' ELSE question_id END AS question_id, CASE WHEN {_s("L3b", "c_custkey", "question_id")} < 0.01 THEN ['summary', 'hobby'] ELSE targets END AS targets FROM customer, (VALUES {_Q}) v(question_id, targets))
SELECT 'unknown_target' AS rule, count(*) AS n FROM q WHERE list_contains(targets, 'hobby') UNION ALL SELECT 'repeated_question_id', count(*) FROM (SELECT 1 FROM q GROUP BY c_custkey, question_id HAVING count(*) > 1)""")
def script_rules(spark, sf_dir):
    each = F.array(*[F.struct(F.lit(q["question_id"]).alias("question_id"), F.array(*map(F.lit, q["targets"])).alias("targets")) for q in L.SCRIPT])
    rows = L.table(spark, sf_dir, "customer").select("c_custkey", F.explode(each).alias("q")).select("c_custkey", "q.*")
    key = ("c_custkey", "question_id")
    rows = rows.withColumns({"targets": F.when(_u("L3b", *key) < 0.01, F.array(F.lit("summary"), F.lit("hobby"))).otherwise(F.col("targets")), "question_id": F.when(_u("L3a", *key) < 0.01, "q01").otherwise(F.col("question_id"))})
    return integrity.script_violations(rows, ["c_custkey"])


PT = ("persona_id", "turn_id")


@query("turn_rules", f"""WITH {L.TURNS_SQL}, bad AS (SELECT speaker, is_followup, text, CASE WHEN {_s("L4a", *PT)} < 0.01 THEN word_count + 1 ELSE word_count END AS word_count, CASE WHEN {_s("L4b", *PT)} < 0.02 THEN NULL ELSE question_id END AS question_id,
  CASE WHEN {_s("L4c", *PT)} < 0.01 THEN list_concat(disclosed_fact_ids, ['f01', 'f01']) ELSE disclosed_fact_ids END AS told FROM turns)
{_counts("bad", {"word_count_off": f"word_count <> len({tokens_sql()})", "interviewer_discloses": "speaker <> 'user' AND len(told) > 0", "followup_without_question": "is_followup AND question_id IS NULL", "fact_disclosed_twice": "len(told) <> len(list_distinct(told))"})}""")
def turn_rules(spark, sf_dir):
    t = L.lab(spark, sf_dir).turns
    rows = t.withColumns({
        "disclosed_fact_ids": F.when(_u("L4c", *PT) < 0.01, F.concat("disclosed_fact_ids", F.array(F.lit("f01"), F.lit("f01")))).otherwise(F.col("disclosed_fact_ids")),
        "word_count": F.when(_u("L4a", *PT) < 0.01, F.col("word_count") + 1).otherwise(F.col("word_count")), "question_id": F.when(_u("L4b", *PT) >= 0.02, F.col("question_id")),
    })
    return integrity.violations(rows, integrity.turn_rules())


@query("transcript_rules", f"""WITH {L.TURNS_SQL}, h AS (SELECT persona_id, sum(word_count) AS words, round_even(sum(word_count) / 150.0::DOUBLE, 4) AS minutes FROM turns GROUP BY 1),
bad AS (SELECT *, CASE WHEN {_s("L5a", *P)} < 0.3 THEN 0.1 ELSE 0.0 END AS noise_rate, CASE WHEN {_s("L5b", *P)} < 0.2 THEN 7 END AS noise_seed, CASE WHEN {_s("L5c", *P)} < 0.25 THEN 'x' END AS source, minutes + CASE WHEN {_s("L5d", *P)} < 0.05 THEN 0.01 WHEN {_s("L5d", *P)} < 0.1 THEN 0.00005 ELSE 0 END AS simulated FROM h),
twice AS (SELECT persona_id, CASE WHEN {_s("L5e", *PT)} < 0.002 THEN 't001' ELSE turn_id END AS turn_id FROM turns)
{_counts("bad", {"noised_without_seed": "noise_rate > 0 AND noise_seed IS NULL", "noised_without_source": "noise_rate > 0 AND source IS NULL", "clean_with_source": "noise_rate = 0 AND source IS NOT NULL", "minutes_off": "abs(simulated - minutes) > 1e-4", "audit_of_a_noised_copy": "noise_rate > 0 OR source IS NOT NULL"})}
UNION ALL SELECT 'repeated_turn_id', count(*) FROM (SELECT 1 FROM twice GROUP BY persona_id, turn_id HAVING count(*) > 1)""")
def transcript_rules(spark, sf_dir):
    t = L.lab(spark, sf_dir).turns
    d = _u("L5d", *P)
    rows = transcripts.headers(t, L.KEY).withColumns({
        "noise_rate": F.when(_u("L5a", *P) < 0.3, 0.1).otherwise(0.0), "noise_seed": F.when(_u("L5b", *P) < 0.2, 7), "source_transcript_id": F.when(_u("L5c", *P) < 0.25, "x"),
        "simulated_minutes": F.col("simulated_minutes") + F.when(d < 0.05, 0.01).when(d < 0.1, 0.00005).otherwise(0.0), "transcript_id": F.col("persona_id"),
    })
    twice = t.select("persona_id", F.when(_u("L5e", *PT) < 0.002, "t001").otherwise(F.col("turn_id")).alias("turn_id"))
    counted = [integrity._count("audit_of_a_noised_copy", transcripts.unclean(rows)), integrity._count("repeated_turn_id", integrity.repeated(twice, ["persona_id", "turn_id"]))]
    return integrity.violations(rows, integrity.header_rules()).unionByName(counted[0]).unionByName(counted[1])


@query("extraction_rules", f"""WITH {L.CLAIMS_SQL}, n AS (SELECT persona_id, count(*) AS n FROM claims GROUP BY 1), bad AS (SELECT r.persona_id, status, (status = 'ok') <> ({_s("L6a", *[f"r.{c}" for c in P])} < 0.02) AS has_profile, CASE WHEN status <> 'ok' AND {_s("L6b", *[f"r.{c}" for c in P])} < 0.5 THEN 1 ELSE coalesce(n, 0) END AS n_claims FROM results r LEFT JOIN n USING (persona_id)),
twice AS (SELECT persona_id, CASE WHEN {_s("L6c", "persona_id", "claim_id")} < 0.005 THEN 'c01' ELSE claim_id END AS claim_id FROM claims)
{_counts("bad", {"status_against_profile": "(status = 'ok') <> has_profile", "claims_of_a_failure": "status <> 'ok' AND n_claims > 0"})} UNION ALL SELECT 'repeated_claim_id', count(*) FROM (SELECT 1 FROM twice GROUP BY persona_id, claim_id HAVING count(*) > 1)""")
def extraction_rules(spark, sf_dir):
    lab = L.lab(spark, sf_dir)
    n = lab.claims.groupBy("persona_id").agg(F.count("*").alias("n"))
    fine = F.col("status") == "ok"
    rows = matched(lab.played[1], n, "persona_id", "left").withColumns({"has_profile": fine != (_u("L6a", *P) < 0.02), "n_claims": F.when(~fine & (_u("L6b", *P) < 0.5), 1).otherwise(F.coalesce("n", F.lit(0)))})
    twice = lab.claims.select("persona_id", F.when(_u("L6c", "persona_id", "claim_id") < 0.005, "c01").otherwise(F.col("claim_id")).alias("claim_id"))
    return integrity.violations(rows, integrity.extraction_rules()).unionByName(integrity._count("repeated_claim_id", integrity.repeated(twice, ["persona_id", "claim_id"])))


PC = ("persona_id", "claim_id")


@query("alignment_rules", f"""WITH {L.ALIGNED_SQL}, bad AS (SELECT CASE WHEN {_s("L7a", *PC)} < 0.02 THEN 'exact' ELSE method END AS method, CASE WHEN {_s("L7b", *PC)} < 0.02 THEN 'supported_offsheet' ELSE verdict END AS verdict,
  CASE WHEN {_s("L7c", *PC)} >= 0.02 THEN matched_fact_id END AS fact, CASE WHEN {_s("L7d", *PC)} >= 0.02 THEN span_turn_id END AS turn, span_turn_id AS span FROM alignments)
{_counts("bad", {"span_without_turn": "span IS NOT NULL AND turn IS NULL", "exact_is_judge_only": "method = 'exact' AND verdict IN ('supported_offsheet', 'judge_error', 'span_invalid')", "exact_cites": "method = 'exact' AND turn IS NOT NULL", "offsheet_with_fact": "verdict = 'supported_offsheet' AND fact IS NOT NULL", "offsheet_without_span": "verdict = 'supported_offsheet' AND turn IS NULL", "supported_without_fact": "verdict = 'supported' AND fact IS NULL", "supported_without_span": "verdict = 'supported' AND method = 'judge' AND turn IS NULL"})}""")
def alignment_rules(spark, sf_dir):
    a = L.lab(spark, sf_dir).alignments.withColumn("span_text", F.col("span_turn_id"))
    rows = a.withColumns({
        "method": F.when(_u("L7a", *PC) < 0.02, "exact").otherwise(F.col("method")), "verdict": F.when(_u("L7b", *PC) < 0.02, "supported_offsheet").otherwise(F.col("verdict")),
        "matched_fact_id": F.when(_u("L7c", *PC) >= 0.02, F.col("matched_fact_id")), "span_turn_id": F.when(_u("L7d", *PC) >= 0.02, F.col("span_turn_id")),
    })
    return integrity.violations(rows, integrity.alignment_rules())


@query("coverage_rules", f"""WITH {L.COVERED_SQL}, bad AS (SELECT captured AND {_s("L8", *PF)} >= 0.02 AS captured, by_claim_id FROM covered) {_counts("bad", {"uncaptured_with_claim": "NOT captured AND by_claim_id IS NOT NULL"})}""")
def coverage_rules(spark, sf_dir):
    rows = L.lab(spark, sf_dir).covered.withColumn("captured", F.col("captured") & (_u("L8", *PF) >= 0.02))
    return integrity.violations(rows, integrity.coverage_rules())


PK = ("persona_id", "key")


@query("tally_rules", f"""WITH {TALLIES_SQL}, bad AS (SELECT CASE WHEN {_s("L11", *PK)} < 0.005 THEN 'nonsense' ELSE key END AS key, kind, CASE WHEN {_s("L10a", *PK)} < 0.005 THEN -1 ELSE num END AS num, CASE WHEN {_s("L10b", *PK)} < 0.01 THEN den + 1 WHEN {_s("L10b", *PK)} < 0.02 AND kind = 'rate' THEN 0 ELSE den END AS den FROM tallies)
{_counts("bad", {"negative_tally": "num < 0 OR den < 0", "count_with_denominator": "kind = 'count' AND den <> 0", "rate_over_one": "kind = 'rate' AND num > den", "unknown_key": "key = 'nonsense'"})}""")
def tally_rules(spark, sf_dir):
    x = _u("L10b", *PK)
    rows = L.lab(spark, sf_dir).tallies.withColumns({
        "num": F.when(_u("L10a", *PK) < 0.005, -1).otherwise(F.col("num")), "den": F.when(x < 0.01, F.col("den") + 1).when((x < 0.02) & (F.col("kind") == "rate"), 0).otherwise(F.col("den")), "key": F.when(_u("L11", *PK) < 0.005, "nonsense").otherwise(F.col("key")),
    })
    return integrity.violations(rows, integrity.tally_rules())


@query("score_rules", f"""WITH {TALLIES_SQL}, bad AS (SELECT persona_id, CASE WHEN {_s("L9a", *PK)} < 0.002 THEN 'nonsense.' || key ELSE key END AS key, kind, kind = 'count' OR den > 0 AS has_value, kind <> 'count' AND {_s("L9b", *PK)} >= 0.002 AS has_n FROM tallies)
SELECT 'score_of_unknown_key' AS rule, count(DISTINCT persona_id) AS n FROM bad WHERE starts_with(key, 'nonsense.') AND (has_value OR has_n) UNION ALL SELECT 'score_without_denominator', count(DISTINCT persona_id) FROM bad WHERE has_value AND kind <> 'count' AND NOT has_n AND NOT starts_with(key, 'nonsense.')""")
def score_rules(spark, sf_dir):
    from proofmill.functions.stats import share

    rows = L.lab(spark, sf_dir).tallies.withColumns({"has_n": (F.col("kind") != "count") & (_u("L9b", *PK) >= 0.002), "name": F.when(_u("L9a", *PK) < 0.002, F.concat(F.lit("nonsense."), "key")).otherwise(F.col("key"))})
    value = F.when(F.col("kind") == "count", F.col("num").cast("double")).otherwise(share(F.col("num"), F.col("den")))
    rows = rows.withColumn("value", value)
    pairs = lambda ok, column: F.map_from_entries(F.collect_list(F.when(ok, F.struct("name", column))))
    files = rows.groupBy("persona_id").agg(pairs(F.col("value").isNotNull(), "value").alias("metrics"), pairs(F.col("has_n"), "den").alias("n"))
    return integrity.violations(files, integrity.score_rules())
