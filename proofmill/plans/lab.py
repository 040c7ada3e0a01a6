"""Queries of the whole evaluation over customers, from skeletons to the aggregate, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofmill.functions import constants as C
from proofmill.functions.misheard import CONFUSIONS, HOMOPHONES
from proofmill.functions.stats import draw
from proofmill.operators import coverage, gate, judging, noise, personas, scores, transcripts
from proofmill.plans.scoring import FIELDS_SQL, PRECISION, RECALL, Z
from proofmill.plans.texts import EDITS_SQL, WORDS_SQL
from proofmill.sources import evaluation as ev
from proofmill.sources import lab as L
from proofmill.sources.evaluation import u

QUERIES: dict = {}
ORACLES: dict = {}
QUESTIONS = tuple(q["question_id"] for q in L.SCRIPT)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


SLOTS = ("style", "city", "job", "education", *C.EXACT_CLASSES)
COUNTS = ("n_judged", "n_specific", "n_volunteer", "n_needs_followup", "n_hedge")


@query("sample_skeletons", f"WITH {L.SHEETS_SQL} SELECT persona_id, age, {', '.join(SLOTS + COUNTS)} FROM sheets")
def sample_skeletons(spark, sf_dir):
    return L.lab(spark, sf_dir).sheets.select("persona_id", "age", *SLOTS, *COUNTS)


@query("class_balance", f"WITH {L.SHEETS_SQL} SELECT slot, min(n) AS least, max(n) AS most FROM (SELECT slot, value, count(*) AS n FROM dealt GROUP BY ALL) GROUP BY slot")
def class_balance(spark, sf_dir):
    """How many personas each class of a slot has at least and at most."""
    each = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(s).alias("value")) for s in personas.SLOTS])
    counts = L.lab(spark, sf_dir).sheets.select(F.explode(each).alias("x")).groupBy("x.slot", "x.value").agg(F.count("*").alias("n"))
    return counts.groupBy("slot").agg(F.min("n").alias("least"), F.max("n").alias("most"))


@query("truth_sheets", f"WITH {L.FACTS_SQL} SELECT persona_id, fact_id, field, kind, value, specificity, disclosure, importance FROM facts")
def truth_sheets(spark, sf_dir):
    return L.lab(spark, sf_dir).facts


@query("prompt_payload", f"WITH {L.SHEETS_SQL} SELECT persona_id, md5('{{\"demographics\":{{\"age\":' || age || ',\"city\":\"' || city || '\",\"education\":\"' || education || '\",\"occupation\":\"' || job || '\"}},\"fixed_exact_fields\":{{\"age\":' || age || ',\"has_kids\":' || has_kids || ',\"relationship_goal\":\"' || relationship_goal || '\",\"religion_importance\":\"' || religion_importance || '\",\"wants_kids\":\"' || wants_kids || '\"}},\"persona_id\":\"' || persona_id || '\",\"style\":\"' || style || '\"}}') AS payload_md5, n_judged || ' facts, ' || n_specific || ' specific, in ' || CASE style WHEN 'terse' THEN '15 to 40' WHEN 'balanced' THEN '40 to 120' ELSE '120 to 250' END || ' words' AS prompt FROM sheets")
def prompt_payload(spark, sf_dir):
    sheets = L.lab(spark, sf_dir).sheets
    low, high = personas.style_words(F.col("style"))
    prompt = personas.fill("{n} facts, {s} specific, in {low} to {high} words", {"n": F.col("n_judged"), "s": F.col("n_specific"), "low": low, "high": high})
    return personas.prompt_payload(sheets).join(sheets.select("persona_id", prompt.alias("prompt")), "persona_id").select("persona_id", F.md5("payload").alias("payload_md5"), "prompt")


@query("generation_outcomes", f"""WITH a AS (SELECT printf('p%03d', c_custkey) AS persona_id, attempt, {u("'ga:' || c_custkey || ':' || attempt")} AS x, {u("'gf:' || c_custkey || ':' || attempt")} >= 0.1 AS fits FROM customer, (VALUES (1), (2)) v(attempt)),
s AS (SELECT *, CASE WHEN x < 0.03 THEN 'provider_error' WHEN x < 0.05 THEN 'refusal' ELSE 'ok' END AS status FROM a), f AS (SELECT * FROM s WHERE attempt = 1), g AS (SELECT * FROM s WHERE attempt = 2)
SELECT f.persona_id, CASE WHEN f.status <> 'ok' THEN f.status WHEN f.fits THEN 'ok' WHEN g.status <> 'ok' THEN g.status WHEN g.fits THEN 'ok' ELSE 'schema_invalid' END AS status, CASE WHEN f.status = 'ok' AND NOT f.fits THEN 2 ELSE 1 END AS attempt FROM f JOIN g USING (persona_id)""")
def generation_outcomes(spark, sf_dir):
    """One corrective attempt after an answer that breaks the contract."""
    rows = ev.table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"))
    x, fits = draw("ga:", F.col("c_custkey"), ":", F.col("attempt")), draw("gf:", F.col("c_custkey"), ":", F.col("attempt")) >= 0.1
    status = F.when(x < 0.03, "provider_error").when(x < 0.05, "refusal").otherwise("ok")
    return personas.generated(rows.select(F.format_string("p%03d", "c_custkey").alias("persona_id"), "attempt", status.alias("status"), fits.alias("fits")))


@query("interview_turns", f"WITH {L.TURNS_SQL} SELECT persona_id, turn_id, speaker, question_id, is_followup, text, word_count, array_to_string(disclosed_fact_ids, ',') AS disclosed FROM turns")
def interview_turns(spark, sf_dir):
    return L.lab(spark, sf_dir).turns.select("persona_id", "turn_id", "speaker", "question_id", "is_followup", "text", "word_count", F.array_join("disclosed_fact_ids", ",").alias("disclosed"))


@query("interview_results", f"WITH {L.TURNS_SQL} SELECT persona_id, status, followup_errors, invented FROM results")
def interview_results(spark, sf_dir):
    return L.lab(spark, sf_dir).played[1].select("persona_id", "status", "followup_errors", F.col("invented").cast("long").alias("invented"))


@query("question_order", f"WITH q AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_custkey END AS seed, unnest([{', '.join(repr(q) for q in QUESTIONS)}]) AS question_id FROM customer) SELECT c_custkey, question_id, row_number() OVER (PARTITION BY c_custkey ORDER BY md5(seed || ':order:' || question_id) NULLS FIRST, question_id)::INT AS place FROM q")
def question_order(spark, sf_dir):
    from proofmill.operators.samplers import shuffled

    rows = ev.table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey")).alias("seed"), F.explode(F.array(*map(F.lit, QUESTIONS))).alias("question_id"))
    return shuffled(rows, "question_id", "question_id", F.col("seed"), ["c_custkey"]).select("c_custkey", "question_id", "place")


@query("lab_claims", f"WITH {L.CLAIMS_SQL} SELECT persona_id, claim_id, field, kind, value FROM claims")
def lab_claims(spark, sf_dir):
    return L.lab(spark, sf_dir).claims.select("persona_id", "claim_id", "field", "kind", "value")


@query("lab_alignments", f"WITH {L.ALIGNED_SQL} SELECT persona_id, claim_id, field, method, verdict, matched_fact_id, span_turn_id, bad_references, first_pass FROM alignments")
def lab_alignments(spark, sf_dir):
    """Exact verdicts, the last judge entry of each claim, and one more asking for misquoted spans."""
    return L.lab(spark, sf_dir).alignments.select("persona_id", "claim_id", "field", "method", "verdict", "matched_fact_id", "span_turn_id", "bad_references", "first_pass")


@query("judge_passes", f"WITH {L.HEALTH_SQL} SELECT * FROM health")
def judge_passes(spark, sf_dir):
    return L.lab(spark, sf_dir).health.select("persona_id", "calls", "judged_claims", "errors", "span_invalid", "span_invalid_first_pass", F.col("invalid_fact_refs").cast("long").alias("invalid_fact_refs"))


@query("pooled_health", f"WITH {L.HEALTH_SQL} SELECT *, (errors + span_invalid)::DOUBLE / judged_claims::DOUBLE AS error_rate, (errors + span_invalid)::DOUBLE / judged_claims::DOUBLE > 0.05 AS degraded FROM (SELECT {', '.join(f'sum({c})::BIGINT AS {c}' for c in ('calls', 'judged_claims', 'errors', 'span_invalid', 'span_invalid_first_pass'))} FROM health)")
def pooled_health(spark, sf_dir):
    return judging.pooled_health(L.lab(spark, sf_dir).health)


_LINES = "string_agg('[' || turn_id || ' ' || speaker || '] ' || text, chr(10) ORDER BY turn_ord)"


@query("cited_turn_lines", f"WITH {L.ALIGNED_SQL} SELECT persona_id, md5({_LINES}) AS lines_md5 FROM turns t WHERE speaker = 'user' AND EXISTS (SELECT 1 FROM judged1 j WHERE j.persona_id = t.persona_id AND j.turn_id = t.turn_id AND j.verdict = 'span_invalid') GROUP BY 1")
def cited_turn_lines(spark, sf_dir):
    """The turns that a judge misquoted, as it is shown them again."""
    lab = L.lab(spark, sf_dir)
    first = judging.judged(lab.claims, lab.entries, lab.facts, lab.turns, L.KEY)
    return judging.cited_turns(first, lab.turns, L.KEY).select("persona_id", F.md5("lines").alias("lines_md5"))


@query("transcript_headers", f"WITH {L.TURNS_SQL} SELECT persona_id, count(*) AS turns, sum(word_count)::BIGINT AS words, round_even(sum(word_count) / 150.0::DOUBLE, 4) AS simulated_minutes FROM turns GROUP BY 1")
def transcript_headers(spark, sf_dir):
    return transcripts.headers(L.lab(spark, sf_dir).turns, L.KEY)


@query("judge_payloads", f"WITH {L.CLAIMS_SQL} SELECT 'fact' AS what, persona_id, fact_id AS id, field, value FROM facts WHERE field NOT IN {L._in(C.EXACT_FIELDS)} UNION ALL SELECT 'claim', persona_id, claim_id, field, value FROM claims WHERE field NOT IN {L._in(C.EXACT_FIELDS)}")
def judge_payloads(spark, sf_dir):
    from proofmill.operators.claims import judged_payload

    lab = L.lab(spark, sf_dir)
    parts = [judged_payload(lab.facts, "fact_id").withColumnRenamed("fact_id", "id").withColumn("what", F.lit("fact")), judged_payload(lab.claims, "claim_id").withColumnRenamed("claim_id", "id").withColumn("what", F.lit("claim"))]
    return parts[0].unionByName(parts[1])


@query("lab_coverage", f"WITH {L.COVERED_SQL} SELECT persona_id, fact_id, captured, by_claim_id, disclosed_turn_id, question_id, via_followup FROM covered")
def lab_coverage(spark, sf_dir):
    return L.lab(spark, sf_dir).covered.select("persona_id", "fact_id", "captured", "by_claim_id", "disclosed_turn_id", "question_id", "via_followup")


@query("unknown_facts", f"WITH {L.COVERED_SQL} SELECT persona_id, fact_id FROM covered WHERE {u("'uf:' || persona_id || ':' || fact_id")} < 0.02")
def unknown_facts(spark, sf_dir):
    """Seeded faults: coverage of facts that were taken off the sheets."""
    lab = L.lab(spark, sf_dir)
    fewer = lab.facts.where(draw("uf:", F.col("persona_id"), ":", F.col("fact_id")) >= 0.02)
    return coverage.unknown_facts(lab.covered.select("persona_id", "fact_id"), fewer, L.KEY)


AUDIT_SQL = f"""{L.COVERED_SQL},
tag_words AS (SELECT persona_id, fact_id, list_distinct(flatten(list(list_transform(regexp_extract_all(text, '[0-9A-Za-z]+'), lambda t: STEM)))) AS toks FROM (SELECT *, unnest(disclosed_fact_ids) AS fact_id FROM turns) GROUP BY ALL),
mismatches AS (SELECT f.persona_id, f.fact_id, CASE WHEN len(ANCHORS) = 0 THEN 'unverifiable' WHEN list_has_any(toks, ANCHORS) THEN 'spoken' ELSE 'mismatched' END AS state FROM facts f JOIN tag_words w USING (persona_id, fact_id) WHERE specificity = 'specific' AND field NOT IN {L._in(C.EXACT_FIELDS)}),
firsts AS (SELECT persona_id, min(turn_ord) AS first_tagged FROM turns WHERE len(disclosed_fact_ids) > 0 GROUP BY 1),
untagged AS (SELECT c.persona_id, c.fact_id, CASE WHEN w.fact_id IS NULL THEN 'no turn tags it' WHEN t.turn_ord < first_tagged THEN 'cited before the first tag' END AS note FROM covered c JOIN alignments a ON a.persona_id = c.persona_id AND a.claim_id = c.by_claim_id AND a.method = 'judge' AND a.span_turn_id IS NOT NULL
  LEFT JOIN turns t ON t.persona_id = a.persona_id AND t.turn_id = a.span_turn_id LEFT JOIN tag_words w ON w.persona_id = c.persona_id AND w.fact_id = c.fact_id LEFT JOIN firsts f ON f.persona_id = c.persona_id WHERE c.captured)"""


def _audit_sql() -> str:
    from proofmill.plans.texts import STEM, anchors_sql

    return AUDIT_SQL.replace("STEM", STEM.format("t")).replace("ANCHORS", anchors_sql("f.value"))


@query("disclosure_audit", f"WITH {_audit_sql()} SELECT persona_id, fact_id, state FROM mismatches UNION ALL SELECT persona_id, fact_id, note FROM untagged WHERE note IS NOT NULL")
def disclosure_audit(spark, sf_dir):
    """Tagged facts whose words were not spoken, and captured facts that were not tagged."""
    lab = L.lab(spark, sf_dir)
    return lab.mismatches.unionByName(lab.untagged.withColumnRenamed("note", "state"))


def _listed(rates: dict[str, tuple[str, str]]) -> str:
    return "unnest([" + ", ".join(f"struct_pack(key := '{k}', num := count(*) FILTER ({n}), den := count(*) FILTER ({d}))" for k, (n, d) in rates.items()) + "])"


_HIT, _ASKED = PRECISION["precision"]
_BY_FIELD = {f"precision_by_field.{f}": (f"{_HIT} AND field = '{f}'", f"{_ASKED} AND field = '{f}'") for f in C.SCORED_FIELDS}
_RECALL = {k: (n.replace("elicited", "disclosed_turn_id IS NOT NULL"), d.replace("elicited", "disclosed_turn_id IS NOT NULL").replace("true", "fact_id IS NOT NULL")) for k, (n, d) in RECALL.items()}
_RECALL |= {f"{p}.{f}": (f"captured AND field = '{f}'", f"field = '{f}'") for p, fs in (("recall_by_field", C.SCORED_FIELDS), ("recall_exact_by_field", C.EXACT_FIELDS)) for f in fs}
TALLIES_SQL = f"""{_audit_sql()},
credited AS (SELECT c.*, captured AND u.fact_id IS NULL AS credited FROM covered c LEFT JOIN (SELECT * FROM untagged WHERE note IS NOT NULL) u USING (persona_id, fact_id)),
spans AS (SELECT persona_id, question_id, sum(word_count)::BIGINT AS words FROM turns GROUP BY ALL), got AS (SELECT persona_id, question_id, count(*) AS n FROM credited WHERE credited AND question_id IS NOT NULL GROUP BY ALL),
yields AS (SELECT persona_id, question_id, coalesce(n, 0) AS n, coalesce(words, 0) AS words FROM spans FULL JOIN got USING (persona_id, question_id)),
shares AS (SELECT e.persona_id, style, count(*) FILTER (credited AND via_followup) AS n, count(*) FILTER (credited AND via_followup IS NOT NULL) AS d FROM extractions e LEFT JOIN credited c USING (persona_id) GROUP BY ALL),
dups AS (SELECT persona_id, count(*) - count(DISTINCT (field, kind, same)) AS n FROM folded GROUP BY 1),
tallies AS (
  SELECT persona_id, t.key, 'rate' AS kind, t.num, t.den FROM (SELECT persona_id, {_listed(PRECISION | _BY_FIELD)} AS t FROM extractions LEFT JOIN alignments USING (persona_id) GROUP BY 1)
  UNION ALL SELECT persona_id, t.key, 'rate', t.num, t.den FROM (SELECT persona_id, {_listed(_RECALL)} AS t FROM extractions LEFT JOIN covered USING (persona_id) GROUP BY 1)
  UNION ALL SELECT persona_id, 'recall_by_disclosure.' || disclosure, 'rate', count(*) FILTER (captured), count(*) FROM covered GROUP BY ALL
  UNION ALL SELECT persona_id, t.key, 'rate', t.num, coalesce(judged_claims, 0) FROM (SELECT persona_id, judged_claims, unnest([struct_pack(key := 'judge_error_rate', num := coalesce(errors + span_invalid, 0)), struct_pack(key := 'span_invalid_rate_first_pass', num := coalesce(span_invalid_first_pass, 0)), struct_pack(key := 'span_invalid_rate_final', num := coalesce(span_invalid, 0))]) AS t FROM extractions LEFT JOIN health USING (persona_id))
  UNION ALL SELECT persona_id, 'yield.' || question_id, 'count', n, 0 FROM yields UNION ALL SELECT persona_id, 'yield_per_minute.' || question_id, 'ratio', n * 150, words FROM yields
  UNION ALL SELECT persona_id, 'followup_share', 'rate', n, d FROM shares UNION ALL SELECT persona_id, 'followup_share_by_style.' || style, 'rate', n, d FROM shares
  UNION ALL SELECT persona_id, 'disclosure_mismatch', 'rate', count(*) FILTER (state = 'mismatched'), count(*) FILTER (state <> 'unverifiable') FROM extractions LEFT JOIN mismatches USING (persona_id) GROUP BY 1
  UNION ALL SELECT persona_id, 'untagged_capture', 'count', count(note), 0 FROM extractions LEFT JOIN untagged USING (persona_id) GROUP BY 1
  UNION ALL SELECT persona_id, 'claims_deduped', 'count', coalesce(n, 0), 0 FROM extractions LEFT JOIN dups USING (persona_id))"""


@query("lab_tallies", f"WITH {TALLIES_SQL} SELECT persona_id, key, kind, num::BIGINT AS num, den::BIGINT AS den FROM tallies")
def lab_tallies(spark, sf_dir):
    return L.lab(spark, sf_dir).tallies


def _expected(spark):
    return gate.expected_keys(spark, question_ids=QUESTIONS)


def _aggregate(spark, sf_dir):
    lab = L.lab(spark, sf_dir)
    return scores.aggregate(lab.tallies, _expected(spark), scores.exact_floors(lab.facts))


EXPECTED_SQL = "expected AS (SELECT unnest([" + ", ".join(f"'{k}'" for k in (*C.STATIC_RATES, *C.STATIC_COUNTS)) + "]) AS key" + "".join(f" UNION ALL SELECT '{p}.' || unnest([{', '.join(repr(x) for x in xs)}])" for p, xs in (("recall_by_field", C.SCORED_FIELDS), ("precision_by_field", C.SCORED_FIELDS), ("exact_floor", C.EXACT_FIELDS), ("recall_exact_by_field", C.EXACT_FIELDS), ("recall_by_disclosure", C.DISCLOSURES[:3]), ("followup_share_by_style", C.STYLES), ("yield", QUESTIONS), ("yield_per_minute", QUESTIONS))) + ")"
_PV, _N = "(num::DOUBLE / den::DOUBLE)", "den::DOUBLE"
_MID, _HALF = f"({_PV} + {Z} * {Z} / (2 * {_N})) / (1 + {Z} * {Z} / {_N})", f"{Z} * sqrt({_PV} * (1 - {_PV}) / {_N} + {Z} * {Z} / (4 * {_N} * {_N})) / (1 + {Z} * {Z} / {_N})"
AGGREGATE_SQL = f"""{TALLIES_SQL}, {EXPECTED_SQL},
floors AS (SELECT 'exact_floor.' || field AS key, 'rate' AS kind, max(n) AS num, sum(n) AS den FROM (SELECT field, kind, value, count(*) AS n FROM facts WHERE field IN {L._in(C.EXACT_FIELDS)} GROUP BY ALL) GROUP BY field),
own AS (SELECT key, num, den FROM tallies WHERE key NOT IN (SELECT key FROM floors) UNION ALL SELECT key, num, den FROM floors),
every AS (SELECT key FROM tallies UNION SELECT key FROM expected UNION SELECT key FROM floors),
summed AS (SELECT key, CASE WHEN key IN ('untagged_capture', 'claims_deduped') OR starts_with(key, 'yield.') THEN 'count' WHEN starts_with(key, 'yield_per_minute.') THEN 'ratio' ELSE 'rate' END AS kind, coalesce(sum(num), 0)::BIGINT AS num, coalesce(sum(den), 0)::BIGINT AS den FROM every LEFT JOIN own USING (key) GROUP BY key),
pooled AS (SELECT key, kind, CASE WHEN kind = 'count' THEN num::DOUBLE WHEN den > 0 THEN {_PV} END AS value, CASE WHEN kind <> 'count' THEN den END AS n,
  CASE WHEN kind = 'rate' AND den > 0 THEN round(greatest(0, {_MID} - {_HALF}), 9) END AS lo, CASE WHEN kind = 'rate' AND den > 0 THEN round(least(1, {_MID} + {_HALF}), 9) END AS hi, num, den FROM summed)"""


@query("lab_aggregate", f"WITH {AGGREGATE_SQL} SELECT * FROM pooled")
def lab_aggregate(spark, sf_dir):
    """All expected keys, those that any extraction has, and the floors; undefined ones are null."""
    return _aggregate(spark, sf_dir)


@query("lab_lifts", f"WITH {AGGREGATE_SQL} SELECT split_part(key, '.', 2) AS field, max(value) FILTER (key NOT LIKE 'exact_floor%') AS recall, max(value) FILTER (key LIKE 'exact_floor%') AS floor, max(value) FILTER (key NOT LIKE 'exact_floor%') - max(value) FILTER (key LIKE 'exact_floor%') AS lift FROM pooled WHERE key LIKE 'recall_exact_by_field.%' OR key LIKE 'exact_floor.%' GROUP BY 1")
def lab_lifts(spark, sf_dir):
    return scores.lifts(_aggregate(spark, sf_dir))


@query("metric_suffixes", f"WITH {AGGREGATE_SQL} SELECT DISTINCT 'yield' AS prefix, substr(key, 7) AS suffix FROM pooled WHERE starts_with(key, 'yield.') UNION ALL SELECT DISTINCT 'recall_by_disclosure', substr(key, 22) FROM pooled WHERE starts_with(key, 'recall_by_disclosure.')")
def metric_suffixes(spark, sf_dir):
    pooled = _aggregate(spark, sf_dir)
    parts = [scores.suffixes(pooled, p).select(F.lit(p).alias("prefix"), "suffix") for p in ("yield", "recall_by_disclosure")]
    return parts[0].unionByName(parts[1])


@query("per_persona", f"WITH {AGGREGATE_SQL} SELECT p.persona_id, k.key AS metric, CASE WHEN k.kind = 'count' THEN t.num::DOUBLE ELSE t.num::DOUBLE / nullif(t.den, 0)::DOUBLE END AS value, CASE WHEN k.kind <> 'count' THEN t.den::BIGINT END AS n FROM (SELECT DISTINCT persona_id FROM tallies) p CROSS JOIN (SELECT key, kind FROM pooled) k LEFT JOIN tallies t ON t.persona_id = p.persona_id AND t.key = k.key")
def per_persona(spark, sf_dir):
    """Each key of the aggregate for each persona, null where it has none."""
    lab = L.lab(spark, sf_dir)
    keys = scores.key_union(lab.tallies, _expected(spark), scores.exact_floors(lab.facts))
    return scores.per_persona(lab.tallies, L.KEY, keys)


@query("score_files", f"WITH {TALLIES_SQL}, v AS (SELECT *, CASE WHEN kind = 'count' THEN num::DOUBLE ELSE num::DOUBLE / nullif(den, 0)::DOUBLE END AS value FROM tallies) SELECT persona_id, count(value) AS n_metrics, count(*) FILTER (kind <> 'count') AS n_denominators, md5(string_agg(key, ',' ORDER BY key) FILTER (value IS NOT NULL)) AS keys_md5, round(sum(value), 6) AS total FROM v GROUP BY 1")
def score_files(spark, sf_dir):
    """What a score file of each extraction holds."""
    made = scores.scores(L.lab(spark, sf_dir).tallies, L.KEY)
    total = F.aggregate(F.map_values("metrics"), F.lit(0.0), lambda a, x: a + x)
    return made.select("persona_id", F.size("metrics").cast("long").alias("n_metrics"), F.size("n").cast("long").alias("n_denominators"), F.md5(F.array_join(F.map_keys("metrics"), ",")).alias("keys_md5"), F.round(total, 6).alias("total"))


# Noise


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_KEY = "transcript_id || ':' || turn_ord || ':' || wi"
_WORDS = "MAP {" + ", ".join(f"{_quoted(w)}: [{', '.join(map(_quoted, o))}]" for w, o in HOMOPHONES.items()) + "}"
_SITES = "flatten([" + ", ".join(f"list_transform(list_filter(range(1, len(core) + 1), lambda i: substr(lower(core), i, {len(p)}) = '{p}'), lambda i: struct_pack(a := i, n := {len(p)}, r := '{r}'))" for p, r in CONFUSIONS) + "])"
_STRIP = "CASE WHEN translate({0}, '.,;:!?', '') = '' THEN {0} ELSE translate({0}, '.,;:!?', '') END"
NOISE_SQL = f"""{ev.TURNS_SQL}, {WORDS_SQL}, {EDITS_SQL},
ends AS (SELECT *, regexp_matches(regexp_replace(word, '["'')\\]}}]+$', ''), '[.!?]$')::INT AS ends FROM edits),
placed AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY transcript_id, turn_ord ORDER BY wi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM ends),
struck AS (SELECT *, max((coalesce(operation, '') = 'punctuation')::INT) OVER s > 0 AS stripped, coalesce(operation, '') = 'punctuation' AND max(regexp_matches(word, '[.,;:!?]')::INT) OVER s > 0
    AND row_number() OVER (PARTITION BY transcript_id, turn_ord, sentence, coalesce(operation, '') = 'punctuation' ORDER BY wi) = 1 AS changed FROM placed WINDOW s AS (PARTITION BY transcript_id, turn_ord, sentence)),
parts AS (SELECT *, regexp_extract(word, '^([^\\p{{L}}\\p{{N}}_]*)', 1) AS lead, regexp_extract(word, '([\\p{{L}}\\p{{N}}_](?:.*[\\p{{L}}\\p{{N}}_])?)', 1) AS core, {u(_KEY + " || ':s'")} AS us FROM struck),
looked AS (SELECT *, substr(word, len(lead) + len(core) + 1) AS trail, {_WORDS}[lower(core)] AS known, CASE WHEN operation = 'homophone' THEN {_SITES} END AS fits FROM parts),
heard AS (SELECT *, CASE WHEN known IS NOT NULL THEN known[floor(us * len(known))::INT + 1] END AS other, CASE WHEN len(fits) > 0 THEN fits[floor(us * len(fits))::INT + 1] END AS site FROM looked),
cased AS (SELECT *, CASE WHEN known IS NOT NULL THEN CASE WHEN len(core) > 1 AND core = upper(core) AND core <> lower(core) THEN upper(other) WHEN left(core, 1) = upper(left(core, 1)) AND left(core, 1) <> lower(left(core, 1)) THEN upper(left(other, 1)) || substr(other, 2) ELSE other END
    WHEN site IS NOT NULL THEN left(core, (site.a - 1)::INT) || site.r || substr(core, site.a + site.n) WHEN len(core) >= 4 THEN left(core, len(core) - 1) ELSE core END AS now FROM heard),
swapped AS (SELECT *, CASE WHEN operation = 'homophone' THEN CASE WHEN core = '' THEN word ELSE lead || now || trail END END AS result,
    CASE WHEN operation = 'homophone' THEN CASE WHEN core = '' THEN 'unchanged' WHEN known IS NOT NULL THEN 'dictionary' WHEN now = core THEN 'unchanged' ELSE 'character' END END AS source,
    CASE WHEN operation = 'filler' THEN ['um', 'uh', 'like', 'you know'][floor({u(_KEY + " || ':f'")} * 4)::INT + 1] END AS filler FROM cased),
spoken AS (SELECT *, CASE WHEN stripped THEN {_STRIP.format("coalesce(result, word)")} ELSE coalesce(result, word) END AS said FROM swapped),
pieces AS (SELECT *, CASE operation WHEN 'drop' THEN NULL WHEN 'filler' THEN filler || ' ' || said ELSE said END AS piece FROM spoken)"""


def _pieces(spark, sf_dir):
    words = noise.words_of_turns(ev.turns(spark, sf_dir))
    return noise.noised_pieces(noise.struck(noise.sentence_index(noise.edits(words, 0.1))))


@query("noise_edits", f"WITH {NOISE_SQL} SELECT transcript_id, turn_ord, wi::INT AS wi, word, operation, result, source, filler, changed FROM pieces WHERE fired")
def noise_edits(spark, sf_dir):
    """Each word that was hit, how, and what became of it."""
    return _pieces(spark, sf_dir).where("fired").select("transcript_id", "turn_ord", "wi", "word", "operation", "result", "source", "filler", "changed")


@query("noised_text", f"WITH {NOISE_SQL}, n AS (SELECT transcript_id, turn_ord, coalesce(string_agg(piece, ' ' ORDER BY wi), '') AS text FROM pieces GROUP BY ALL) SELECT t.transcript_id, t.turn_ord, t.speaker, coalesce(n.text, CASE WHEN t.speaker = 'user' THEN '' ELSE t.text END) AS text, len({ev.tokens_sql("coalesce(n.text, CASE WHEN t.speaker = 'user' THEN '' ELSE t.text END)")})::BIGINT AS word_count FROM turns t LEFT JOIN n USING (transcript_id, turn_ord)")
def noised_text(spark, sf_dir):
    return noise.noised_turns(ev.turns(spark, sf_dir), 0.1).select("transcript_id", "turn_ord", "speaker", "text", "word_count")


@query("noised_headers", f"WITH {NOISE_SQL}, n AS (SELECT transcript_id, turn_ord, coalesce(string_agg(piece, ' ' ORDER BY wi), '') AS text FROM pieces GROUP BY ALL), w AS (SELECT t.transcript_id, sum(CASE WHEN t.speaker = 'user' THEN len({ev.tokens_sql('n.text')}) ELSE t.word_count END) AS words FROM turns t LEFT JOIN n USING (transcript_id, turn_ord) GROUP BY 1) SELECT transcript_id || '__n010' AS transcript_id, 'p' || transcript_id AS persona_id, 0.1::DOUBLE AS noise_rate, 7 AS noise_seed, transcript_id::VARCHAR AS source_transcript_id, round_even(words / 150.0::DOUBLE, 4) AS simulated_minutes FROM w")
def noised_headers(spark, sf_dir):
    turns = ev.turns(spark, sf_dir)
    headers = turns.select("transcript_id").distinct().select("transcript_id", F.concat(F.lit("p"), F.col("transcript_id").cast("string")).alias("persona_id"), F.lit(0.0).alias("noise_rate"))
    return noise.noised_headers(headers, noise.noised_turns(turns, 0.1), 0.1)


@query("edit_logs", f"WITH {NOISE_SQL} SELECT transcript_id, count(*) AS user_words, count(*) FILTER (fired) AS edit_count FROM pieces GROUP BY 1")
def edit_logs(spark, sf_dir):
    return noise.edit_logs(_pieces(spark, sf_dir), 0.1).select("transcript_id", "user_words", "edit_count")
