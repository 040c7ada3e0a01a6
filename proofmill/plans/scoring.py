"""Scoring queries: tallies, pools, floors and the gate, with SQL for each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofmill.functions import constants as C
from proofmill.functions.stats import draw, share, wilson
from proofmill.operators import gate, samplers, tallies, verdicts
from proofmill.sources import evaluation as ev
from proofmill.sources.evaluation import ALIGNMENTS_SQL, COVERAGE_SQL, EXACT_SQL, FACTS_SQL, FIRM_SQL, u

QUERIES: dict = {}
ORACLES: dict = {}
A = f"WITH {FACTS_SQL}, {ALIGNMENTS_SQL}"
K = f"WITH {FACTS_SQL}, {COVERAGE_SQL}"
SCORED = "verdict NOT IN ('judge_error', 'span_invalid', 'abstained')"
GOOD = "verdict IN ('supported', 'supported_offsheet')"
Z = "1.959963984540054::DOUBLE"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def valued_sql(inner: str, by: str = "") -> str:
    """SQL around (by, key, num, den)."""
    by = by + ", " if by else ""
    p, n = "(num::DOUBLE / nullif(den, 0)::DOUBLE)", "nullif(den, 0)::DOUBLE"
    middle = f"({p} + {Z} * {Z} / (2 * {n})) / (1 + {Z} * {Z} / {n})"
    half = f"{Z} * sqrt({p} * (1 - {p}) / {n} + {Z} * {Z} / (4 * {n} * {n})) / (1 + {Z} * {Z} / {n})"
    return f"SELECT {by}key, num::BIGINT AS num, den::BIGINT AS den, {p} AS value, CASE WHEN den > 0 THEN round(greatest(0, {middle} - {half}), 9) END AS lo, CASE WHEN den > 0 THEN round(least(1, {middle} + {half}), 9) END AS hi FROM ({inner})"


PRECISION = {
    "precision": (f"{SCORED} AND {GOOD}", SCORED),
    "hallucination_rate": ("verdict = 'unsupported'", SCORED),
    "offsheet_rate": ("verdict = 'supported_offsheet' AND method = 'judge'", f"{SCORED} AND method = 'judge'"),
    "abstention_rate": ("verdict = 'abstained'", "verdict NOT IN ('judge_error', 'span_invalid')"),
    "precision_dealbreakers": (f"{SCORED} AND {GOOD} AND field IN ({FIRM_SQL})", f"{SCORED} AND field IN ({FIRM_SQL})"),
}
RECALL = {
    "recall": ("captured", "true"),
    "recall_elicited": ("captured AND elicited", "elicited"),
    "recall_dealbreakers": (f"captured AND field IN ({FIRM_SQL})", f"field IN ({FIRM_SQL})"),
    "recall_exact": (f"captured AND field IN ({EXACT_SQL})", f"field IN ({EXACT_SQL})"),
}


def rates_sql(rates: dict, source: str, by: str) -> str:
    return " UNION ALL ".join(f"SELECT {by}, '{k}' AS key, count(*) FILTER ({n}) AS num, count(*) FILTER ({d}) AS den FROM {source} GROUP BY {by}" for k, (n, d) in rates.items())


@query("precision_family", f"{A} {valued_sql(rates_sql(PRECISION, 'alignments', 'style'), 'style')}")
def precision_family(spark, sf_dir):
    return tallies.valued(tallies.tally(ev.alignments(spark, sf_dir), ["style"], tallies.precision_rates()))


@query("recall_family", f"{K} {valued_sql(rates_sql(RECALL, 'coverage', 'style'), 'style')}")
def recall_family(spark, sf_dir):
    return tallies.valued(tallies.tally(ev.coverage(spark, sf_dir), ["style"], tallies.recall_rates()))


FIELDS_SQL = ", ".join(f"('{f}')" for f in C.SCORED_FIELDS)


@query("precision_by_field", f"{A}, dim(field) AS (VALUES {FIELDS_SQL}) " + valued_sql(f"SELECT 'precision_by_field.' || d.field AS key, count(*) FILTER ({SCORED} AND {GOOD}) AS num, count(*) FILTER ({SCORED}) AS den FROM dim d LEFT JOIN alignments a ON a.field = d.field GROUP BY d.field"))
def precision_by_field(spark, sf_dir):
    rates = {"precision_by_field": tallies.precision_rates()["precision"]}
    found = tallies.zero_filled(tallies.tally(ev.alignments(spark, sf_dir), ["field"], rates).drop("key"), "field", C.SCORED_FIELDS)
    return tallies.valued(found.select(F.concat(F.lit("precision_by_field."), "field").alias("key"), "num", "den"))


@query("recall_by_field", f"{K}, dim(field) AS (VALUES {FIELDS_SQL}) " + valued_sql("SELECT 'recall_by_field.' || d.field AS key, count(*) FILTER (captured) AS num, count(c.fact_id) AS den FROM dim d LEFT JOIN coverage c ON c.field = d.field GROUP BY d.field"))
def recall_by_field(spark, sf_dir):
    rates = {"k": tallies.recall_rates()["recall"]}
    found = tallies.zero_filled(tallies.tally(ev.coverage(spark, sf_dir), ["field"], rates).drop("key"), "field", C.SCORED_FIELDS)
    return tallies.valued(found.select(F.concat(F.lit("recall_by_field."), "field").alias("key"), "num", "den"))


@query("recall_by_disclosure", f"{K} " + valued_sql("SELECT 'recall_by_disclosure.' || disclosure AS key, count(*) FILTER (captured) AS num, count(*) AS den FROM coverage GROUP BY disclosure"))
def recall_by_disclosure(spark, sf_dir):
    rates = {"k": tallies.recall_rates()["recall"]}
    found = tallies.tally(ev.coverage(spark, sf_dir), ["disclosure"], rates)
    return tallies.valued(found.select(F.concat(F.lit("recall_by_disclosure."), "disclosure").alias("key"), "num", "den"))


@query("verdict_populations", f"{A} SELECT method, verdict, count(*) AS n, verdict NOT IN ('judge_error', 'span_invalid') AS scorable, {SCORED} AS scored, {SCORED} AND method = 'judge' AS judged, {GOOD} AS credited FROM alignments GROUP BY ALL")
def verdict_populations(spark, sf_dir):
    found = ev.alignments(spark, sf_dir).groupBy("method", "verdict").agg(F.count("*").alias("n"))
    return found.select("*", *[c.alias(k) for k, c in verdicts.populations(F.col("verdict"), F.col("method")).items()])


@query("exact_verdicts", f"{A}, truth AS (SELECT persona_id, fact_id, value FROM facts WHERE {u("'et:' || fact_id")} >= 0.02) SELECT a.persona_id, a.fact_id AS claim_id, a.field, CASE WHEN t.fact_id IS NOT NULL THEN verdict END AS verdict, CASE WHEN t.fact_id IS NOT NULL AND verdict = 'supported' THEN a.fact_id END AS matched_fact_id, CASE WHEN t.fact_id IS NULL THEN 'no_truth' END AS problem FROM alignments a LEFT JOIN truth t ON t.persona_id = a.persona_id AND t.fact_id = a.fact_id WHERE method = 'exact'")
def exact_verdicts(spark, sf_dir):
    """Claims joined with the truth by id; the verdict from typed values. Some facts are left out, and their claims are told."""
    f = ev.facts(spark, sf_dir).where(F.col("field").isin(*C.EXACT_FIELDS)).withColumn("kind", F.lit("str"))
    truth = f.where(draw("et:", F.col("fact_id")) >= 0.02).select("persona_id", F.col("fact_id").alias("sheet"), "fact_id", "field", "kind", "value")
    claims = f.where("claimed").select("persona_id", F.col("fact_id").alias("sheet"), F.col("fact_id").alias("claim_id"), "field", "kind", F.col("claim").alias("value"))
    return verdicts.exact_alignments(claims, truth, ["persona_id", "sheet"]).select("persona_id", "claim_id", "field", "verdict", "matched_fact_id", "problem")


_REF = u("'ref:' || fact_id")
_SPAN = u("'span:' || fact_id")


@query("judge_verdicts", f"""{K}, entries AS (
  SELECT fact_id AS claim_id, persona_id, field, {u("'j:' || fact_id")} >= 0.05 AS has_entry,
    CASE WHEN {_REF} < 0.6 THEN fact_id WHEN {_REF} < 0.7 THEN fact_id + 1 END AS cited,
    CASE WHEN {_SPAN} < 0.1 THEN 'none_cited' WHEN {_SPAN} < 0.2 THEN 'not_verbatim' ELSE 'ok' END AS reason
  FROM facts WHERE claimed AND field NOT IN ({EXACT_SQL})
), checked AS (
  SELECT e.*, f.fact_id IS NOT NULL AS fits FROM entries e LEFT JOIN facts f ON f.persona_id = e.persona_id AND f.fact_id = e.cited AND f.field = e.field)
SELECT claim_id, CASE WHEN NOT has_entry THEN 'judge_error' WHEN reason = 'none_cited' THEN 'unsupported' WHEN reason <> 'ok' THEN 'span_invalid'
  WHEN fits THEN 'supported' ELSE 'supported_offsheet' END AS verdict, has_entry AND cited IS NOT NULL AND NOT fits AS bad_reference FROM checked""")
def judge_verdicts(spark, sf_dir):
    """Judge entries joined with the facts they cite, by persona, fact and field."""
    f = ev.facts(spark, sf_dir)
    ref, span, fact = draw("ref:", F.col("fact_id")), draw("span:", F.col("fact_id")), F.col("fact_id")
    entries = f.where(F.col("claimed") & ~F.col("field").isin(*C.EXACT_FIELDS)).select(
        fact.alias("claim_id"), "persona_id", "field", (draw("j:", fact) >= 0.05).alias("has_entry"), F.when(ref < 0.6, fact).when(ref < 0.7, fact + 1).alias("cited"),
        F.when(span < 0.1, "none_cited").when(span < 0.2, "not_verbatim").otherwise("ok").alias("reason"),
    )
    cited = f.select("persona_id", F.col("fact_id").alias("cited"), "field", F.lit(True).alias("fits"))
    rows = entries.join(cited, ["persona_id", "cited", "field"], "left")
    verdict, bad = verdicts.judge_verdict(F.col("has_entry"), F.col("cited"), F.col("fits"), F.col("reason"))
    return rows.select("claim_id", verdict.alias("verdict"), bad.alias("bad_reference"))


@query("fact_coverage", f"{A} SELECT f.persona_id, f.fact_id, f.field, a.fact_id IS NOT NULL AS captured, a.fact_id AS by_claim_id, CASE WHEN f.elicited THEN f.question_id END AS question_id FROM facts f LEFT JOIN (SELECT * FROM alignments WHERE verdict = 'supported') a ON a.fact_id = f.fact_id AND a.persona_id = f.persona_id")
def fact_coverage(spark, sf_dir):
    """Each fact with the first supported claim on it, in order of alignments."""
    first = Window.partitionBy("persona_id", "fact_id").orderBy(F.col("method") != "exact", "fact_id")
    won = ev.alignments(spark, sf_dir).where("verdict = 'supported'").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    won = won.select("persona_id", "fact_id", F.col("fact_id").alias("by_claim_id"))
    rows = ev.facts(spark, sf_dir).join(won, ["persona_id", "fact_id"], "left")
    return rows.select("persona_id", "fact_id", "field", F.col("by_claim_id").isNotNull().alias("captured"), "by_claim_id", F.when(F.col("elicited"), F.col("question_id")).alias("question_id"))


@query("captured_recheck", f"{A}, c AS (SELECT persona_id, fact_id, claimed AND claim = value AS captured, CASE WHEN {u("'g:' || fact_id")} < 0.95 THEN fact_id END AS by_claim_id FROM facts) SELECT count(*) AS facts, count(*) FILTER (c.captured) AS captured, count(*) FILTER (c.captured AND (c.by_claim_id IS NULL OR a.verdict = 'supported')) AS credited, count(*) FILTER (c.captured AND c.by_claim_id IS NOT NULL AND a.verdict IS NULL) AS dangling FROM c LEFT JOIN alignments a ON a.persona_id = c.persona_id AND a.fact_id = c.by_claim_id")
def captured_recheck(spark, sf_dir):
    """A captured fact counts only if the claim it cites is supported; one without a citation counts."""
    c = ev.coverage(spark, sf_dir).withColumn("by_claim_id", F.when(draw("g:", F.col("fact_id")) < 0.95, F.col("fact_id"))).select("persona_id", "captured", "by_claim_id")
    a = ev.alignments(spark, sf_dir).select("persona_id", F.col("fact_id").alias("by_claim_id"), "verdict")
    cited = F.col("by_claim_id").isNotNull()
    return c.join(a, ["persona_id", "by_claim_id"], "left").agg(
        F.count("*").alias("facts"), F.count_if("captured").alias("captured"),
        F.count_if(F.col("captured") & (~cited | F.coalesce(F.col("verdict") == "supported", F.lit(False)))).alias("credited"),
        F.count_if(F.col("captured") & cited & F.col("verdict").isNull()).alias("dangling"),
    )


@query("question_yield", f"{K}, q AS (SELECT DISTINCT question_id FROM facts) SELECT q.question_id, count(c.fact_id) AS yield FROM q LEFT JOIN coverage c ON c.question_id = q.question_id AND c.captured AND c.elicited GROUP BY q.question_id")
def question_yield(spark, sf_dir):
    c = ev.coverage(spark, sf_dir)
    return c.groupBy("question_id").agg(F.count_if(F.col("captured") & F.col("elicited")).alias("yield"))


@query("yield_per_minute", f"{K}, {ev.TURNS_SQL}, w AS (SELECT question_id, sum(word_count)::BIGINT AS words FROM turns GROUP BY 1), y AS (SELECT question_id, count(*) FILTER (captured AND elicited) AS n FROM coverage GROUP BY 1) SELECT y.question_id, n AS yield, coalesce(words, 0) AS words, n * 150.0::DOUBLE / nullif(words, 0) AS value FROM y LEFT JOIN w USING (question_id)")
def yield_per_minute(spark, sf_dir):
    """Yield over spoken minutes; all turns of a question count, follow-ups and the interviewer's included."""
    words = ev.turns(spark, sf_dir).groupBy("question_id").agg(F.sum("word_count").alias("words"))
    rows = question_yield(spark, sf_dir).join(words, "question_id", "left").withColumn("words", F.coalesce("words", F.lit(0)))
    return rows.select("question_id", "yield", "words", share(F.col("yield") * float(C.WORDS_PER_MINUTE), F.col("words")).alias("value"))


@query("followup_share", f"{K} " + valued_sql("SELECT style, 'followup_share' AS key, count(*) FILTER (via_followup) AS num, count(*) AS den FROM coverage WHERE captured AND elicited GROUP BY style", "style"))
def followup_share(spark, sf_dir):
    rows = ev.coverage(spark, sf_dir).where("captured and elicited")
    return tallies.valued(tallies.tally(rows, ["style"], {"followup_share": (F.col("via_followup"), F.lit(True))}))


FLOOR_SQL = f"SELECT field, 'exact_floor.' || field AS key, max(n)::BIGINT AS num, sum(n)::BIGINT AS den FROM (SELECT field, value, count(*) AS n FROM facts WHERE field IN ({EXACT_SQL}) GROUP BY 1, 2) GROUP BY field"


def majority(rows, field="field", value="value"):
    counts = rows.groupBy(field, value).agg(F.count("*").alias("n"))
    return counts.groupBy(field).agg(F.max("n").alias("num"), F.sum("n").alias("den"))


@query("exact_floor", f"WITH {FACTS_SQL} " + valued_sql(f"SELECT key, num, den FROM ({FLOOR_SQL})"))
def exact_floor(spark, sf_dir):
    found = majority(ev.facts(spark, sf_dir).where(F.col("field").isin(*C.EXACT_FIELDS)))
    return tallies.valued(found.select(F.concat(F.lit("exact_floor."), "field").alias("key"), "num", "den"))


@query("lift_over_floor", f"{K}, fl AS ({FLOOR_SQL}), r AS (SELECT field, count(*) FILTER (captured) AS num, count(*) AS den FROM coverage GROUP BY field) SELECT fl.field, r.num::DOUBLE / r.den::DOUBLE AS recall, fl.num::DOUBLE / fl.den::DOUBLE AS floor, r.num::DOUBLE / r.den::DOUBLE - fl.num::DOUBLE / fl.den::DOUBLE AS lift FROM fl JOIN r USING (field)")
def lift_over_floor(spark, sf_dir):
    rows = ev.coverage(spark, sf_dir).where(F.col("field").isin(*C.EXACT_FIELDS))
    recall = rows.groupBy("field").agg(share(F.count_if("captured"), F.count("*")).alias("recall"))
    floor = majority(rows).select("field", share(F.col("num"), F.col("den")).alias("floor"))
    return recall.join(floor, "field").withColumn("lift", F.col("recall") - F.col("floor"))


@query("pooled_metrics", f"{A}, t AS ({rates_sql(PRECISION, 'alignments', 'persona_id')}) " + "SELECT p.*, s.n_tallies, s.n_defined FROM (" + valued_sql("SELECT key, sum(num) AS num, sum(den) AS den FROM t GROUP BY key") + ") p JOIN (SELECT key, count(*) AS n_tallies, count(*) FILTER (den > 0) AS n_defined FROM t GROUP BY key) s USING (key)")
def pooled_metrics(spark, sf_dir):
    """Two levels: tallies by persona, then their sums."""
    return tallies.valued(tallies.pool(tallies.tally(ev.alignments(spark, sf_dir), ["persona_id"], tallies.precision_rates())))


@query("wilson_interval", "SELECT l_orderkey, l_linenumber, num, den, lo, hi FROM (" + valued_sql("SELECT l_orderkey, l_linenumber, 'x' AS key, least(l_linenumber, l_quantity)::BIGINT AS num, l_quantity::BIGINT AS den FROM lineitem", "l_orderkey, l_linenumber") + ")")
def wilson_interval(spark, sf_dir):
    t = ev.table(spark, sf_dir, "lineitem")
    rows = t.select("l_orderkey", "l_linenumber", F.least(F.col("l_linenumber").cast("double"), F.col("l_quantity")).cast("long").alias("num"), F.col("l_quantity").cast("long").alias("den"))
    lo, hi = wilson(F.col("num"), F.col("den"))
    return rows.withColumns({"lo": F.round(lo, 9), "hi": F.round(hi, 9)})


@query("judge_health", f"{A} SELECT style, count(*) AS judged_claims, count(*) FILTER (verdict = 'judge_error') AS errors, count(*) FILTER (verdict = 'span_invalid') AS span_invalid, count(*) FILTER (verdict IN ('judge_error', 'span_invalid'))::DOUBLE / count(*)::DOUBLE AS error_rate, count(*) FILTER (verdict IN ('judge_error', 'span_invalid'))::DOUBLE / count(*)::DOUBLE > 0.05 AS degraded FROM alignments WHERE method = 'judge' GROUP BY style")
def judge_health(spark, sf_dir):
    rows = ev.alignments(spark, sf_dir).where("method = 'judge'")
    found = rows.groupBy("style").agg(F.count("*").alias("judged_claims"), F.count_if(F.col("verdict") == "judge_error").alias("errors"), F.count_if(F.col("verdict") == "span_invalid").alias("span_invalid"))
    found = found.withColumn("error_rate", F.coalesce(share(F.col("errors") + F.col("span_invalid"), F.col("judged_claims")), F.lit(0.0)))
    return found.withColumn("degraded", F.col("error_rate") > C.DEGRADED_ABOVE)


RUN_SQL = f"SELECT persona_id, fact_id, field, k AS run, {u("'r:' || k || ':' || fact_id")} < 0.9 AS hit FROM facts, range(5) r(k)"


def runs(spark, sf_dir):
    f = ev.facts(spark, sf_dir).select("persona_id", "fact_id", "field", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("run"))
    return f.withColumn("hit", draw("r:", F.col("run"), ":", F.col("fact_id")) < 0.9)


@query("variance_floor", f"WITH {FACTS_SQL}, runs AS ({RUN_SQL}), v AS (SELECT persona_id, field, run, count(*) FILTER (hit)::DOUBLE / count(*)::DOUBLE AS value FROM runs GROUP BY ALL) SELECT persona_id, field, round(avg(value), 9) AS baseline_mean, round(stddev_samp(value), 9) AS sigma, count(value) AS runs, round(greatest(2 * coalesce(stddev_samp(value), 0), 0.005), 9) AS floor FROM v GROUP BY ALL")
def variance_floor(spark, sf_dir):
    rates = runs(spark, sf_dir).groupBy("persona_id", "field", "run").agg(share(F.count_if("hit"), F.count("*")).alias("value"))
    found = tallies.variance_floor(rates, ["persona_id", "field"])
    return found.select("persona_id", "field", *[F.round(c, 9).alias(c) for c in ("baseline_mean", "sigma")], "runs", F.round("floor", 9).alias("floor"))


@query("stability_jaccard", f"WITH {FACTS_SQL}, runs AS ({RUN_SQL}), h AS (SELECT * FROM runs WHERE hit), pairs AS (SELECT a.run AS i, b.run AS j, sum((a.hit AND b.hit)::INT) AS both_, sum((a.hit OR b.hit)::INT) AS either FROM runs a JOIN runs b ON a.fact_id = b.fact_id AND a.run < b.run GROUP BY ALL) SELECT sum(both_)::BIGINT AS num, sum(either)::BIGINT AS den, sum(both_)::DOUBLE / sum(either)::DOUBLE AS value FROM pairs WHERE either > 0")
def stability_jaccard(spark, sf_dir):
    return tallies.pairwise_jaccard(runs(spark, sf_dir).where("hit").select("run", F.col("fact_id").alias("item")), runs=5)


@query("diff_gate", f"""{K}, b AS ({rates_sql(RECALL, 'coverage', "'b'")}), n AS (SELECT * FROM coverage WHERE {u("'w:' || fact_id")} < 0.5), c AS (
  SELECT 'c', key, num, den FROM ({rates_sql(RECALL, 'n', "'c'")}) WHERE key <> 'recall_exact'), f AS (SELECT key, 0.005::DOUBLE AS floor FROM b WHERE key <> 'recall')
SELECT key, b.num::DOUBLE / nullif(b.den, 0) AS baseline, c.num::DOUBLE / nullif(c.den, 0) AS candidate, c.num::DOUBLE / nullif(c.den, 0) - b.num::DOUBLE / nullif(b.den, 0) AS delta, floor,
  key IN ('precision', 'precision_dealbreakers', 'recall_elicited', 'recall_dealbreakers') AS gated,
  CASE WHEN b.num IS NULL OR c.num IS NULL THEN 'missing' WHEN key NOT IN ('precision', 'precision_dealbreakers', 'recall_elicited', 'recall_dealbreakers') THEN 'ungated'
    WHEN c.num::DOUBLE / nullif(c.den, 0) < b.num::DOUBLE / nullif(b.den, 0) - floor THEN 'regression' ELSE 'pass' END AS verdict
FROM b FULL JOIN c USING (key) LEFT JOIN f USING (key)""")
def diff_gate(spark, sf_dir):
    """A run against half of itself."""
    rows, rates = ev.coverage(spark, sf_dir), tallies.recall_rates()
    base = tallies.valued(tallies.tally(rows, [], rates))
    half = tallies.valued(tallies.tally(rows.where(draw("w:", F.col("fact_id")) < 0.5), [], rates)).where("key != 'recall_exact'")
    floors = base.where("key != 'recall'").select("key", F.lit(C.MIN_FLOOR).alias("floor"))
    return gate.diff(base, half, floors)


@query("excluded_by_status", f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN x < 0.05 THEN 'refusal' WHEN x < 0.08 THEN 'truncated' ELSE 'provider_error' END AS status FROM (SELECT {u("'x:' || c_custkey")} AS x FROM customer) WHERE x < 0.1) GROUP BY status")
def excluded_by_status(spark, sf_dir):
    from proofmill.functions.text import status_of

    x = draw("x:", F.col("c_custkey"))
    rows = ev.table(spark, sf_dir, "customer").select(F.when(x < 0.05, "refusal").when(x < 0.08, "max_tokens").when(x < 0.1, "timeout").alias("reason"))
    return rows.where("reason is not null").groupBy(status_of(F.col("reason")).alias("status")).agg(F.count("*").alias("n"))


@query("style_mix", "SELECT c_mktsegment AS style, count(*) AS n FROM customer GROUP BY 1")
def style_mix(spark, sf_dir):
    return ev.table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("style")).agg(F.count("*").alias("n"))


@query("audit_agreement", f"SELECT lang, count(*) FILTER (human IS NOT NULL) AS decided, count(*) FILTER (human = quality) AS agreed, count(*) FILTER (human = quality)::DOUBLE / nullif(count(human), 0)::DOUBLE AS agreement FROM (SELECT lang, quality, CASE WHEN {u("'h:' || doc_id")} < 0.1 THEN NULL WHEN {u("'h:' || doc_id")} < 0.2 THEN 1 - quality ELSE quality END AS human FROM labels JOIN documents USING (doc_id)) GROUP BY lang")
def audit_agreement(spark, sf_dir):
    """Agreed over decided; a missing human label decides nothing."""
    rows = ev.table(spark, sf_dir, "labels").join(ev.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    h = draw("h:", F.col("doc_id"))
    rows = rows.withColumn("human", F.when(h < 0.1, None).when(h < 0.2, 1 - F.col("quality")).otherwise(F.col("quality")))
    found = rows.groupBy("lang").agg(F.count("human").alias("decided"), F.count_if(F.col("human") == F.col("quality")).alias("agreed"))
    return found.withColumn("agreement", share(F.col("agreed"), F.col("decided")))


@query("audit_sample", f"{A}, r AS (SELECT verdict, fact_id, row_number() OVER (PARTITION BY verdict ORDER BY sha256('audit:' || fact_id), fact_id) AS place FROM alignments) SELECT verdict, fact_id, place::INT AS place FROM r WHERE place <= 20")
def audit_sample(spark, sf_dir):
    return samplers.audit_sample(ev.alignments(spark, sf_dir), "verdict", "fact_id", 20, "audit:").select("verdict", "fact_id", "place")


@query("hallucination_examples", f"{A} SELECT persona_id, fact_id, field, claim FROM alignments WHERE verdict = 'unsupported' ORDER BY persona_id, fact_id LIMIT 5")
def hallucination_examples(spark, sf_dir):
    """A top-k report."""
    return ev.alignments(spark, sf_dir).where("verdict = 'unsupported'").orderBy("persona_id", "fact_id").limit(5).select("persona_id", "fact_id", "field", "claim")


@query("integrity_orphans", f"{A}, kept AS (SELECT persona_id, fact_id FROM alignments WHERE {u("'i:' || fact_id")} >= 0.01), f2 AS (SELECT persona_id, fact_id FROM facts WHERE {u("'k:' || fact_id")} >= 0.01) SELECT 'orphan' AS problem, a.persona_id, a.fact_id FROM kept a WHERE NOT EXISTS (SELECT 1 FROM f2 WHERE f2.persona_id = a.persona_id AND f2.fact_id = a.fact_id) UNION ALL SELECT 'unaligned', f.persona_id, f.fact_id FROM facts f WHERE claimed AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.persona_id = f.persona_id AND k.fact_id = f.fact_id)")
def integrity_orphans(spark, sf_dir):
    """Seeded faults: alignments without a fact, and claims without an alignment."""
    key, fact = ["persona_id", "fact_id"], F.col("fact_id")
    kept = ev.alignments(spark, sf_dir).where(draw("i:", fact) >= 0.01).select(*key)
    some = ev.facts(spark, sf_dir).where(draw("k:", fact) >= 0.01).select(*key)
    orphan = kept.join(some, key, "left_anti").select(F.lit("orphan").alias("problem"), *key)
    bare = ev.facts(spark, sf_dir).where("claimed").select(*key).join(kept, key, "left_anti")
    return orphan.unionByName(bare.select(F.lit("unaligned").alias("problem"), *key))


@query("integrity_violations", f"{A}, bad AS (SELECT fact_id, method, CASE WHEN {u("'m:' || fact_id")} < 0.01 THEN 'judge_error' ELSE verdict END AS verdict, disclosure, CASE WHEN {u("'y:' || fact_id")} < 0.01 THEN 'decoy' END AS decoy FROM alignments) SELECT 'exact_is_judge_only' AS rule, count(*) AS n FROM bad WHERE method = 'exact' AND verdict IN ('supported_offsheet', 'judge_error', 'span_invalid') UNION ALL SELECT 'decoy_without_contradict', count(*) FROM bad WHERE decoy IS NOT NULL AND disclosure <> 'contradict'")
def integrity_violations(spark, sf_dir):
    from proofmill.operators.integrity import violations

    fact = F.col("fact_id")
    rows = ev.alignments(spark, sf_dir).withColumn("verdict", F.when(draw("m:", fact) < 0.01, "judge_error").otherwise(F.col("verdict")))
    rows = rows.withColumn("decoy", F.when(draw("y:", fact) < 0.01, "decoy"))
    return violations(rows, {"exact_is_judge_only": (F.col("method") == "exact") & F.col("verdict").isin(*C.JUDGE_ONLY), "decoy_without_contradict": F.col("decoy").isNotNull() & (F.col("disclosure") != "contradict")})
