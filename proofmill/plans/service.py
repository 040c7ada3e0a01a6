"""Queries of calls, keys and verdicts around an outside service, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofmill.functions import text as T
from proofmill.functions.stats import draw
from proofmill.operators import calls, gate
from proofmill.sources import evaluation as ev
from proofmill.sources.evaluation import u

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


ATTEMPTS_SQL = f"""tried AS (SELECT event_id, attempt, CASE WHEN {_s("cs", "event_id", "attempt")} < 0.25 THEN 'error' ELSE 'ok' END AS status, CASE WHEN {_s("cs", "event_id", "attempt")} < 0.2 THEN 'provider_error' WHEN {_s("cs", "event_id", "attempt")} < 0.25 THEN 'refusal' END AS reason,
  CASE WHEN {_s("cs", "event_id", "attempt")} >= 0.25 THEN CASE WHEN {_s("cp", "event_id", "attempt")} < 0.3 THEN '{{"k": "x"}}' ELSE '{{"k": ' || attempt || '}}' END END AS payload FROM events, (VALUES (1), (2), (3)) v(attempt))"""


@query("call_chain", f"""WITH {ATTEMPTS_SQL}, b AS (SELECT *, status = 'ok' AND payload = '{{"k": "x"}}' AS broken FROM tried), n AS (SELECT *, sum(broken::INT) OVER (PARTITION BY event_id ORDER BY attempt) AS nth FROM b),
e AS (SELECT event_id, min(attempt) AS attempt FROM n WHERE attempt = 3 OR NOT (coalesce(reason, '') = 'provider_error' OR broken AND nth = 1) GROUP BY 1), ended AS (SELECT n.* FROM n JOIN e USING (event_id, attempt)),
hits AS (SELECT event_id, '{{"k":0}}' AS hit FROM events WHERE {_s("cc", "event_id")} < 0.3 AND {_s("cc", "event_id")} >= 0.05)
SELECT event_id, hit IS NOT NULL AS cached, CASE WHEN hit IS NOT NULL THEN 0 ELSE attempt END AS attempts, CASE WHEN hit IS NOT NULL THEN 'ok' WHEN broken THEN 'error' ELSE status END AS status,
  CASE WHEN hit IS NULL THEN CASE WHEN broken THEN 'schema_invalid' ELSE reason END END AS reason, CASE WHEN hit IS NOT NULL THEN hit WHEN status = 'ok' AND NOT broken THEN payload END AS payload FROM ended LEFT JOIN hits USING (event_id)""")
def call_chain(spark, sf_dir):
    """The cache first, then up to three attempts with one correction; a payload that is no JSON is no hit."""
    e = ev.table(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("string").alias("cache_key"))
    c = _u("cc", "event_id")
    cache = e.where(c < 0.3).select("cache_key", F.when(c < 0.05, "{broken").otherwise('{"k":0}').alias("payload"))
    a = e.select("event_id", "cache_key", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("attempt"))
    x = _u("cs", "event_id", "attempt")
    wrong = _u("cp", "event_id", "attempt") < 0.3
    payload = F.when(x >= 0.25, F.when(wrong, '{"k": "x"}').otherwise(F.concat(F.lit('{"k": '), F.col("attempt").cast("string"), F.lit("}"))))
    attempts = a.select("cache_key", "attempt", F.when(x < 0.25, "error").otherwise("ok").alias("status"), F.when(x < 0.2, "provider_error").when(x < 0.25, "refusal").alias("reason"), payload.alias("payload"))
    return calls.called(e, cache, attempts, T.json_kind(F.parse_json("payload"), "$.k") == "integer").drop("cache_key")


@query("cache_keys", """SELECT event_id, sha256('{"effort":"low","json_schema":"null","max_tokens":"' || event_id % 7 || '","messages":"null","model":"m","role":"' || event_type || '","system":"[lab-role:' || event_type || ']\\ntext","thinking":"null","nonce":"' || CASE WHEN event_id % 2 = 0 THEN 'null' ELSE 'floor' || event_id % 3 END || '"}') AS cache_key, event_type AS role FROM events""")
def cache_keys(spark, sf_dir):
    """Keys of requests, whose prompts name their role; the nonce alone tells floor runs apart."""
    e = ev.table(spark, sf_dir, "events")
    i = F.col("event_id")
    rows = e.select(i, F.lit("low").alias("effort"), (i % 7).alias("max_tokens"), F.lit("m").alias("model"), F.col("event_type").alias("role"), T.with_role(F.col("event_type"), F.lit("text")).alias("system"), F.when(i % 2 == 1, F.concat(F.lit("floor"), (i % 3).cast("string"))).alias("nonce"))
    return calls.keyed(rows).select("event_id", "cache_key", T.role_in(F.col("system")).alias("role"))


@query("token_usage", "SELECT event_type, sum(event_id % 100)::BIGINT AS input_tokens, sum(user_id % 50)::BIGINT AS output_tokens, sum(CASE WHEN event_id % 3 = 0 THEN 10 ELSE 0 END)::BIGINT AS cache_read_tokens, 0::BIGINT AS cache_creation_tokens FROM events GROUP BY 1")
def token_usage(spark, sf_dir):
    e = ev.table(spark, sf_dir, "events")
    rows = e.select("event_type", (F.col("event_id") % 100).alias("input_tokens"), (F.col("user_id") % 50).alias("output_tokens"), F.when(F.col("event_id") % 3 == 0, 10).alias("cache_read_tokens"), F.lit(None).cast("long").alias("cache_creation_tokens"))
    return calls.usage(rows, ["event_type"]).select("event_type", "input_tokens", "output_tokens", "cache_read_tokens", F.col("cache_creation_tokens").cast("long").alias("cache_creation_tokens"))


@query("derived_verdicts", f"""SELECT p_partkey, CASE WHEN b IS NULL OR c IS NULL THEN 'unknown' WHEN NOT gated THEN 'ungated' WHEN c < b - 0.05::DOUBLE THEN 'regression' ELSE 'pass' END AS verdict
FROM (SELECT p_partkey, CASE WHEN {_s("vb", "p_partkey")} >= 0.1 THEN {_s("vb", "p_partkey")} END AS b, CASE WHEN {_s("vc", "p_partkey")} >= 0.1 THEN {_s("vc", "p_partkey")} END AS c, p_partkey % 3 > 0 AS gated FROM part)""")
def derived_verdicts(spark, sf_dir):
    """Verdicts of rows that came without one."""
    p = ev.table(spark, sf_dir, "part")
    b, c = _u("vb", "p_partkey"), _u("vc", "p_partkey")
    rows = p.select("p_partkey", F.when(b >= 0.1, b).alias("b"), F.when(c >= 0.1, c).alias("c"), (F.col("p_partkey") % 3 > 0).alias("gated"))
    return rows.select("p_partkey", gate.derived_verdict(F.col("b"), F.col("c"), F.lit(0.05), F.col("gated")).alias("verdict"))


@query("id_strings", "SELECT c_custkey, 'p' || c_custkey || ':v1' AS extraction_id, 'v1.floor' || c_custkey % 5 AS floor_tag, '20260102-0304-' || substr(sha256('{\"seed\":' || c_custkey || '}'), 1, 6) AS run_id, 'effort=low, seed=' || c_custkey AS params FROM customer")
def id_strings(spark, sf_dir):
    c = F.col("c_custkey")
    at = F.lit("2026-01-02 03:04:59").cast("timestamp")
    params = F.create_map(F.lit("seed"), c.cast("string"), F.lit("nonce"), F.lit("x"), F.lit("effort"), F.lit("low"))
    return ev.table(spark, sf_dir, "customer").select(
        c, T.extraction_id(F.concat(F.lit("p"), c.cast("string")), F.lit("v1")).alias("extraction_id"), T.floor_tag(F.lit("v1"), c % 5).alias("floor_tag"),
        T.run_id(at, F.concat(F.lit('{"seed":'), c.cast("string"), F.lit("}"))).alias("run_id"), T.flat_params(params).alias("params"),
    )


@query("time_source_problems", f"""WITH t AS (SELECT conv_id, {_s("ts", "conv_id")} AS x FROM (SELECT DISTINCT conv_id FROM conversations)), scored AS (SELECT conv_id, 'n' || conv_id AS transcript_id, 'p' || CASE WHEN x < 0.2 THEN conv_id + 1 ELSE conv_id END AS persona_id, CASE WHEN x >= 0.6 THEN NULL WHEN x >= 0.4 THEN 'gone' WHEN x >= 0.3 THEN 'x' || conv_id ELSE 'c' || conv_id END AS source FROM t)
SELECT transcript_id, CASE WHEN source IS NULL OR source = 'gone' THEN 'no_source' WHEN source = 'x' || conv_id THEN 'source_is_noised' ELSE 'source_of_another_persona' END AS problem FROM scored WHERE source IS NULL OR source = 'gone' OR source = 'x' || conv_id OR persona_id <> 'p' || conv_id""")
def time_source_problems(spark, sf_dir):
    """Seeded faults: noised copies without a source, with a noised one, or with another persona's."""
    from proofmill.operators import transcripts

    c = F.col("conv_id")
    t = ev.table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("x", _u("ts", "conv_id"))
    name = lambda p, i=c: F.concat(F.lit(p), i.cast("string"))
    source = F.when(F.col("x") >= 0.6, None).when(F.col("x") >= 0.4, "gone").when(F.col("x") >= 0.3, name("x")).otherwise(name("c"))
    scored = t.select(name("n").alias("transcript_id"), F.when(F.col("x") < 0.2, name("p", c + 1)).otherwise(name("p")).alias("persona_id"), F.lit(0.1).alias("noise_rate"), source.alias("source_transcript_id"))
    null = F.lit(None).cast("string")
    clean = t.select(name("c").alias("transcript_id"), name("p").alias("persona_id"), F.lit(0.0).alias("noise_rate"), null.alias("source_transcript_id"))
    copies = t.select(name("x").alias("transcript_id"), name("p").alias("persona_id"), F.lit(0.1).alias("noise_rate"), null.alias("source_transcript_id"))
    return transcripts.source_problems(scored, clean.unionByName(copies))
