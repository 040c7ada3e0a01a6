"""Queries over turns, spans, profiles, noise and calls, with SQL for each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofmill.functions import constants as C
from proofmill.functions import text as T
from proofmill.functions.stats import draw
from proofmill.operators import claims, gate, noise, samplers, verdicts
from proofmill.operators.calls import looked_up, resolved
from proofmill.sources import evaluation as ev
from proofmill.sources.evaluation import BLANKS_SQL, FACTS_SQL, TURNS_SQL, tokens_sql, u

QUERIES: dict = {}
ORACLES: dict = {}
W = f"WITH {TURNS_SQL}"
WORDS_SQL = f"words AS (SELECT transcript_id, turn_ord, unnest(w) AS word, unnest(range(len(w))) AS wi FROM (SELECT transcript_id, turn_ord, {tokens_sql()} AS w FROM turns WHERE speaker = 'user'))"
NORMAL = "replace(lower(trim(regexp_replace(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}_]', ' ', 'g'), ' +', ' ', 'g'))), 'ß', 'ss')"
STEM = "CASE WHEN len(lower({0})) > 4 AND ends_with(lower({0}), 'es') THEN left(lower({0}), len({0}) - 2) WHEN len(lower({0})) > 3 AND ends_with(lower({0}), 's') AND NOT ends_with(lower({0}), 'ss') THEN left(lower({0}), len({0}) - 1) ELSE lower({0}) END"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in C.STOPWORDS) + "]"


def anchors_sql(text: str) -> str:
    found = f"regexp_extract_all(coalesce({text}, ''), '[0-9A-Za-z]+')"
    kept = f"list_filter({found}, lambda t, i: (regexp_matches(t, '[0-9]') OR (i > 1 AND regexp_matches(t, '^[A-Z]')) OR len({STEM.format('t')}) >= 4) AND {STEM.format('t')} <> '' AND NOT list_contains({STOP_SQL}, {STEM.format('t')}))"
    return f"list_sort(list_distinct(list_transform({kept}, lambda t: {STEM.format('t')})))"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("word_count", f"{W} SELECT transcript_id, turn_ord, word_count FROM turns")
def word_count(spark, sf_dir):
    return ev.turns(spark, sf_dir).select("transcript_id", "turn_ord", "word_count")


@query("simulated_minutes", f"{W} SELECT transcript_id, sum(word_count)::BIGINT AS words, round_even(sum(word_count) / 150.0::DOUBLE, 4) AS minutes FROM turns GROUP BY 1")
def simulated_minutes(spark, sf_dir):
    found = ev.turns(spark, sf_dir).groupBy("transcript_id").agg(F.sum("word_count").alias("words"))
    return found.withColumn("minutes", F.bround(F.col("words") / float(C.WORDS_PER_MINUTE), 4))


@query("role_remap", f"{W} SELECT transcript_id, turn_ord, CASE speaker WHEN 'interviewer' THEN 'user' ELSE 'assistant' END AS role FROM turns")
def role_remap(spark, sf_dir):
    return ev.turns(spark, sf_dir).select("transcript_id", "turn_ord", F.when(F.col("speaker") == "interviewer", "user").otherwise("assistant").alias("role"))


@query("render_transcript", f"{W} SELECT transcript_id, md5(string_agg('[t' || lpad(turn_ord::VARCHAR, 3, '0') || ' ' || speaker || '] ' || text, chr(10) ORDER BY turn_ord)) AS rendered_md5, count(*) AS turns FROM turns GROUP BY 1")
def render_transcript(spark, sf_dir):
    """Turns as lines in their order; a transcript is as long as its conversation."""
    line = F.concat(F.lit("[t"), F.lpad(F.col("turn_ord").cast("string"), 3, "0"), F.lit(" "), F.col("speaker"), F.lit("] "), F.col("text"))
    found = ev.turns(spark, sf_dir).groupBy("transcript_id").agg(F.sort_array(F.collect_list(F.struct("turn_ord", line.alias("line")))).alias("lines"))
    return found.select("transcript_id", F.md5(F.array_join("lines.line", "\n")).alias("rendered_md5"), F.size("lines").cast("long").alias("turns"))


@query("time_source", f"""{W}, noised AS (SELECT DISTINCT 'n' || transcript_id AS transcript_id, transcript_id AS source_id, {u("'z:' || transcript_id")} < 0.05 AS lost FROM turns), clean AS (SELECT transcript_id, sum(word_count)::BIGINT AS words FROM turns GROUP BY 1)
SELECT n.transcript_id, CASE WHEN lost THEN NULL ELSE words END AS words, CASE WHEN lost THEN 'no_source' ELSE 'ok' END AS state FROM noised n JOIN clean c ON c.transcript_id = n.source_id""")
def time_source(spark, sf_dir):
    """Noised transcripts take their time from the clean source; a missing one is a state, not a dropped row."""
    clean = ev.turns(spark, sf_dir).groupBy("transcript_id").agg(F.sum("word_count").alias("words"))
    lost = draw("z:", F.col("transcript_id")) < 0.05
    noised = clean.select(F.concat(F.lit("n"), F.col("transcript_id").cast("string")).alias("transcript_id"), F.when(~lost, F.col("transcript_id")).alias("source_id"))
    joined = noised.join(clean.withColumnRenamed("transcript_id", "source_id"), "source_id", "left")
    return joined.select("transcript_id", "words", F.when(F.col("source_id").isNull(), "no_source").otherwise("ok").alias("state"))


@query("first_disclosure", f"{W}, d AS (SELECT transcript_id, turn_ord, unnest(['f' || (turn_ord % 3), 'f' || (word_count % 5)]) AS fact_id FROM turns WHERE speaker = 'user') SELECT transcript_id, fact_id, min(turn_ord) AS turn_ord, count(DISTINCT turn_ord) AS tags FROM d GROUP BY ALL")
def first_disclosure(spark, sf_dir):
    t = ev.turns(spark, sf_dir).where("speaker = 'user'")
    facts = F.array_distinct(F.array(F.concat(F.lit("f"), (F.col("turn_ord") % 3).cast("string")), F.concat(F.lit("f"), (F.col("word_count") % 5).cast("string"))))
    tags = t.select("transcript_id", "turn_ord", F.explode(facts).alias("fact_id"))
    return tags.groupBy("transcript_id", "fact_id").agg(F.min("turn_ord").alias("turn_ord"), F.count_distinct("turn_ord").alias("tags"))


@query("span_normalize", f"SELECT item_id, {NORMAL.format('text')} AS normal FROM benchmark")
def span_normalize(spark, sf_dir):
    return ev.table(spark, sf_dir, "benchmark").select("item_id", T.span_normalize(F.col("text")).alias("normal"))


@query("span_normalize_unicode")
def span_normalize_unicode(spark, sf_dir):
    return ev.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.span_normalize_unicode("text")).alias("normal_md5"))


SPANS_SQL = f"""spans AS (
  SELECT transcript_id, turn_ord, CASE WHEN x < 0.05 THEN NULL WHEN x < 0.1 THEN turn_ord + 1000 WHEN x < 0.2 THEN turn_ord + 1 ELSE turn_ord END AS cited,
    CASE WHEN x >= 0.2 AND x < 0.3 THEN ' .. ' WHEN x >= 0.3 AND x < 0.4 THEN text WHEN x >= 0.4 AND x < 0.5 THEN 'Never ' || array_to_string(w[1:4], ' ') ELSE array_to_string(w[1:6], ' ') END AS span
  FROM (SELECT *, {u("'p:' || transcript_id || ':' || turn_ord")} AS x, {tokens_sql()} AS w FROM turns))"""


@query("span_check", f"""{W}, {SPANS_SQL} SELECT s.transcript_id, s.turn_ord, CASE WHEN s.cited IS NULL OR s.span IS NULL THEN 'none_cited' WHEN {NORMAL.format('s.span')} = '' THEN 'empty'
  WHEN len({tokens_sql('s.span')}) > 12 THEN 'too_long' WHEN t.turn_ord IS NULL THEN 'no_such_turn' WHEN t.speaker <> 'user' THEN 'not_user'
  WHEN NOT contains({NORMAL.format('t.text')}, {NORMAL.format('s.span')}) THEN 'not_verbatim' ELSE 'ok' END AS reason
FROM spans s LEFT JOIN turns t ON t.transcript_id = s.transcript_id AND t.turn_ord = s.cited""")
def span_check(spark, sf_dir):
    """Quoted spans joined with the turn they cite, then tested in order."""
    t = ev.turns(spark, sf_dir)
    x, w = draw("p:", F.col("transcript_id"), ":", F.col("turn_ord")), T.tokens(F.col("text"))
    spans = t.withColumn("x", x).withColumn("w", w).select(
        "transcript_id", "turn_ord",
        F.when(F.col("x") >= 0.05, F.when(F.col("x") < 0.1, F.col("turn_ord") + 1000).when(F.col("x") < 0.2, F.col("turn_ord") + 1).otherwise(F.col("turn_ord"))).alias("cited"),
        F.when(F.col("x").between(0.2, 0.2999999999), " .. ").when(F.col("x").between(0.3, 0.3999999999), F.col("text"))
        .when(F.col("x").between(0.4, 0.4999999999), F.concat(F.lit("Never "), F.array_join(F.slice("w", 1, 4), " "))).otherwise(F.array_join(F.slice("w", 1, 6), " ")).alias("span"),
    )
    cited = t.select("transcript_id", F.col("turn_ord").alias("cited"), "speaker", "text")
    rows = spans.join(cited, ["transcript_id", "cited"], "left")
    return rows.select("transcript_id", "turn_ord", verdicts.span_reason(F.col("cited"), F.col("span"), F.col("speaker"), F.col("text")).alias("reason"))


@query("anchor_tokens", f"{W} SELECT transcript_id, turn_ord, array_to_string({anchors_sql('text')}, ' ') AS anchors FROM turns")
def anchor_tokens(spark, sf_dir):
    return ev.turns(spark, sf_dir).select("transcript_id", "turn_ord", F.array_join(F.sort_array(T.anchor_tokens(F.col("text"))), " ").alias("anchors"))


@query("disclosure_mismatch", f"""{W}, vals AS (SELECT transcript_id, turn_ord AS fact_id, text AS v FROM turns WHERE speaker = 'interviewer'),
said AS (SELECT transcript_id, list_distinct(flatten(list(list_transform(regexp_extract_all(text, '[0-9A-Za-z]+'), lambda t: {STEM.format('t')})))) AS toks FROM turns WHERE speaker = 'user' GROUP BY 1)
SELECT v.transcript_id, v.fact_id, CASE WHEN len({anchors_sql('v')}) = 0 THEN 'unverifiable' WHEN toks IS NOT NULL AND list_has_any(toks, {anchors_sql('v')}) THEN 'spoken' ELSE 'mismatched' END AS state FROM vals v LEFT JOIN said USING (transcript_id)""")
def disclosure_mismatch(spark, sf_dir):
    """Whether any anchor of a value was spoken by the user."""
    t = ev.turns(spark, sf_dir)
    values = t.where("speaker = 'interviewer'").select("transcript_id", F.col("turn_ord").alias("fact_id"), T.anchor_tokens(F.col("text")).alias("anchors"))
    said = t.where("speaker = 'user'").select("transcript_id", F.explode(T.token_set(F.col("text"))).alias("token")).distinct()
    spoken = values.select("transcript_id", "fact_id", F.explode("anchors").alias("token")).join(said, ["transcript_id", "token"]).select("transcript_id", "fact_id", F.lit(True).alias("spoken")).distinct()
    rows = values.join(spoken, ["transcript_id", "fact_id"], "left")
    return rows.select("transcript_id", "fact_id", F.when(F.size("anchors") == 0, "unverifiable").when(F.col("spoken"), "spoken").otherwise("mismatched").alias("state"))


@query("untagged_capture", f"""{W}, tags AS (SELECT transcript_id, turn_ord, 'f' || (turn_ord % 4) AS fact_id FROM turns WHERE speaker = 'user' AND turn_ord >= 2 AND {u("'t:' || transcript_id || ':' || turn_ord")} < 0.5),
firsts AS (SELECT transcript_id, min(turn_ord) AS first_tagged FROM tags GROUP BY 1), caps AS (SELECT transcript_id, turn_ord AS cited, 'f' || (turn_ord % 4) AS fact_id FROM turns WHERE speaker = 'user')
SELECT c.transcript_id, c.fact_id, c.cited, CASE WHEN NOT EXISTS (SELECT 1 FROM tags t WHERE t.transcript_id = c.transcript_id AND t.fact_id = c.fact_id) THEN 'in_no_tag' WHEN c.cited < f.first_tagged THEN 'before_first_tag' ELSE 'tagged' END AS state FROM caps c LEFT JOIN firsts f USING (transcript_id)""")
def untagged_capture(spark, sf_dir):
    """A captured fact that no turn tags, or whose cited turn stands before the transcript's first tag of any fact."""
    t = ev.turns(spark, sf_dir).where("speaker = 'user'").withColumn("fact_id", F.concat(F.lit("f"), (F.col("turn_ord") % 4).cast("string")))
    tags = t.where((F.col("turn_ord") >= 2) & (draw("t:", F.col("transcript_id"), ":", F.col("turn_ord")) < 0.5))
    firsts = tags.groupBy("transcript_id").agg(F.min("turn_ord").alias("first_tagged"))
    tagged = tags.select("transcript_id", "fact_id", F.lit(True).alias("tagged")).distinct()
    rows = t.select("transcript_id", "fact_id", F.col("turn_ord").alias("cited")).join(tagged, ["transcript_id", "fact_id"], "left").join(firsts, "transcript_id", "left")
    state = F.when(F.col("tagged").isNull(), "in_no_tag").when(F.col("cited") < F.col("first_tagged"), "before_first_tag").otherwise("tagged")
    return rows.select("transcript_id", "fact_id", "cited", state.alias("state"))


@query("followup_policy", f"""{W}, d AS (SELECT transcript_id, turn_ord, word_count < 40 AS too_short, ['f' || (turn_ord % 3), 'f9'] AS targets, ['f' || (word_count % 3)] AS addressed, {u("'u:' || transcript_id || ':' || turn_ord")} < 0.6 AS proposed FROM turns WHERE speaker = 'user')
SELECT transcript_id, turn_ord, too_short, array_to_string(list_filter(targets, lambda t: NOT list_contains(addressed, t)), ',') AS missing, proposed AND (too_short OR len(list_filter(targets, lambda t: NOT list_contains(addressed, t))) > 0) AS follow_up FROM d""")
def followup_policy(spark, sf_dir):
    """A proposed follow-up stays only after a short answer or with a target left; none is ever made up."""
    t = ev.turns(spark, sf_dir).where("speaker = 'user'")
    targets = F.array(F.concat(F.lit("f"), (F.col("turn_ord") % 3).cast("string")), F.lit("f9"))
    missing = F.array_except(targets, F.array(F.concat(F.lit("f"), (F.col("word_count") % 3).cast("string"))))
    short = F.col("word_count") < C.FOLLOWUP_TRIGGER_WORDS
    proposed = draw("u:", F.col("transcript_id"), ":", F.col("turn_ord")) < 0.6
    return t.select("transcript_id", "turn_ord", short.alias("too_short"), F.array_join(missing, ",").alias("missing"), (proposed & (short | (F.size(missing) > 0))).alias("follow_up"))


PROFILE_SQL = f"""profiles AS (SELECT doc_id AS extraction_id, n_chars AS age, CASE WHEN doc_id % 3 = 0 THEN ' Yes ' WHEN doc_id % 3 = 1 THEN '  ' END AS wants_kids, doc_id % 2 = 0 AS has_kids,
  source AS location, {tokens_sql()} AS interests FROM documents),
flat AS (SELECT extraction_id, 'age' AS field, 'int' AS kind, age::VARCHAR AS value, 0 AS place, 0 AS item FROM profiles UNION ALL SELECT extraction_id, 'wants_kids', 'str', wants_kids, 2, 0 FROM profiles
  UNION ALL SELECT extraction_id, 'has_kids', 'bool', has_kids::VARCHAR, 3, 0 FROM profiles UNION ALL SELECT extraction_id, 'location', 'str', location, 5, 0 FROM profiles
  UNION ALL SELECT extraction_id, 'interests', 'str', unnest(interests), 8, unnest(range(len(interests))) FROM profiles),
named AS (SELECT *, CASE WHEN kind = 'str' THEN replace(lower(trim(regexp_replace(value, '{BLANKS_SQL}+', ' ', 'g'))), 'ß', 'ss') ELSE value END AS same FROM flat WHERE value IS NOT NULL AND (kind <> 'str' OR trim(regexp_replace(value, '{BLANKS_SQL}+', ' ', 'g')) <> '')),
firsts AS (SELECT *, row_number() OVER (PARTITION BY extraction_id, field, kind, same ORDER BY item) AS nth FROM named),
claims AS (SELECT extraction_id, field, kind, value, (row_number() OVER (PARTITION BY extraction_id ORDER BY place, item))::INT AS claim_ord FROM firsts WHERE nth = 1)"""


def profiles(spark, sf_dir):
    """Whole texts are dealt by id before they become words: a shuffle of the words is four times as large."""
    i, parts = F.col("doc_id"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = ev.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "text").repartition(parts, "doc_id")
    return docs.select(
        i.alias("extraction_id"), F.col("n_chars").alias("age"), F.when(i % 3 == 0, " Yes ").when(i % 3 == 1, "  ").alias("wants_kids"),
        (i % 2 == 0).alias("has_kids"), F.col("source").alias("location"), T.tokens(F.col("text")).alias("interests"),
    )


@query("claims_unpivot", f"WITH {PROFILE_SQL} SELECT extraction_id, field, kind, value FROM claims")
def claims_unpivot(spark, sf_dir):
    return claims.unpivot(profiles(spark, sf_dir)).select("extraction_id", "field", "kind", "value")


@query("claim_ids", f"WITH {PROFILE_SQL} SELECT extraction_id, claim_ord, printf('c%02d', claim_ord) AS claim_id, field FROM claims")
def claim_ids(spark, sf_dir):
    return claims.unpivot(profiles(spark, sf_dir)).select("extraction_id", "claim_ord", "claim_id", "field")


@query("claims_deduped", f"WITH {PROFILE_SQL} SELECT extraction_id, count(*) - count(DISTINCT same) AS claims_deduped FROM named WHERE field = 'interests' GROUP BY 1")
def claims_deduped(spark, sf_dir):
    rows = profiles(spark, sf_dir).select("extraction_id", F.lit("interests").alias("field"), F.lit("str").alias("kind"), F.explode("interests").alias("value"))
    return claims.deduped(rows)


@query("values_match", f"""SELECT o_orderkey, CASE WHEN k1 <> k2 THEN false ELSE lower(trim(a)) = lower(trim(b)) END AS matches FROM (SELECT o_orderkey, o_orderstatus AS a, CASE WHEN x < 0.3 THEN lower(o_orderstatus) || ' ' WHEN x < 0.5 THEN 'Z' ELSE o_orderstatus END AS b, 'str' AS k1, CASE WHEN x > 0.8 THEN 'int' ELSE 'str' END AS k2 FROM (SELECT *, {u("'q:' || o_orderkey")} AS x FROM orders))""")
def values_match(spark, sf_dir):
    o, x = ev.table(spark, sf_dir, "orders"), draw("q:", F.col("o_orderkey"))
    b = F.when(x < 0.3, F.concat(F.lower("o_orderstatus"), F.lit(" "))).when(x < 0.5, "Z").otherwise(F.col("o_orderstatus"))
    return o.select("o_orderkey", T.values_match(F.lit("str"), F.col("o_orderstatus"), F.when(x > 0.8, "int").otherwise("str"), b).alias("matches"))


@query("fact_sheet", f"WITH {FACTS_SQL} SELECT persona_id, string_agg(fact_id || ' | ' || field || ' | ' || value || ' | ' || disclosure, chr(10) ORDER BY fact_id) AS sheet FROM facts GROUP BY 1")
def fact_sheet(spark, sf_dir):
    line = F.concat_ws(" | ", F.col("fact_id").cast("string"), "field", "value", "disclosure")
    found = ev.facts(spark, sf_dir).groupBy("persona_id").agg(F.sort_array(F.collect_list(F.struct("fact_id", line.alias("line")))).alias("x"))
    return found.select("persona_id", F.array_join("x.line", "\n").alias("sheet"))


KEY = "'7:' || transcript_id || ':' || turn_ord || ':' || wi"
EDITS_SQL = f"""edits AS (SELECT *, CASE WHEN fired THEN CASE WHEN b < 0.4 THEN 'drop' WHEN b < 0.7 THEN 'homophone' WHEN b < 0.9 THEN 'filler' ELSE 'punctuation' END END AS operation
  FROM (SELECT *, {u(KEY + " || ':a'")} < 0.1 AS fired, {u(KEY + " || ':b'")} AS b FROM words))"""


def edited(spark, sf_dir, rate=0.1):
    return noise.edits(noise.words_of_turns(ev.turns(spark, sf_dir)), rate)


@query("noise_ops", f"{W}, {WORDS_SQL}, {EDITS_SQL} SELECT operation, count(*) AS n FROM edits WHERE fired GROUP BY 1")
def noise_ops(spark, sf_dir):
    return edited(spark, sf_dir).where("fired").groupBy("operation").agg(F.count("*").alias("n"))


@query("noise_edit_rate", f"{W}, {WORDS_SQL}, {EDITS_SQL} SELECT transcript_id, count(*) AS words, count(*) FILTER (fired) AS edits FROM edits GROUP BY 1")
def noise_edit_rate(spark, sf_dir):
    return edited(spark, sf_dir).groupBy("transcript_id").agg(F.count("*").alias("words"), F.count_if("fired").alias("edits"))


@query("noised_word_counts", f"{W}, {WORDS_SQL}, {EDITS_SQL} SELECT transcript_id, turn_ord, sum(CASE operation WHEN 'drop' THEN 0 WHEN 'filler' THEN CASE WHEN floor({u("transcript_id || ':' || turn_ord || ':' || wi || ':f'")} * 4) = 3 THEN 3 ELSE 2 END ELSE 1 END)::BIGINT AS word_count FROM edits GROUP BY ALL")
def noised_word_counts(spark, sf_dir):
    return noise.noised_words(edited(spark, sf_dir))


@query("noise_curve", f"{W}, {WORDS_SQL}, r(rate) AS (VALUES (0.0::DOUBLE), (0.05), (0.1), (0.2)) SELECT rate, count(*) AS words, count(*) FILTER ({u(KEY + " || ':a'")} < rate) AS edits FROM words, r GROUP BY 1")
def noise_curve(spark, sf_dir):
    """All rates in one pass: a word fires at each rate above its draw."""
    words = noise.words_of_turns(ev.turns(spark, sf_dir))
    a = draw("7:", F.col("transcript_id"), ":", F.col("turn_ord"), ":", F.col("wi"), ":a")
    rates = F.array(*map(F.lit, (0.0, 0.05, 0.1, 0.2)))
    return words.select(a.alias("a"), F.explode(rates).alias("rate")).groupBy("rate").agg(F.count("*").alias("words"), F.count_if(F.col("a") < F.col("rate")).alias("edits"))


@query("sentence_index", f"{W}, {WORDS_SQL}, e AS (SELECT *, regexp_matches(regexp_replace(word, '[\"'')\\]}}]+$', ''), '[.!?]$')::INT AS ends FROM words) SELECT transcript_id, turn_ord, wi::INT AS wi, coalesce(sum(ends) OVER (PARTITION BY transcript_id, turn_ord ORDER BY wi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence FROM e")
def sentence_index(spark, sf_dir):
    return noise.sentence_index(noise.words_of_turns(ev.turns(spark, sf_dir))).select("transcript_id", "turn_ord", "wi", "sentence")


@query("balanced_classes", "SELECT c_mktsegment, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('cls:' || c_custkey), c_custkey) - 1) % 4 AS class, c_custkey FROM customer")
def balanced_classes(spark, sf_dir):
    return samplers.balanced(ev.table(spark, sf_dir, "customer"), "c_custkey", 4, "cls:", ["c_mktsegment"]).select("c_mktsegment", "class", "c_custkey")


@query("split_counts", "WITH t AS (SELECT p_partkey, p_size::BIGINT AS total FROM part), m AS (SELECT *, total * w AS exact, floor(total * w)::BIGINT AS base FROM t, (VALUES (0, 'volunteer', 0.6::DOUBLE), (1, 'needs_followup', 0.3), (2, 'hedge', 0.1)) v(ord, name, w)), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY round(exact - base, 9) DESC, ord) AS place, total - sum(base) OVER (PARTITION BY p_partkey) AS short FROM m) SELECT p_partkey, total, name, base + CASE WHEN place <= short THEN 1 ELSE 0 END AS part FROM r")
def split_counts(spark, sf_dir):
    return samplers.split_counts(ev.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("total")), C.DISCLOSURE_MIX)


REASONS = ("error", "refusal", "max_tokens", "model_context_window_exceeded", "schema_invalid")
REASON_SQL = "['error', 'refusal', 'max_tokens', 'model_context_window_exceeded', 'schema_invalid'][event_id % 5 + 1]"


@query("status_map", f"""WITH r AS (SELECT {REASON_SQL} AS reason, 'call ' || event_id || ' ended: ' || {REASON_SQL} AS message FROM events)
SELECT reason, CASE reason WHEN 'refusal' THEN 'refusal' WHEN 'max_tokens' THEN 'truncated' WHEN 'model_context_window_exceeded' THEN 'truncated' WHEN 'schema_invalid' THEN 'schema_invalid' ELSE 'provider_error' END AS status,
  CASE WHEN contains(message, 'refusal') THEN 'refusal' WHEN contains(message, 'max_tokens') OR contains(message, 'model_context_window_exceeded') THEN 'truncated' WHEN contains(message, 'schema_invalid') THEN 'schema_invalid' ELSE 'provider_error' END AS by_message, count(*) AS n FROM r GROUP BY ALL""")
def status_map(spark, sf_dir):
    """Statuses of reasons, and of messages that hold a reason."""
    reason = F.element_at(F.array(*map(F.lit, REASONS)), (F.col("event_id") % 5 + 1).cast("int"))
    e = ev.table(spark, sf_dir, "events").select(reason.alias("reason"), F.concat(F.lit("call "), F.col("event_id").cast("string"), F.lit(" ended: "), reason).alias("message"))
    return e.groupBy("reason", T.status_of(F.col("reason")).alias("status"), T.status_in(F.col("message")).alias("by_message")).agg(F.count("*").alias("n"))


@query("response_lookup", f"""WITH req AS (SELECT event_id, event_type AS role, 'role:' || event_type || ':' || substr(sha256(event_id::VARCHAR), 1, 12) AS k FROM events), canned AS (SELECT k, 'exact' AS response FROM req WHERE {u("'cr:' || event_id")} < 0.4 UNION ALL SELECT 'role:click', 'by role')
SELECT event_id, coalesce(a.response, b.response) AS response, CASE WHEN coalesce(a.response, b.response) IS NULL THEN 'provider_error' ELSE 'ok' END AS state FROM req LEFT JOIN canned a USING (k) LEFT JOIN canned b ON b.k = 'role:' || role""")
def response_lookup(spark, sf_dir):
    """The exact key first, then the role's; none is an error state."""
    e = ev.table(spark, sf_dir, "events")
    requests = e.select("event_id", F.col("event_type").alias("role"), F.concat(F.lit("role:"), F.col("event_type"), F.lit(":"), F.substring(F.sha2(F.col("event_id").cast("string").cast("binary"), 256), 1, 12)).alias("key"))
    canned = requests.where(draw("cr:", F.col("event_id")) < 0.4).select("key", F.lit("exact").alias("response")).unionByName(spark.createDataFrame([("role:click", "by role")], "key string, response string"))
    return looked_up(requests, canned).select("event_id", "response", "state")


@query("call_resolution", f"""WITH t AS (SELECT event_id, a AS attempt, CASE WHEN {u("'at:' || event_id || ':' || a")} < 0.3 THEN 'provider_error' WHEN {u("'at:' || event_id || ':' || a")} < 0.4 THEN 'refusal' ELSE 'ok' END AS status FROM events, range(1, 4) r(a)),
f AS (SELECT event_id, min(attempt) FILTER (status <> 'provider_error') AS first FROM t GROUP BY 1) SELECT t.event_id, t.attempt::INT AS attempts, t.status FROM t JOIN f ON f.event_id = t.event_id AND t.attempt = coalesce(f.first, 3)""")
def call_resolution(spark, sf_dir):
    """Up to three attempts; only the provider's own errors are tried again."""
    e = ev.table(spark, sf_dir, "events").select("event_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("attempt"))
    x = draw("at:", F.col("event_id"), ":", F.col("attempt"))
    return resolved(e.withColumn("status", F.when(x < 0.3, "provider_error").when(x < 0.4, "refusal").otherwise("ok")), ["event_id"])


KINDS_SQL = "CASE WHEN key IN (" + ", ".join(f"'{k}'" for k in C.STATIC_RATES) + ") THEN 'rate' WHEN key IN ('untagged_capture', 'claims_deduped') THEN 'count' WHEN regexp_extract(key, '^[^.]*\\.(.+)$', 1) <> '' THEN CASE split_part(key, '.', 1) " + " ".join(f"WHEN '{p}' THEN '{k}'" for p, k in C.DYNAMIC_KINDS.items()) + " END END"


@query("classify_keys", f"SELECT key, {KINDS_SQL} AS kind FROM (SELECT DISTINCT 'recall_by_field.' || source AS key FROM documents UNION ALL SELECT * FROM (VALUES ('precision'), ('yield.q01'), ('yield.'), ('nothing.x'), ('claims_deduped'), ('yield_per_minute.q1.b')))")
def classify_keys(spark, sf_dir):
    keys = ev.table(spark, sf_dir, "documents").select(F.concat(F.lit("recall_by_field."), "source").alias("key")).distinct()
    more = spark.createDataFrame([(k,) for k in ("precision", "yield.q01", "yield.", "nothing.x", "claims_deduped", "yield_per_minute.q1.b")], "key string")
    return keys.unionByName(more).select("key", gate.kind_of(F.col("key")).alias("kind"))


@query("expected_keys", "SELECT key, " + KINDS_SQL + " AS kind FROM (SELECT unnest([" + ", ".join(f"'{k}'" for k in (*C.STATIC_RATES, *C.STATIC_COUNTS)) + "]) AS key" + "".join(f" UNION ALL SELECT '{p}.' || unnest([{', '.join(repr(x) for x in xs)}])" for p, xs in (("recall_by_field", C.SCORED_FIELDS), ("precision_by_field", C.SCORED_FIELDS), ("exact_floor", C.EXACT_FIELDS), ("recall_exact_by_field", C.EXACT_FIELDS), ("recall_by_disclosure", C.DISCLOSURES[:3]), ("followup_share_by_style", C.STYLES), ("yield", ("q01", "q02")), ("yield_per_minute", ("q01", "q02")))) + ")")
def expected_keys(spark, sf_dir):
    return gate.expected_keys(spark, question_ids=("q01", "q02"))


@query("schema_gate", f"""WITH p AS (SELECT event_id, CASE WHEN x < 0.1 THEN '{{"k": "7"}}' WHEN x < 0.15 THEN '{{"k": true}}' WHEN x < 0.2 THEN '{{"j": 1}}' ELSE props END AS props FROM (SELECT event_id, props, {u("'sg:' || event_id")} AS x FROM events))
SELECT event_id, CASE coalesce(json_type(props, '$.k'), 'none') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'none' THEN 'missing' ELSE 'other' END AS kind,
  coalesce(json_type(props, '$.k') IN ('UBIGINT', 'BIGINT'), true) AS valid FROM p""")
def schema_gate(spark, sf_dir):
    """The type of a JSON value is told from the parsed value, so a wrong one is seen and not nulled; a missing one is allowed."""
    e, x = ev.table(spark, sf_dir, "events"), draw("sg:", F.col("event_id"))
    props = F.when(x < 0.1, F.lit('{"k": "7"}')).when(x < 0.15, F.lit('{"k": true}')).when(x < 0.2, F.lit('{"j": 1}')).otherwise(F.col("props"))
    kind = T.json_kind(F.parse_json(props), "$.k")
    return e.select("event_id", kind.alias("kind"), kind.isin("integer", "missing").alias("valid"))


@query("content_hash", "SELECT doc_id, sha256(text) AS digest, substr(sha256(text), 1, 6) AS short FROM documents")
def content_hash(spark, sf_dir):
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return ev.table(spark, sf_dir, "documents").select("doc_id", digest.alias("digest"), F.substring(digest, 1, 6).alias("short"))


@query("transcript_ids", "SELECT DISTINCT conv_id, 'p' || lpad(conv_id::VARCHAR, 3, '0') || '__s1' || CASE WHEN conv_id % 2 = 0 THEN '__shuf' ELSE '' END || '__n' || lpad((conv_id % 3 * 10)::VARCHAR, 3, '0') AS stem FROM conversations")
def transcript_ids(spark, sf_dir):
    c = ev.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    i = F.col("conv_id")
    return c.select(i, T.transcript_stem(F.concat(F.lit("p"), F.lpad(i.cast("string"), 3, "0")), F.lit("s1"), F.when(i % 2 == 0, 1), (i % 3) / 10).alias("stem"))


@query("format_metrics", "SELECT n_nationkey, kind, CASE kind WHEN 'rate' THEN printf('%.1f', n_nationkey / 32.0::DOUBLE * 100) || '%' WHEN 'count' THEN format('{:,}', n_nationkey * 1000) WHEN 'ratio' THEN printf('%.2f', n_nationkey / 4.0::DOUBLE) ELSE 'n/a' END AS shown FROM nation, (VALUES ('rate'), ('count'), ('ratio'), ('none')) k(kind)")
def format_metrics(spark, sf_dir):
    rows = ev.table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, ("rate", "count", "ratio", "none")))).alias("kind"))
    n = F.col("n_nationkey").cast("double")
    value = F.when(F.col("kind") == "rate", n / 32).when(F.col("kind") == "count", n * 1000).when(F.col("kind") == "ratio", n / 4)
    return rows.select("n_nationkey", "kind", T.format_value(value, F.col("kind")).alias("shown"))
