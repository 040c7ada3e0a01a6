"""A whole evaluation over the driver's customers: sheets, interviews, claims, judging, coverage and scores.

Every customer is a persona whose skeleton, canned answers, claims and judge
entries are draws from its own number; the operators do the rest. The same
tables exist as SQL for an independent engine. Tables that others are made from
are written once a session and folder, which also cuts their lineage.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill.functions import constants as C
from proofmill.functions.stats import draw
from proofmill.functions.text import dedupe_key, is_blank
from proofmill.operators import coverage, interview, judging, personas, scores, verdicts
from proofmill.operators.joins import matched
from proofmill.sources.evaluation import BLANKS_SQL, table, tokens_sql, u
from proofmill.sources.shared import stored

KEY = ["persona_id"]
SCRIPT = [
    {"question_id": f"q{n:02d}", "text": f"Question {n}: what about {C.SCORED_FIELDS[n % 13]} and {C.SCORED_FIELDS[(n + 4) % 13]}?", "targets": [C.SCORED_FIELDS[n % 13], C.SCORED_FIELDS[(n + 4) % 13]], "max_followups": 2 if n % 5 == 0 else 1}
    for n in range(1, 11)
]
PADDING = {"terse": 5, "balanced": 38, "rambling": 60, "tangential": 60}


def _p(tag: str, *more: str):
    """A draw by persona and more columns."""
    parts = [f"7:{tag}:", F.col("persona_id")]
    for c in more:
        parts += [":", F.col(c)]
    return draw(*parts)


def _list(values):
    return F.array(*map(F.lit, values))


@dataclass(frozen=True)
class Lab:
    spark: SparkSession
    sf_dir: str

    @cached_property
    def sheets(self) -> DataFrame:
        return stored(personas.skeletons(table(self.spark, self.sf_dir, "customer").select(F.col("c_custkey").alias("i"))), "lab-sheets")

    @cached_property
    def payloads(self) -> DataFrame:
        """What a generator returned: judged facts in their order."""
        rows = self.sheets.select("persona_id", "n_volunteer", "n_needs_followup", "n_specific", F.explode(F.sequence(F.lit(1).cast("long"), "n_judged")).alias("place"))
        pick = lambda values, tag: F.element_at(_list(values), (F.floor(_p(tag, "place") * len(values)) + 1).cast("int"))
        return rows.select(
            "persona_id", "place", pick(C.JUDGED_FIELDS, "jf").alias("field"), F.lit("str").alias("kind"),
            F.when(_p("jx", "place") < 0.05, "as is").otherwise(F.concat(pick(C.CITIES, "jc"), F.lit(" "), pick(C.OCCUPATIONS, "jo"))).alias("value"),
            F.when(F.col("place") <= F.col("n_specific"), "specific").otherwise("generic").alias("specificity"),
            F.when(F.col("place") <= F.col("n_volunteer"), "volunteer").when(F.col("place") <= F.col("n_volunteer") + F.col("n_needs_followup"), "needs_followup").otherwise("hedge").alias("disclosure"),
            F.lit("core").alias("importance"),
        )

    @cached_property
    def facts(self) -> DataFrame:
        return stored(personas.truth_sheets(self.sheets, self.payloads), "lab-facts")

    @cached_property
    def _steps(self) -> DataFrame:
        steps = [F.struct(F.lit(q["question_id"]).alias("question_id"), F.lit(k).alias("k"), _list(q["targets"]).alias("targets")) for q in SCRIPT for k in range(q["max_followups"] + 1)]
        return self.sheets.select("persona_id", "style", F.explode(F.array(*steps)).alias("s")).select("persona_id", "style", "s.*")

    @cached_property
    def answers(self) -> DataFrame:
        number, place = F.substr("persona_id", F.lit(2)).cast("long"), F.substr("fact_id", F.lit(2)).cast("long")
        k = F.when(F.col("disclosure") == "volunteer", 0).when(F.col("disclosure") == "needs_followup", 1).when(_p("hd", "fact_id") < 0.5, 0)
        words = F.when(_p("say", "fact_id") < 0.9, F.concat(F.lit(" and "), "value")).otherwise("")
        told = self.facts.select("persona_id", F.concat(F.lit("q"), F.lpad(((place * 7 + number) % 10 + 1).cast("string"), 2, "0")).alias("question_id"), k.alias("k"), "fact_id", words.alias("words")).where("k is not null")
        told = told.groupBy("persona_id", "question_id", "k").agg(F.sort_array(F.collect_list(F.struct("fact_id", "words"))).alias("t"))
        by = ["persona_id", "question_id", "k"]
        rows = matched(self._steps, told, by, "left")
        ids = F.coalesce(F.col("t.fact_id"), F.array().cast("array<string>"))
        none = F.array().cast("array<string>")
        reported = F.concat(ids, F.when(_p("inv", *by[1:]) < 0.05, F.array(F.lit("f99"))).otherwise(none), F.when(_p("dup", *by[1:]) < 0.1, F.slice(ids, 1, 1)).otherwise(none))
        padding = F.element_at(F.create_map(*[F.lit(x) for pair in PADDING.items() for x in pair]), F.col("style"))
        utterance = F.concat(F.lit("Well"), F.coalesce(F.array_join("t.words", ""), F.lit("")), F.repeat(F.lit(" indeed"), padding))
        return rows.select(*by, F.when(_p("em", *by[1:]) < 0.001, "  ").otherwise(utterance).alias("utterance"), reported.alias("reported"), F.when(_p("ae", *by[1:]) < 0.002, "model stopped: refusal").alias("error"))

    @cached_property
    def decisions(self) -> DataFrame:
        by = ["question_id", "k"]
        addressed = F.when(_p("da", *by) < 0.5, F.slice("targets", 1, 1)).otherwise(F.concat("targets", F.array(F.lit("nothing"))))
        followup = F.when(_p("df", *by) < 0.8, "Could you say more about that?")
        return self._steps.where("k > 0").select("persona_id", *by, addressed.alias("addressed"), followup.alias("followup"), F.when(_p("de", *by) < 0.01, "timeout").alias("error"))

    @cached_property
    def played(self) -> tuple[DataFrame, DataFrame]:
        known = self.facts.groupBy("persona_id").agg(F.collect_list("fact_id").alias("known"))
        turns, results = interview.simulate(known, SCRIPT, self.answers, self.decisions)
        return stored(turns, "lab-turns"), stored(results, "lab-results")

    @property
    def turns(self) -> DataFrame:
        return self.played[0]

    @cached_property
    def told(self) -> DataFrame:
        return stored(coverage.disclosures(self.turns, KEY), "lab-told")

    @cached_property
    def extractions(self) -> DataFrame:
        """The personas whose interview ended."""
        return matched(self.played[1].where("status = 'ok'").select("persona_id"), self.sheets.select("persona_id", "style"), "persona_id")

    @cached_property
    def raw_claims(self) -> DataFrame:
        f = F.col("field")
        v, exact = _p("cv", "fact_id"), f.isin(*C.EXACT_FIELDS)
        wrong = F.when(f == "age", (F.col("value").try_cast("int") + 1).cast("string")).when(f == "has_kids", F.when(F.col("value") == "true", "false").otherwise("true")).when(exact, "other").otherwise("something else entirely")
        value = F.when(v < 0.8, F.col("value")).when(f.isin(*C.UNSURE_FIELDS) & (v < 0.9), C.UNSURE).otherwise(wrong)
        kind = F.when((f == "age") & (_p("ck", "fact_id") < 0.03), "str").otherwise(F.col("kind"))
        rows = matched(self.facts.where(_p("c", "fact_id") < 0.8), self.extractions.select("persona_id"), "persona_id").select("persona_id", "field", "fact_id", "value", kind.alias("kind"), value.alias("claimed"), (v < 0.8).alias("right"))
        copies = F.concat(
            F.array(F.struct(F.lit(0).alias("copy"), F.col("claimed").alias("v"))),
            F.when(~exact & (_p("c1", "fact_id") < 0.1), F.array(F.struct(F.lit(1).alias("copy"), F.upper("claimed").alias("v")))).otherwise(F.array().cast("array<struct<copy: int, v: string>>")),
            F.when(~exact & (_p("c2", "fact_id") < 0.1), F.array(F.struct(F.lit(2).alias("copy"), F.concat("claimed", F.lit(" indeed")).alias("v")))).otherwise(F.array().cast("array<struct<copy: int, v: string>>")),
        )
        rows = rows.select("persona_id", "field", "fact_id", F.col("value").alias("truth"), "kind", "right", F.explode(copies).alias("x")).select("persona_id", "field", "fact_id", "truth", "kind", "right", "x.copy", F.col("x.v").alias("value"))
        return stored(rows.where(~is_blank(F.col("value"))).withColumn("same", dedupe_key(F.col("kind"), F.col("value"))), "lab-raw-claims")

    @cached_property
    def claims(self) -> DataFrame:
        """persona_id, claim_id, field, kind, value, and where they come from: fact_id, truth, right."""
        place = F.array_position(_list(C.SCORED_FIELDS), F.col("field"))
        first = Window.partitionBy("persona_id", "field", "kind", "same").orderBy("fact_id", "copy")
        order = Window.partitionBy("persona_id").orderBy(place, "fact_id", "copy")
        kept = self.raw_claims.withColumn("nth", F.row_number().over(first)).where("nth = 1")
        return stored(kept.withColumn("claim_id", F.format_string("c%02d", F.row_number().over(order))).drop("nth", "same", "copy"), "lab-claims")

    @cached_property
    def deduped(self) -> DataFrame:
        same = self.raw_claims.groupBy("persona_id").agg((F.count("*") - F.count_distinct("field", "kind", "same")).alias("claims_deduped"))
        return same

    @cached_property
    def _cited(self) -> DataFrame:
        judged = self.claims.where(F.col("field").isin(*C.JUDGED_FIELDS))
        return matched(judged, self.told.select("persona_id", "fact_id", "disclosed_turn_id"), ["persona_id", "fact_id"], "left")

    @cached_property
    def entries(self) -> DataFrame:
        """persona_id, claim_id, entry_ord, matched_fact_id, span_turn_id, span_text, specificity; some claims have an earlier, empty one."""
        t, null = _p("jt", "claim_id"), F.lit(None).cast("string")
        matched = F.when(F.col("right"), F.when(_p("jm", "claim_id") < 0.1, "f01").otherwise(F.col("fact_id")))
        turn = F.when(F.col("disclosed_turn_id").isNotNull(), F.when(t < 0.05, "t001").when(t < 0.08, "t999").otherwise(F.col("disclosed_turn_id")))
        rows = self._cited.where(_p("je", "claim_id") >= 0.04)
        last = rows.select("persona_id", "claim_id", F.lit(2).alias("entry_ord"), matched.alias("matched_fact_id"), turn.alias("span_turn_id"), F.when(_p("js", "claim_id") < 0.15, "never said this").otherwise(F.col("truth")).alias("span_text"), F.lit("specific").alias("specificity"))
        early = rows.where(_p("jd", "claim_id") < 0.1).select("persona_id", "claim_id", F.lit(1).alias("entry_ord"), *[null.alias(c) for c in ("matched_fact_id", "span_turn_id", "span_text", "specificity")])
        return last.unionByName(early)

    @cached_property
    def retries(self) -> DataFrame:
        rows = self._cited.where(_p("jr", "claim_id") < 0.6)
        return rows.select("persona_id", "claim_id", F.lit(1).alias("entry_ord"), F.when(F.col("right"), F.col("fact_id")).alias("matched_fact_id"), F.col("disclosed_turn_id").alias("span_turn_id"), F.col("truth").alias("span_text"), F.lit("specific").alias("specificity"))

    @cached_property
    def alignments(self) -> DataFrame:
        """Exact alignments and judged ones after a second asking, one a claim."""
        exact = verdicts.exact_alignments(self.claims.select("persona_id", "claim_id", "field", "kind", "value"), self.facts, KEY)
        first = stored(judging.judged(self.claims, self.entries, self.facts, self.turns, KEY), "lab-judged")
        judged = judging.retried(first, self.retries, self.facts, self.turns, KEY)
        null = F.lit(None).cast("string")
        exact = exact.select("persona_id", "claim_id", "field", F.lit("exact").alias("method"), "verdict", "matched_fact_id", *[null.alias(c) for c in ("span_turn_id", "span_text", "specificity")], F.lit(0).alias("bad_references"), F.lit(False).alias("first_pass"))
        return stored(exact.unionByName(judged), "lab-alignments")

    @cached_property
    def health(self) -> DataFrame:
        return judging.health(self.alignments, KEY)

    @cached_property
    def covered(self) -> DataFrame:
        facts = matched(self.facts, self.extractions.select("persona_id"), "persona_id")
        return stored(coverage.rechecked(coverage.coverage(facts, self.alignments, self.turns, KEY), self.alignments, KEY), "lab-covered")

    @cached_property
    def mismatches(self) -> DataFrame:
        return stored(coverage.mismatches(self.facts, self.turns, KEY), "lab-mismatches")

    @cached_property
    def untagged(self) -> DataFrame:
        return stored(coverage.untagged(self.covered, self.alignments, self.turns, KEY), "lab-untagged")

    @cached_property
    def tallies(self) -> DataFrame:
        """Every metric of every extraction."""
        out = self.untagged.select("persona_id", "fact_id", F.lit(True).alias("_untagged"))
        credited = matched(self.covered, out, ["persona_id", "fact_id"], "left").withColumn("credited", F.col("counts") & F.col("_untagged").isNull())
        every = self.extractions
        parts = [
            scores.precision_tallies(self.alignments, every, KEY), scores.recall_tallies(self.covered, every, KEY), scores.judge_tallies(self.health, every, KEY), scores.yield_tallies(credited, self.turns, KEY),
            scores.followup_tallies(credited, every, KEY), scores.audit_tallies(self.mismatches, self.untagged, self.deduped, every, KEY),
        ]
        found = parts[0]
        for more in parts[1:]:
            found = found.unionByName(more)
        return stored(found, "lab-tallies")


_LABS: dict[tuple[str, str], Lab] = {}


def lab(spark: SparkSession, sf_dir: str) -> Lab:
    return _LABS.setdefault((spark.sparkContext.applicationId, sf_dir), Lab(spark, sf_dir))


def _d(tag: str, *more: str) -> str:
    return u(f"'7:{tag}:' || persona_id" + "".join(f" || ':' || {c}" for c in more))


def _pick(values, tag: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][floor({_d(tag, 'place')} * {len(values)})::INT + 1]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_SLOTS = ", ".join(f"('{name}', {len(classes)}, [{', '.join(chr(39) + c.replace(chr(39), chr(39) * 2) + chr(39) for c in classes)}])" for name, classes in personas.SLOTS.items())
_EXACT = " UNION ALL ".join(
    f"SELECT persona_id, 'f{n:02d}' AS fact_id, '{f}' AS field, '{ {'age': 'int', 'has_kids': 'bool'}.get(f, 'str') }' AS kind, {f}::VARCHAR AS value, '{'specific' if f == 'age' else 'generic'}' AS specificity, \"disclosure:{f}\" AS disclosure, '{'dealbreaker' if f in C.DEALBREAKER_FIELDS else 'core'}' AS importance FROM sheets"
    for n, f in enumerate(C.EXACT_FIELDS, 1)
)
_SCRIPT = ", ".join(f"('{q['question_id']}', {n}, '{q['text']}', ['{q['targets'][0]}', '{q['targets'][1]}'], {k})" for n, q in enumerate(SCRIPT) for k in range(q["max_followups"] + 1))
_NORMAL = "replace(lower(trim(regexp_replace(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}_]', ' ', 'g'), ' +', ' ', 'g'))), 'ß', 'ss')"

SHEETS_SQL = f"""slots AS (SELECT c_custkey AS i, s.* FROM customer, (VALUES {_SLOTS}) s(slot, n, classes)),
dealt AS (SELECT i, slot, classes[(row_number() OVER (PARTITION BY slot ORDER BY md5('7:' || slot || ':' || i), i) - 1) % n + 1] AS value FROM slots),
wide AS (SELECT i, printf('p%03d', i) AS persona_id, {", ".join(f'max(value) FILTER (slot = {chr(39)}{n}{chr(39)}) AS "{n}"' for n in personas.SLOTS)},
  (25 + floor({u("'7:age:' || i")} * 21))::INT AS age, (12 + floor({u("'7:n:' || i")} * 5))::BIGINT AS n_judged FROM dealt GROUP BY i),
quota AS (SELECT t, name, floor(round(t * w, 9))::BIGINT + CASE WHEN row_number() OVER (PARTITION BY t ORDER BY round(t * w - floor(round(t * w, 9)), 9) DESC, ord) <= t - sum(floor(round(t * w, 9))) OVER (PARTITION BY t) THEN 1 ELSE 0 END AS part
  FROM range(12, 17) r(t), (VALUES (0, 'volunteer', 0.6::DOUBLE), (1, 'needs_followup', 0.3), (2, 'hedge', 0.1)) v(ord, name, w)),
sheets AS (SELECT w.*, max(part) FILTER (name = 'volunteer') OVER p AS n_volunteer, max(part) FILTER (name = 'needs_followup') OVER p AS n_needs_followup, max(part) FILTER (name = 'hedge') OVER p AS n_hedge, round_even(0.6::DOUBLE * n_judged, 0)::BIGINT AS n_specific
  FROM wide w JOIN quota ON t = n_judged WINDOW p AS (PARTITION BY i) QUALIFY row_number() OVER (PARTITION BY i ORDER BY name) = 1)"""
FACTS_SQL = f"""{SHEETS_SQL}, payloads AS (SELECT persona_id, place, {_pick(C.JUDGED_FIELDS, "jf")} AS field, CASE WHEN {_d("jx", "place")} < 0.05 THEN 'as is' ELSE {_pick(C.CITIES, "jc")} || ' ' || {_pick(C.OCCUPATIONS, "jo")} END AS value,
  CASE WHEN place <= n_specific THEN 'specific' ELSE 'generic' END AS specificity, CASE WHEN place <= n_volunteer THEN 'volunteer' WHEN place <= n_volunteer + n_needs_followup THEN 'needs_followup' ELSE 'hedge' END AS disclosure
  FROM (SELECT *, unnest(range(1, n_judged + 1)) AS place FROM sheets)),
facts AS ({_EXACT} UNION ALL SELECT persona_id, printf('f%02d', place + 5), field, 'str', value, specificity, disclosure, 'core' FROM payloads)"""
TURNS_SQL = f"""{FACTS_SQL},
told0 AS (SELECT persona_id, 'q' || lpad(((substr(fact_id, 2)::BIGINT * 7 + substr(persona_id, 2)::BIGINT) % 10 + 1)::VARCHAR, 2, '0') AS question_id, CASE disclosure WHEN 'volunteer' THEN 0 WHEN 'needs_followup' THEN 1 ELSE CASE WHEN {_d("hd", "fact_id")} < 0.5 THEN 0 END END AS k,
  fact_id, CASE WHEN {_d("say", "fact_id")} < 0.9 THEN ' and ' || value ELSE '' END AS words FROM facts),
told1 AS (SELECT persona_id, question_id, k, list(fact_id ORDER BY fact_id) AS ids, string_agg(words, '' ORDER BY fact_id) AS words FROM told0 WHERE k IS NOT NULL GROUP BY ALL),
steps AS (SELECT p.persona_id, p.style, s.* FROM sheets p, (VALUES {_SCRIPT}) s(question_id, place, question, targets, k)),
said AS (SELECT s.*, coalesce(ids, []) AS ids, CASE WHEN {_d("em", "s.question_id", "s.k").replace("persona_id", "s.persona_id")} < 0.001 THEN '  ' ELSE 'Well' || coalesce(words, '') || repeat(' indeed', CASE style WHEN 'terse' THEN 5 WHEN 'balanced' THEN 38 ELSE 60 END) END AS utterance
  FROM steps s LEFT JOIN told1 t ON t.persona_id = s.persona_id AND t.question_id = s.question_id AND t.k = s.k),
plays AS (SELECT *, list_concat(list_concat(ids, CASE WHEN {_d("inv", "question_id", "k")} < 0.05 THEN ['f99'] ELSE [] END), CASE WHEN {_d("dup", "question_id", "k")} < 0.1 THEN ids[1:1] ELSE [] END) AS reported,
  CASE WHEN {_d("ae", "question_id", "k")} < 0.002 THEN 'refusal' WHEN trim(utterance) = '' THEN 'provider_error' END AS bad_answer, k > 0 AND {_d("de", "question_id", "k")} < 0.01 AS bad_decision,
  {_d("da", "question_id", "k")} < 0.5 AS half, {_d("df", "question_id", "k")} < 0.8 AS proposed, lag(len({tokens_sql("utterance")})) OVER (PARTITION BY persona_id, question_id ORDER BY k) AS words_before FROM said),
asked AS (SELECT *, CASE WHEN k = 0 THEN question WHEN NOT bad_decision AND proposed AND (words_before < 40 OR half) THEN 'Could you say more about that?' END AS asks FROM plays),
reach AS (SELECT *, min((asks IS NOT NULL)::INT) OVER (PARTITION BY persona_id, question_id ORDER BY k) = 1 AS reached FROM asked),
tried AS (SELECT *, coalesce(lag(reached) OVER (PARTITION BY persona_id, question_id ORDER BY k), true) AS tried FROM reach),
results AS (SELECT persona_id, coalesce(first(bad_answer ORDER BY place, k) FILTER (reached AND bad_answer IS NOT NULL), 'ok') AS status, count(*) FILTER (tried AND bad_decision) AS followup_errors,
  coalesce(sum(list_count(list_filter(reported, lambda f: f = 'f99'))) FILTER (reached), 0)::BIGINT AS invented FROM tried GROUP BY 1),
extractions AS (SELECT persona_id, style FROM results JOIN sheets USING (persona_id) WHERE status = 'ok'),
turns AS (SELECT *, printf('t%03d', turn_ord) AS turn_id, len({tokens_sql()})::BIGINT AS word_count FROM (
  SELECT persona_id, row_number() OVER (PARTITION BY persona_id ORDER BY place, k, side) AS turn_ord, CASE side WHEN 0 THEN 'interviewer' ELSE 'user' END AS speaker, question_id, k > 0 AS is_followup, CASE side WHEN 0 THEN asks ELSE trim(utterance) END AS text,
    CASE side WHEN 0 THEN [] ELSE list_filter(ids, lambda f: f <> 'f99') END AS disclosed_fact_ids
  FROM tried JOIN extractions USING (persona_id), (VALUES (0), (1)) v(side) WHERE reached)),
told AS (SELECT persona_id, fact_id, min(turn_ord) AS first_ord, arg_min(turn_id, turn_ord) AS disclosed_turn_id, arg_min(question_id, turn_ord) AS question_id, arg_min(is_followup, turn_ord) AS via_followup
  FROM (SELECT *, unnest(disclosed_fact_ids) AS fact_id FROM turns WHERE speaker = 'user') GROUP BY ALL)"""
_PLACE = "list_position([" + ", ".join(f"'{f}'" for f in C.SCORED_FIELDS) + "], field)"
CLAIMS_SQL = f"""{TURNS_SQL},
base AS (SELECT persona_id, field, fact_id, value AS truth, CASE WHEN field = 'age' AND {_d("ck", "fact_id")} < 0.03 THEN 'str' ELSE kind END AS kind, {_d("cv", "fact_id")} < 0.8 AS is_right,
  CASE WHEN {_d("cv", "fact_id")} < 0.8 THEN value WHEN field IN {_in(C.UNSURE_FIELDS)} AND {_d("cv", "fact_id")} < 0.9 THEN 'unsure' WHEN field = 'age' THEN (try_cast(value AS INT) + 1)::VARCHAR WHEN field = 'has_kids' THEN CASE value WHEN 'true' THEN 'false' ELSE 'true' END
    WHEN field IN {_in(C.EXACT_FIELDS)} THEN 'other' ELSE 'something else entirely' END AS claimed FROM facts JOIN extractions USING (persona_id) WHERE {_d("c", "fact_id")} < 0.8),
raw AS (SELECT *, CASE copy WHEN 0 THEN claimed WHEN 1 THEN upper(claimed) ELSE claimed || ' indeed' END AS value FROM base, (VALUES (0), (1), (2)) v(copy)
  WHERE copy = 0 OR field NOT IN {_in(C.EXACT_FIELDS)} AND (copy = 1 AND {_d("c1", "fact_id")} < 0.1 OR copy = 2 AND {_d("c2", "fact_id")} < 0.1)),
folded AS (SELECT *, CASE WHEN kind = 'str' THEN lower(trim(regexp_replace(value, '{BLANKS_SQL}+', ' ', 'g'))) ELSE value END AS same FROM raw),
kept AS (SELECT * FROM folded QUALIFY row_number() OVER (PARTITION BY persona_id, field, kind, same ORDER BY fact_id, copy) = 1),
claims AS (SELECT *, printf('c%02d', row_number() OVER (PARTITION BY persona_id ORDER BY {_PLACE}, fact_id, copy)) AS claim_id FROM kept)"""


def _judged_sql(name: str, entries: str) -> str:
    """Verdicts of ``entries`` (persona_id, claim_id, field, has_entry, matched, turn_id, span)."""
    return f"""{name} AS (SELECT e.*, f.fact_id IS NOT NULL AS fits, has_entry AND matched IS NOT NULL AND f.fact_id IS NULL AS bad, CASE WHEN NOT has_entry THEN 'judge_error' WHEN e.turn_id IS NULL OR span IS NULL THEN 'unsupported'
  WHEN {_NORMAL.format("span")} = '' OR len({tokens_sql("span")}) > 12 OR t.speaker IS NULL OR t.speaker <> 'user' OR NOT contains({_NORMAL.format("t.text")}, {_NORMAL.format("span")}) THEN 'span_invalid' WHEN f.fact_id IS NOT NULL THEN 'supported' ELSE 'supported_offsheet' END AS verdict
  FROM {entries} e LEFT JOIN facts f ON f.persona_id = e.persona_id AND f.fact_id = e.matched AND f.field = e.field LEFT JOIN turns t ON t.persona_id = e.persona_id AND t.turn_id = e.turn_id)"""


ALIGNED_SQL = f"""{CLAIMS_SQL},
cited AS (SELECT c.*, t.disclosed_turn_id FROM claims c LEFT JOIN told t USING (persona_id, fact_id) WHERE field IN {_in(C.JUDGED_FIELDS)}),
entries AS (SELECT persona_id, claim_id, field, fact_id, is_right, truth, disclosed_turn_id, {_d("je", "claim_id")} >= 0.04 AS has_entry, CASE WHEN is_right THEN CASE WHEN {_d("jm", "claim_id")} < 0.1 THEN 'f01' ELSE fact_id END END AS matched,
  CASE WHEN disclosed_turn_id IS NOT NULL THEN CASE WHEN {_d("jt", "claim_id")} < 0.05 THEN 't001' WHEN {_d("jt", "claim_id")} < 0.08 THEN 't999' ELSE disclosed_turn_id END END AS turn_id, CASE WHEN {_d("js", "claim_id")} < 0.15 THEN 'never said this' ELSE truth END AS span FROM cited),
{_judged_sql("judged1", "entries")},
again AS (SELECT persona_id, claim_id, field, true AS has_entry, CASE WHEN is_right THEN fact_id END AS matched, disclosed_turn_id AS turn_id, truth AS span FROM judged1 WHERE verdict = 'span_invalid' AND {_d("jr", "claim_id")} < 0.6),
{_judged_sql("judged2", "again")},
aligned AS (SELECT c.persona_id, c.claim_id, c.field, 'exact' AS method, CASE WHEN c.kind = f.kind AND lower(c.value) = lower(f.value) THEN 'supported' WHEN c.field IN {_in(C.UNSURE_FIELDS)} AND c.value = 'unsure' AND f.value <> 'unsure' THEN 'abstained' ELSE 'unsupported' END AS verdict, f.fact_id AS matched, NULL AS turn_id, 0 AS bad, false AS first_pass
    FROM claims c JOIN facts f ON f.persona_id = c.persona_id AND f.field = c.field WHERE c.field IN {_in(C.EXACT_FIELDS)}
  UNION ALL SELECT a.persona_id, a.claim_id, a.field, 'judge', coalesce(b.verdict, a.verdict), CASE WHEN b.claim_id IS NOT NULL THEN b.matched ELSE a.matched END, CASE WHEN b.claim_id IS NOT NULL THEN b.turn_id ELSE a.turn_id END, a.bad::INT + coalesce(b.bad::INT, 0), a.verdict = 'span_invalid'
    FROM judged1 a LEFT JOIN judged2 b USING (persona_id, claim_id)),
alignments AS (SELECT persona_id, claim_id, field, method, verdict, CASE WHEN verdict = 'supported' THEN matched END AS matched_fact_id, CASE WHEN verdict IN ('span_invalid', 'supported', 'supported_offsheet') THEN turn_id END AS span_turn_id, bad AS bad_references, first_pass FROM aligned)"""
HEALTH_SQL = f"""{ALIGNED_SQL},
health AS (SELECT persona_id, 1 + max(first_pass::INT)::BIGINT AS calls, count(*) AS judged_claims, count(*) FILTER (verdict = 'judge_error') AS errors, count(*) FILTER (verdict = 'span_invalid') AS span_invalid, count(*) FILTER (first_pass) AS span_invalid_first_pass, sum(bad_references)::BIGINT AS invalid_fact_refs
  FROM alignments WHERE method = 'judge' GROUP BY 1)"""
COVERED_SQL = f"""{HEALTH_SQL},
covered AS (SELECT f.*, a.by_claim_id, a.by_claim_id IS NOT NULL AS captured, t.disclosed_turn_id, t.question_id, t.via_followup FROM facts f JOIN extractions USING (persona_id)
  LEFT JOIN (SELECT persona_id, matched_fact_id AS fact_id, first(claim_id ORDER BY method <> 'exact', claim_id) AS by_claim_id FROM alignments WHERE verdict = 'supported' GROUP BY ALL) a ON a.persona_id = f.persona_id AND a.fact_id = f.fact_id
  LEFT JOIN told t ON t.persona_id = f.persona_id AND t.fact_id = f.fact_id)"""
