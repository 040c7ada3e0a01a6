"""Operators of the whole evaluation, on small tables made by hand."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from proofmill.functions import constants as C
from proofmill.functions import text as T
from proofmill.functions.misheard import CONFUSIONS, HOMOPHONES
from proofmill.operators import calls, coverage, gate, integrity, interview, judging, noise, personas, report, samplers, scores, transcripts
from proofmill.sources import artifacts

SCRIPT = [{"question_id": "q01", "text": "What work?", "targets": ["occupation"], "max_followups": 2}, {"question_id": "q02", "text": "Kids?", "targets": ["wants_kids", "has_kids"]}]


def test_interview(spark):
    known = spark.createDataFrame([(p, ["f01", "f02"]) for p in "abcd"], "persona_id string, known array<string>")
    long = "word " * 50
    answers = [
        ("a", "q01", 0, " short ", ["f02", "f02", "f77"], None), ("a", "q01", 1, long, [], None), ("a", "q01", 2, "never reached", [], None), ("a", "q02", 0, long, None, None), ("a", "q02", 1, "more", ["f01"], None),
        ("b", "q01", 0, long, [], None), ("b", "q02", 0, " ", [], None), ("c", "q01", 0, "x", [], None), ("c", "q02", 0, None, [], "model stopped: max_tokens"), ("d", "q01", 0, "x", [], None), ("d", "q02", 0, "y", [], None),
    ]
    decisions = [
        ("a", "q01", 1, [], " Go on? ", None), ("a", "q01", 2, ["occupation", "nothing"], "Again?", None), ("a", "q02", 1, ["wants_kids"], "And?", None),
        ("b", "q01", 1, ["occupation"], "Not asked", None), ("d", "q01", 1, None, None, "timeout"), ("d", "q02", 1, [], "  ", None),
    ]
    a = spark.createDataFrame(answers, "persona_id string, question_id string, k int, utterance string, reported array<string>, error string")
    d = spark.createDataFrame(decisions, "persona_id string, question_id string, k int, addressed array<string>, followup string, error string")
    turns, results = interview.simulate(known, SCRIPT, a, d)
    got = {r.persona_id: (r.status, r.followup_errors, r.invented) for r in results.collect()}
    assert got == {"a": ("ok", 0, 1), "b": ("provider_error", 0, 0), "c": ("truncated", 0, 0), "d": ("ok", 1, 0)}
    rows = {}
    for r in turns.orderBy("turn_ord").collect():
        rows.setdefault(r.persona_id, []).append((r.turn_id, r.speaker, r.text, r.is_followup, r.disclosed_fact_ids))
    assert [x[:3] for x in rows["a"]] == [("t001", "interviewer", "What work?"), ("t002", "user", "short"), ("t003", "interviewer", "Go on?"), ("t004", "user", long.strip()), ("t005", "interviewer", "Kids?"), ("t006", "user", long.strip()), ("t007", "interviewer", "And?"), ("t008", "user", "more")]
    assert rows["a"][1][4] == ["f02"] and rows["a"][7][3:] == (True, ["f01"]) and len(rows["d"]) == 4 and set(rows) == {"a", "d"}
    assert interview.simulate(known.where("false"), SCRIPT, a, d)[0].count() == 0


def attempt(rows, schema=lambda p: p == "good", most=3):
    """A call in plain steps: (attempts, status, reason)."""
    corrected = False
    for n, (status, reason, payload) in enumerate(rows[:most], 1):
        last = n == min(most, len(rows))
        if status == "ok" and not schema(payload):
            if not corrected and not last:
                corrected = True
                continue
            return n, "error", "schema_invalid"
        if status == "ok" or reason != "provider_error" or last:
            return n, status, reason


def test_calls(spark):
    kinds = [("error", "provider_error", None), ("error", "refusal", None), ("ok", None, "good"), ("ok", None, "bad")]
    cases = {f"{i}{j}{k}": [kinds[i], kinds[j], kinds[k]] for i in range(4) for j in range(4) for k in range(4)}
    attempts = spark.createDataFrame([(key, n, *a) for key, rows in cases.items() for n, a in enumerate(rows, 1)], "cache_key string, attempt int, status string, reason string, payload string")
    requests = spark.createDataFrame([(k,) for k in [*cases, "hit", "none"]], "cache_key string")
    cache = spark.createDataFrame([("hit", "1"), ("hit", "1"), ("000", "{broken")], "cache_key string, payload string")
    got = {r.cache_key: r for r in calls.called(requests, cache, attempts, F.col("payload") == "good").collect()}
    for key, rows in cases.items():
        assert (got[key].attempts, got[key].status, got[key].reason) == attempt(rows), key
    assert (got["hit"].cached, got["hit"].attempts, got["hit"].payload) == (True, 0, "1") and got["none"].reason == "provider_error"
    kept = calls.to_cache(calls.called(requests, cache, attempts, F.col("payload") == "good")).collect()
    assert all(r.payload == "good" for r in kept) and len(kept) == sum(attempt(r)[1] == "ok" for r in cases.values())


def test_keys_tell_requests_apart(spark):
    rows = spark.createDataFrame([("r", "s", None), ("r", "s", "n1"), ("r", "t", None)], "role string, system string, nonce string")
    keys = [r.cache_key for r in calls.keyed(rows).collect()]
    assert len(set(keys)) == 3 and keys == [r.cache_key for r in calls.keyed(rows).collect()]


def test_last_entry_and_second_asking(spark):
    key = ["p"]
    claims = spark.createDataFrame([("p", f"c{i}", "interests") for i in range(6)] + [("p", "c9", "age")], "p string, claim_id string, field string")
    facts = spark.createDataFrame([("p", "f1", "interests"), ("p", "f2", "location")], "p string, fact_id string, field string")
    turns = spark.createDataFrame([("p", "t1", "interviewer", "jazz"), ("p", "t2", "user", "I like jazz a lot")], "p string, turn_id string, speaker string, text string")
    schema = "p string, claim_id string, entry_ord int, matched_fact_id string, span_turn_id string, span_text string, specificity string"
    entries = spark.createDataFrame([
        ("p", "c0", 1, "f1", "t2", "jazz", None), ("p", "c0", 2, None, None, None, None), ("p", "c1", 2, "f1", "t2", "jazz", None), ("p", "c1", 1, None, None, None, None),
        ("p", "c2", 1, "f2", "t2", "like Jazz", None), ("p", "c3", 1, "f1", "t1", "jazz", None), ("p", "c4", 1, "f1", "t2", "rock", None),
    ], schema)
    again = spark.createDataFrame([("p", "c3", 1, "f1", "t2", "jazz", None), ("p", "c1", 1, None, None, None, None)], schema)
    first = judging.judged(claims, entries, facts, turns, key)
    assert {r.claim_id: r.verdict for r in first.collect()} == {"c0": "unsupported", "c1": "supported", "c2": "supported_offsheet", "c3": "span_invalid", "c4": "span_invalid", "c5": "judge_error"}
    rows = {r.claim_id: r for r in judging.retried(first, again, facts, turns, key).collect()}
    assert rows["c3"].verdict == "supported" and rows["c3"].first_pass and rows["c4"].verdict == "span_invalid" and rows["c1"].verdict == "supported" and rows["c2"].bad_references == 1
    h = judging.health(judging.retried(first, again, facts, turns, key), key).first()
    assert (h.calls, h.judged_claims, h.errors, h.span_invalid, h.span_invalid_first_pass) == (2, 6, 1, 1, 2)


def test_first_claim_and_first_turn_win(spark):
    facts = spark.createDataFrame([("p", "f1"), ("p", "f2")], "p string, fact_id string")
    aligned = spark.createDataFrame([("p", "c1", "judge", "supported", "f1"), ("p", "c2", "exact", "supported", "f1"), ("p", "c3", "judge", "unsupported", None)], "p string, claim_id string, method string, verdict string, matched_fact_id string")
    turns = spark.createDataFrame([("p", 1, "t1", "interviewer", "q", False, ["f1"]), ("p", 2, "t2", "user", "q", True, ["f1"]), ("p", 3, "t3", "user", "r", False, ["f1"])], "p string, turn_ord int, turn_id string, speaker string, question_id string, is_followup boolean, disclosed_fact_ids array<string>")
    r = {x.fact_id: x for x in coverage.coverage(facts, aligned, turns, ["p"]).collect()}
    assert (r["f1"].by_claim_id, r["f1"].disclosed_turn_id, r["f1"].via_followup) == ("c2", "t2", True) and not r["f2"].captured and r["f2"].disclosed_turn_id is None
    dangling = coverage.coverage(facts, aligned, turns, ["p"]).withColumn("by_claim_id", F.when(F.col("captured"), "c7"))
    assert {x.fact_id: (x.counts, x.problem) for x in coverage.rechecked(dangling, aligned, ["p"]).collect()} == {"f1": (False, "no_alignment"), "f2": (False, None)}


def test_generation(spark):
    rows = [("a", 1, "ok", True), ("b", 1, "ok", False), ("b", 2, "ok", True), ("c", 1, "ok", False), ("c", 2, "ok", False), ("d", 1, "refusal", False), ("d", 2, "ok", True), ("e", 1, "ok", False), ("e", 2, "provider_error", False)]
    found = personas.generated(spark.createDataFrame(rows, "persona_id string, attempt int, status string, fits boolean"))
    assert {r.persona_id: r.status for r in found.collect()} == {"a": "ok", "b": "ok", "c": "schema_invalid", "d": "refusal", "e": "provider_error"}
    assert [r.persona_id for r in personas.failures(found, "gen").collect()] == ["c", "d", "e"]
    with pytest.raises(KeyError):
        personas.fill("{a} {b}", {"a": F.lit(1)})


def test_classes_are_dealt_evenly_and_apart(spark):
    rows = personas.skeletons(spark.range(1, 121).withColumnRenamed("id", "i")).collect()
    for slot, classes in personas.SLOTS.items():
        sizes = Counter(r[slot] for r in rows)
        assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(classes), slot
    assert len({(r.relationship_goal, r.religion_importance) for r in rows}) > 8 and all(25 <= r.age <= 45 and 12 <= r.n_judged <= 16 for r in rows)
    assert all(r.n_volunteer + r.n_needs_followup + r.n_hedge == r.n_judged for r in rows)
    hot = samplers.balanced(spark.range(1000).withColumn("g", F.lit("one")), "id", 7, "s:", ["g"]).groupBy("class").count().collect()
    assert {r["count"] for r in hot} == {142, 143}


def variants(core):
    low = core.lower()
    fits = [core[:i] + r + core[i + len(p) :] for p, r in CONFUSIONS for i in range(len(low) - len(p) + 1) if low.startswith(p, i)]
    return fits or [core[:-1] if len(core) >= 4 else core]


def test_mishearings(spark):
    assert len(HOMOPHONES) == 138 and all(w not in o for w, o in HOMOPHONES.items())
    tokens = ["Their,", "THEIR!", "(knight)", "think", "phone", "42", "4242", "ééé", "...", "it's", "a"]
    rows = spark.createDataFrame([(t, k / 40) for t in tokens for k in range(40)], "t string, u double")
    token, source = noise.swapped(F.col("t"), F.col("u"))
    found = {}
    for r in rows.select("t", token.alias("o"), source.alias("s")).collect():
        found.setdefault(r.t, set()).add((r.o, r.s))
    assert found["Their,"] == {("There,", "dictionary"), ("They're,", "dictionary")} and ("THEY'RE!", "dictionary") in found["THEIR!"]
    assert found["(knight)"] == {("(night)", "dictionary")} and found["..."] == {("...", "unchanged")} and found["42"] == {("42", "unchanged")} and found["4242"] == {("424", "character")}
    for word in ("think", "phone"):
        assert {o for o, _ in found[word]} == set(variants(word))


def test_noise_of_a_whole_transcript(spark):
    turns = spark.createDataFrame([(1, 1, "interviewer", "Why, oh why?", 3), (1, 2, "user", "Well, yes. I think so, really! And no", 8), (1, 3, "user", "", 0)], "transcript_id long, turn_ord long, speaker string, text string, word_count long")
    assert sorted(noise.noised_turns(turns, 0.0).collect()) == sorted(turns.collect())
    all_hit = {r.turn_ord: r for r in noise.noised_turns(turns, 1.0).collect()}
    assert all_hit[1].text == "Why, oh why?" and all_hit[3].text == "" and all_hit[2].word_count == len(all_hit[2].text.split())
    words = spark.createDataFrame([(1, 1, i, w, "punctuation" if i in (0, 1, 4) else None) for i, w in enumerate("One, two. three four five! six".split())], "transcript_id long, turn_ord long, wi int, word string, operation string").withColumn("fired", F.col("operation").isNotNull())
    pieces = noise.noised_pieces(noise.struck(noise.sentence_index(words))).orderBy("wi").collect()
    assert [p.piece for p in pieces] == ["One", "two", "three", "four", "five", "six"] and [p.changed for p in pieces] == [True, False, False, False, True, False]
    header = spark.createDataFrame([(1, "p1", 0.0)], "transcript_id long, persona_id string, noise_rate double")
    r = noise.noised_headers(header, noise.noised_turns(turns, 0.1), 0.1).first()
    assert (r.transcript_id, r.source_transcript_id, r.noise_seed) == ("1__n010", "1", 7)
    with pytest.raises(Exception, match="already noised"):
        noise.noised_headers(header.withColumn("noise_rate", F.lit(0.1)), turns, 0.1).collect()
    with pytest.raises(ValueError):
        noise.edits(noise.words_of_turns(turns), 1.5)
    log = json.loads(noise.edit_logs(noise.noised_pieces(noise.struck(noise.sentence_index(noise.edits(noise.words_of_turns(turns), 1.0)))), 1.0).first().log)
    assert log["edit_count"] == log["user_words"] == 8 == sum(len(t["edits"]) for t in log["turns"])


def test_aggregate_of_unknown_and_undefined_keys(spark):
    schema = "e string, key string, kind string, num long, den long"
    rows = spark.createDataFrame([("a", "precision", "rate", 0, 1), ("b", "precision", "rate", 9, 9), ("a", "claims_deduped", "count", 2, 0), ("a", "recall_exact_by_field.age", "rate", 3, 4)], schema)
    floors = spark.createDataFrame([("exact_floor.age", "rate", 2, 4)], "key string, kind string, num long, den long")
    expected = spark.createDataFrame([("recall",)], "key string")
    made = scores.aggregate(rows, expected, floors)
    r = {x.key: x for x in made.collect()}
    assert r["precision"].value == 0.9 and r["recall"].value is None and r["recall"].n == 0 and r["claims_deduped"].value == 2 and r["claims_deduped"].n is None and r["claims_deduped"].lo is None
    assert scores.lifts(made).first().lift == 0.25
    for bad in (("x", "nonsense", "rate", 1, 2), ("x", "precision", "count", 1, 0)):
        with pytest.raises(Exception, match="not a metric"):
            scores.aggregate(rows.unionByName(spark.createDataFrame([bad], schema)), expected, floors).collect()
    vectors = scores.per_persona(rows, ["e"], scores.key_union(rows, expected, floors)).collect()
    assert len(vectors) == 2 * 5 and {(v.e, v.metric): v.value for v in vectors}[("b", "claims_deduped")] is None
    files = {x.e: x for x in scores.scores(rows, ["e"]).collect()}
    assert files["a"].metrics == {"claims_deduped": 2.0, "precision": 0.0, "recall_exact_by_field.age": 0.75} and files["a"].n == {"precision": 1, "recall_exact_by_field.age": 4}


def test_audits_need_clean_transcripts(spark):
    rows = spark.createDataFrame([("a", "p", 0.0, None), ("b", "p", 0.1, "a"), ("c", "q", 0.1, "a"), ("d", "p", 0.1, None), ("e", "p", 0.1, "b")], "transcript_id string, persona_id string, noise_rate double, source_transcript_id string")
    assert {r.transcript_id: r.problem for r in transcripts.source_problems(rows, rows).collect()} == {"c": "source_of_another_persona", "d": "no_source", "e": "source_is_noised"}
    assert {r.transcript_id for r in transcripts.unclean(rows).collect()} == {"b", "c", "d", "e"}


def test_good_rows_break_no_rule(spark):
    rows = spark.createDataFrame([("exact", "supported", "f1", None, None), ("judge", "supported", "f1", "t1", "x"), ("judge", "supported_offsheet", None, "t1", "x"), ("judge", "judge_error", None, None, None)], "method string, verdict string, matched_fact_id string, span_turn_id string, span_text string")
    assert not any(r.n for r in integrity.violations(rows, integrity.alignment_rules()).collect())


def test_gate_tells_why(spark):
    side = lambda rows: spark.createDataFrame(rows, "key string, value double")
    base, floors = side([(k, 0.9) for k in C.GATED_KEYS]), spark.createDataFrame([(k, 0.005) for k in C.GATED_KEYS[1:]], "key string, floor double")
    assert gate.invalid_reason(gate.diff(base, side([]), floors)) == "candidate has no metrics"
    assert "unknown metric keys" in gate.invalid_reason(gate.diff(base, side([("nonsense", 1.0)]), floors))
    assert gate.invalid_reason(gate.diff(base, base, floors)) == f"gated metric {C.GATED_KEYS[0]} has no measured floor"
    assert gate.invalid_reason(gate.diff(base, base, floors, gated=False), gated=False) is None


def test_report_sections(spark, tmp_path):
    rows = spark.createDataFrame([("precision", 0.5, 8, 0.2, 0.8, 0.005), ("recall", None, 0, None, None, None), ("yield.q01", 1234.0, None, None, None, None), ("stability_extraction", 0.25, 4, 0.1, 0.6, None)], "key string, value double, den long, lo double, hi double, floor double")
    curve = [{"noise_rate": 0.1, "metrics": {"precision": 0.4}}, {"noise_rate": 0.0, "metrics": {}}]
    made = report.context(rows, {"judged_claims": 100, "errors": 4, "span_invalid": 2}, {"tag": "v1", "excluded": {"refusal": 2}}, curve, [{"field": "age"}, "no dict"])
    text, page = report.markdown(made), report.page(made)
    assert "±0.50 pp" in text and "DEGRADED" in text and "excluded: 2 (2 refusal)" in text and "## Other" in text and "| 0% | n/a |" in text and "1,234" in text and "- field: age" in text
    assert "<svg" in page and "<script" not in page and "http" not in page
    report.write(made, f"{tmp_path}/out")
    assert (tmp_path / "out/index.html").exists() and (tmp_path / "out/summary.md").exists()
    assert report.judge_lines({"judged_claims": 0})[0].endswith("nothing was judged")
    assert [r["key"] for r in report.in_order([{"key": k} for k in "zbxa"], ("x", "b"))] == ["x", "b", "a", "z"]


def test_settings_and_files(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("script_id: s\nquestions:\n- {question_id: q1, text: Why, targets: [age]}\n")
    about, questions = artifacts.load_script(spark, f"{tmp_path}/s.yaml")
    assert about["followup_trigger_words"] == 40 and questions.first().max_followups == 1
    (tmp_path / "bad.json").write_text('{"questions": [{"question_id": "q", "text": "x", "targets": ["hobby"]}]}')
    with pytest.raises(ValueError, match="hobby"):
        artifacts.load_script(spark, f"{tmp_path}/bad.json")
    (tmp_path / "p.json").write_text('{"properties": {"age": {"type": "integer"}, "values": {"type": "array"}}, "required": ["values"]}')
    assert artifacts.profile_schema(f"{tmp_path}/p.json").fieldNames() == ["age", "values"]
    (tmp_path / "q.json").write_text('{"properties": {}, "required": ["age"]}')
    with pytest.raises(ValueError, match="age"):
        artifacts.profile_schema(f"{tmp_path}/q.json")
    artifacts.save_json(f"{tmp_path}/deep/a.json", {"metrics": {"precision": 0.5, "recall": None}, "n": {"precision": 4, "recall": 0}, "ci": {"precision": [0.1, 0.9]}, "floor": {"precision": 0.01}})
    got = {r.key: r for r in artifacts.load_aggregate(spark, f"{tmp_path}/deep/a.json").collect()}
    assert got["precision"].lo == 0.1 and got["recall"].value is None and got["recall"].den == 0
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "name string, x int")
    artifacts.write_json(rows, f"{tmp_path}/objects", "things", "name")
    assert spark.read.json(f"{tmp_path}/objects/things/_name=a").first().x == 1
    labels = spark.createDataFrame([("c1", " Agree"), ("c2", "disagree"), ("c3", "?")], "claim_id string, label string")
    assert [r.agrees for r in artifacts.audit_labels(labels).collect()] == [True, False, None]
    assert artifacts.canonical_json({"b": "é", "a": [1]}) == '{"a":[1],"b":"é"}' and artifacts.code_version("/nowhere") == "dev"


def test_json_kinds(spark):
    rows = spark.createDataFrame([('{"k": 1}',), ('{"k": "1"}',), ('{"k": true}',), ('{"k": [1]}',), ("{}",), ('{"k": 1.5}',), ('{"k": null}',)], "p string")
    assert [r.k for r in rows.select(T.json_kind(F.parse_json("p"), "$.k").alias("k")).collect()] == ["integer", "string", "boolean", "array", "missing", "other", "missing"]
