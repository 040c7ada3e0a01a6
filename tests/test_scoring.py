"""Golden micro-table of one scored persona, and the laws of tallies."""

import re

import pytest
from pyspark.sql import functions as F

from proofmill.functions import constants as C
from proofmill.functions import text as T
from proofmill.functions.stats import wilson
from proofmill.operators import claims, gate, samplers, tallies, verdicts

ALIGNED = [
    ("occupation", "judge", "supported"), ("interests", "judge", "supported"), ("age", "exact", "supported"), ("relationship_goal", "exact", "supported"),
    ("wants_kids", "exact", "abstained"), ("has_kids", "exact", "unsupported"), ("religion_importance", "exact", "unsupported"), ("location", "judge", "judge_error"),
    ("values", "judge", "span_invalid"), ("interests", "judge", "supported_offsheet"), ("dealbreakers", "judge", "supported"), ("communication_style", "judge", "unsupported"),
]
FACTS = [
    ("age", True, True), ("relationship_goal", True, True), ("wants_kids", False, True), ("has_kids", False, True),
    ("religion_importance", False, False), ("occupation", True, True), ("interests", True, True), ("dealbreakers", True, True),
]


def aligned(spark, more=()):
    return spark.createDataFrame([*ALIGNED, *more], "field string, method string, verdict string")


def as_dict(df):
    return {r.key: (r.num, r.den) for r in df.collect()}


def test_precision_family(spark):
    found = as_dict(tallies.tally(aligned(spark), [], tallies.precision_rates()))
    assert found == {"precision": (6, 9), "hallucination_rate": (3, 9), "abstention_rate": (1, 10), "offsheet_rate": (1, 5), "precision_dealbreakers": (1, 3)}


def test_errors_are_states(spark):
    rates = tallies.precision_rates()
    more = [("values", "judge", "judge_error"), ("location", "judge", "span_invalid")] * 3
    assert as_dict(tallies.tally(aligned(spark, more), [], rates)) == as_dict(tallies.tally(aligned(spark), [], rates))


def test_recall_family(spark):
    rows = spark.createDataFrame(FACTS, "field string, captured boolean, elicited boolean")
    found = as_dict(tallies.tally(rows, [], tallies.recall_rates()))
    assert found == {"recall": (5, 8), "recall_elicited": (5, 7), "recall_exact": (2, 5), "recall_dealbreakers": (1, 4)}


def test_zero_denominator_is_null_and_pooling_adds_counts(spark):
    rows = spark.createDataFrame([("precision", 0, 1), ("precision", 9, 9), ("empty", 0, 0)], "key string, num long, den long")
    found = {r.key: r for r in tallies.valued(tallies.pool(rows)).collect()}
    assert found["precision"].value == pytest.approx(0.9) and found["precision"].n_tallies == 2
    assert found["empty"].value is None and found["empty"].lo is None and found["empty"].den == 0


def test_zero_filled(spark):
    rows = spark.createDataFrame([("age", 1, 2)], "field string, num long, den long")
    found = {r.field: (r.num, r.den) for r in tallies.zero_filled(rows, "field", C.SCORED_FIELDS).collect()}
    assert len(found) == 13 and found["age"] == (1, 2) and found["values"] == (0, 0)


def test_wilson(spark):
    lo, hi = wilson(F.lit(1), F.lit(10))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert r.lo == pytest.approx(0.0179, abs=1e-3) and r.hi == pytest.approx(0.4042, abs=1e-3)


def test_too_many_successes_and_mixed_kinds_are_errors(spark):
    with pytest.raises(Exception, match="successes"):
        spark.range(1).select(*wilson(F.lit(3), F.lit(2))).collect()
    rows = spark.createDataFrame([("precision", "rate", 1, 2), ("precision", "count", 1, 0)], "key string, kind string, num long, den long")
    with pytest.raises(Exception, match="different kinds"):
        tallies.pool(rows).collect()
    assert tallies.pool(rows.where("kind = 'rate'")).first().num == 1


def test_intervals_are_for_rates_alone(spark):
    rows = spark.createDataFrame([("precision", 1, 2), ("claims_deduped", 3, 0), ("yield_per_minute.q01", 300, 20)], "key string, num long, den long")
    r = {x.key: x for x in tallies.valued(rows).collect()}
    assert r["precision"].lo is not None and r["claims_deduped"].lo is None and r["yield_per_minute.q01"].lo is None
    assert r["claims_deduped"].value == 3 and r["yield_per_minute.q01"].value == 15


def test_requested_floors(spark):
    rows = spark.createDataFrame([("p", 0.8), ("p", 0.9)], "key string, value double")
    asked = spark.createDataFrame([("p",), ("q",)], "key string")
    found = {r.key: r for r in tallies.variance_floor(rows, ["key"], requested=asked).collect()}
    assert (found["q"].runs, found["q"].floor, found["q"].baseline_mean) == (0, 0.005, None)


BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2003\u2028\u2029\u202f\u205f\u3000"


def test_white_space_is_all_of_unicode(spark):
    texts = ["a\xa0b", "\u3000a\u2003b\x1cc ", BLANK, "a\u200bb", "", *[f"a{c}b" for c in BLANK]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r for r in rows.select("i", T.word_count(F.col("t")).alias("n"), T.collapse(F.col("t")).alias("c"), T.is_blank(F.col("t")).alias("b"), T.span_normalize(F.col("t")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n, got[i].c, got[i].b) == (len(t.split()), " ".join(t.split()), not t.strip())
        assert got[i].s == " ".join("".join(c if c.isalnum() or c == "_" else " " for c in t).split())
    match = T.values_match(F.lit("str"), F.lit("a\xa0b"), F.lit("str"), F.lit(" A  B"))
    assert rows.select(match.alias("m")).first().m


def test_case_folding(spark):
    texts = ["Stra\u00dfe", "\ufb01n", "\u0130I\u0131", "\u03a3\u03a3 \u03c3\u03c2", "\u017f \u00b5 \u0149", "\u212a"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.fold(F.col("t")).alias("f")).collect()
    assert [r.f for r in rows] == [t.casefold() for t in texts]


def test_numbers_are_shown_as_they_are(spark):
    values = [2.675, 0.0625, 1.005, 0.5, 1.5, 2.5, 1234567.5, -0.125, -0.0, 0.0, 1e-9, 99.995, 0.00005, 12.34565, 7.0, 1 / 3, 0.145, 1e6 + 0.125]
    shown = {"rate": lambda v: f"{v * 100:.1f}%", "count": lambda v: f"{v:,.0f}", "ratio": lambda v: f"{v:.2f}", "other": lambda v: f"{v:.4f}"}
    rows = spark.createDataFrame([(i, k, v) for i, v in enumerate(values) for k in shown], "i int, k string, v double")
    for r in rows.select("i", "k", T.format_value(F.col("v"), F.col("k")).alias("s")).collect():
        assert r.s == shown[r.k](values[r.i]), (values[r.i], r.k)


def test_strings_of_ids_and_params(spark):
    r = spark.range(1).select(
        T.extraction_id(F.lit("p001__s1__n000"), F.lit("v1")).alias("e"), T.floor_tag(F.lit("v1"), F.lit(2)).alias("t"),
        T.run_id(F.lit("2026-01-02 03:04:59").cast("timestamp"), F.lit("{}")).alias("r"), T.role_in(T.with_role(F.lit("aligner"), F.lit("text [lab-role:x]"))).alias("role"), T.role_in(F.lit("text")).alias("none"),
        T.flat_params(F.create_map(*map(F.lit, ("seed", "7", "nonce", "x", "effort", "low")))).alias("p"), T.status_in(F.lit("model stopped: max_tokens")).alias("s"), T.status_in(F.lit(None).cast("string")).alias("s0"),
    ).first()
    assert (r.e, r.t, r.role, r.none, r.p, r.s, r.s0) == ("p001__s1__n000:v1", "v1.floor2", "aligner", None, "effort=low, seed=7", "truncated", "provider_error")
    assert re.fullmatch(r"20260102-0304-[0-9a-f]{6}", r.r)


def test_unmatched_claims_are_told(spark):
    facts = spark.createDataFrame([("p", "f1", "age", "int", "35")], "persona_id string, fact_id string, field string, kind string, value string")
    mine = spark.createDataFrame([("p", "c1", "age", "int", "35"), ("p", "c2", "has_kids", "bool", "true"), ("p", "c3", "location", "str", "x")], "persona_id string, claim_id string, field string, kind string, value string")
    got = {r.claim_id: (r.verdict, r.matched_fact_id, r.problem) for r in verdicts.exact_alignments(mine, facts, ["persona_id"]).collect()}
    assert got == {"c1": ("supported", "f1", None), "c2": (None, None, "no_truth")}


def test_variance_floor(spark):
    rows = spark.createDataFrame([("p", 0.8), ("p", None), ("p", 0.9), ("one", 0.5)], "key string, value double")
    found = {r.key: r for r in tallies.variance_floor(rows, ["key"]).collect()}
    assert found["p"].runs == 2 and found["p"].sigma == pytest.approx(0.0707106781) and found["p"].floor == pytest.approx(2 * 0.0707106781)
    assert found["one"].sigma is None and found["one"].floor == 0.005


def test_jaccard(spark):
    rows = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, "b"), (2, "a"), (2, "c")], "run int, item string")
    r = tallies.pairwise_jaccard(rows, runs=3).first()
    assert (r.num, r.den) == (4, 8)
    rows = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a")], "run int, item string")  # the third run found nothing
    r = tallies.pairwise_jaccard(rows, runs=3).first()
    assert (r.num, r.den) == (1, 5)


@pytest.mark.parametrize("candidate, code", [(0.70, 1), (0.90, 0), (None, 2)])
def test_gate(spark, candidate, code):
    base = spark.createDataFrame([(k, 0.9) for k in C.GATED_KEYS], "key string, value double")
    new = spark.createDataFrame([(k, candidate) for k in C.GATED_KEYS] if candidate else [], "key string, value double")
    floors = spark.createDataFrame([(k, 0.005) for k in C.GATED_KEYS], "key string, floor double")
    assert gate.exit_code(gate.diff(base, new, floors)) == code


def test_unknown_key_is_invalid(spark):
    base = spark.createDataFrame([(k, 0.9) for k in (*C.GATED_KEYS, "nonsense")], "key string, value double")
    floors = spark.createDataFrame([(k, 0.005) for k in C.GATED_KEYS], "key string, floor double")
    assert gate.exit_code(gate.diff(base, base, floors)) == 2


def test_exact_verdicts_keep_types(spark):
    rows = spark.createDataFrame([
        ("age", "str", "35", "int", "35", "unsupported"), ("has_kids", "int", "1", "bool", "true", "unsupported"), ("wants_kids", "str", " YES", "str", "yes", "supported"),
        ("wants_kids", "str", "unsure", "str", "yes", "abstained"), ("wants_kids", "str", "unsure", "str", "unsure", "supported"), ("age", "str", "unsure", "int", "35", "unsupported"),
    ], "field string, ck string, c string, tk string, t string, want string")
    got = rows.select("want", verdicts.exact_verdict(*map(F.col, ("field", "ck", "c", "tk", "t"))).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_text_functions(spark):
    one = spark.range(1)
    r = one.select(
        T.span_normalize(F.lit("  Hospital, Systems!  Administrator.  ")).alias("n"), T.word_count(F.lit("")).alias("w0"), T.word_count(F.lit(None).cast("string")).alias("w1"),
        T.anchor_tokens(F.lit("a summer in Rio")).alias("a"), T.anchor_tokens(F.lit("a lot of time")).alias("b"), T.strip_punctuation(F.lit("...")).alias("p"),
        T.split_token(F.lit('"there."')).alias("s"), T.split_token(F.lit("it's")).alias("t"), T.match_case(F.lit("ABC"), F.lit("xy")).alias("u"), T.noise_token(F.lit(0.1)).alias("z"),
        T.format_value(F.lit(0.0625), F.lit("rate")).alias("f"), T.status_of(F.lit("max_tokens")).alias("st"), T.status_of(F.lit("?")).alias("st2"),
    ).first()
    assert r.n == "hospital systems administrator" and r.w0 == 0 and r.w1 == 0
    assert "rio" in r.a and r.b == [] and r.p == "..."
    assert tuple(r.s) == ('"', "there", '."') and tuple(r.t) == ("", "it's", "") and r.u == "XY" and r.z == "n010"
    assert r.f == "6.2%" and r.st == "truncated" and r.st2 == "provider_error"


def test_span_reasons_in_order(spark):
    rows = spark.createDataFrame([
        (None, "x", "user", "x", "none_cited"), (1, " .. ", "user", "x", "empty"), (1, "a " * 13, "user", "a " * 20, "too_long"), (1, "x", None, None, "no_such_turn"),
        (1, "x", "interviewer", "x", "not_user"), (1, "y", "user", "x", "not_verbatim"), (1, "The, Cat", "user", "see the cat!", "ok"),
    ], "turn int, span string, speaker string, text string, want string")
    got = rows.select("want", verdicts.span_reason(*map(F.col, ("turn", "span", "speaker", "text"))).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_unpivot(spark):
    df = spark.createDataFrame([("e1", 34, " ", True, ["jazz", " Jazz ", "", None, "golf"], "text")], "extraction_id string, age int, wants_kids string, has_kids boolean, interests array<string>, summary string")
    got = [(r.claim_id, r.field, r.kind, r.value) for r in claims.unpivot(df).orderBy("claim_ord").collect()]
    assert got == [("c01", "age", "int", "34"), ("c02", "has_kids", "bool", "true"), ("c03", "interests", "str", "jazz"), ("c04", "interests", "str", "golf")]


def test_split_counts(spark):
    rows = spark.createDataFrame([(13,), (0,), (1,)], "total long")
    got = {}
    for r in samplers.split_counts(rows, C.DISCLOSURE_MIX).collect():
        got.setdefault(r.total, {})[r.name] = r.part
    assert all(sum(v.values()) == k for k, v in got.items()) and got[13] == {"volunteer": 8, "needs_followup": 4, "hedge": 1}
