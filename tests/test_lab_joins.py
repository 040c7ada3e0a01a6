"""The tables of the whole evaluation grow with the customers, so none may be gathered on the driver to be broadcast."""

import re

import pytest

import __spark_entry__
from proofmill.sources import lab as L
from proofmill.sources import shared

SF = "/root/testdata/sf0.001"
#: Keys of joins with a table of bounded size: the metrics of an aggregate.
BOUNDED = {"key"}


def sent(df):
    """The keys of the broadcast joins that ``df`` is planned with."""
    found = re.findall(r"Broadcast(?:Hash|NestedLoop)Join (?:\[([^\]]*)\])?", df._jdf.queryExecution().executedPlan().toString())
    return {re.sub(r"#\d+L?", "", keys) for keys in found} - BOUNDED


@pytest.fixture(scope="module")
def written():
    """Broadcast joins of each table that the lab writes on the way to the query."""
    found, whole = {}, shared.stored

    def stored(df, tag):
        found[tag] = sent(df)
        return whole(df, tag)

    kept = dict(L._LABS)
    L._LABS.clear()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(L, "stored", stored)
        yield found
    L._LABS.clear()
    L._LABS.update(kept)


NAMES = [
    "cited_turn_lines",
    "coverage_rules",
    "pooled_health",
    "score_rules",
    "tally_rules",
    "transcript_rules",
    "turn_rules",
    "unknown_facts",
    "interview_results",
    "judge_payloads",
    "lab_aggregate",
    "lab_claims",
    "lab_coverage",
    "lab_tallies",
    "disclosure_audit",
    "alignment_rules",
    "extraction_rules",
    "interview_turns",
    "judge_passes",
    "lab_alignments",
    "lab_lifts",
    "per_persona",
    "metric_suffixes",
    "score_files",
]


@pytest.mark.parametrize("name", NAMES)
def test_no_growing_table_is_broadcast(spark, written, name):
    made = __spark_entry__.queries()[name](spark, SF)
    assert "lab-turns" in written
    assert {tag: keys for tag, keys in {**written, name: sent(made)}.items() if keys} == {}
