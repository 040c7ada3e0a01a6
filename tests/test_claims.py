"""Claims of whole texts, against brute force."""

import re

import pytest

from proofmill.plans import catalog

LONG = " ".join(f"Word{i % 130} word{i % 7}" for i in range(300)) + " STRASSE straße the\tend The end"
TEXTS = [(0, LONG), (1, "a b c d e f g h i j k l A b last"), (2, ""), (3, None), (4, "one  Two\ntwo ")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("claims"))
    rows = [(i, None if t is None else len(t), "web", t) for i, t in TEXTS]
    spark.createDataFrame(rows, "doc_id long, n_chars long, source string, text string").write.parquet(f"{at}/documents.parquet")
    return at


def same(value):
    return re.sub(r"\s+", " ", value, flags=re.A).strip(" ").lower().replace("ß", "ss")


def words(text):
    return [w for w in re.split(r"\s+", text or "", flags=re.A) if w]


def plain(doc_id, text):
    """(field, kind, value) of a document in order."""
    fields = [("age", "int", [] if text is None else [str(len(text))]), ("wants_kids", "str", [" Yes "] if doc_id % 3 == 0 else []), ("has_kids", "bool", [str(doc_id % 2 == 0).lower()]), ("location", "str", ["web"]), ("interests", "str", words(text))]
    out = []
    for field, kind, values in fields:
        firsts = {}
        for v in values:
            firsts.setdefault(same(v), v)
        out += [(field, kind, v) for v in firsts.values()]
    return out


def test_claims_of_whole_texts(spark, folder):
    want = [(i, *c) for i, t in TEXTS for c in plain(i, t)]
    assert sorted(map(tuple, catalog.QUERIES["claims_unpivot"](spark, folder).collect())) == sorted(want)
    assert (0, "interests", "str", "end") in want and (1, "interests", "str", "last") in want


def test_claim_ids_of_whole_texts(spark, folder):
    want = [(i, k, f"c{k:02d}", c[0]) for i, t in TEXTS for k, c in enumerate(plain(i, t), 1)]
    assert sorted(map(tuple, catalog.QUERIES["claim_ids"](spark, folder).collect())) == sorted(want)
    assert max(w[1] for w in want) > 100 and len({w[::2] for w in want}) == len(want)


def test_repeats_in_whole_texts(spark, folder):
    want = {i: len(words(t)) - len(set(map(same, words(t)))) for i, t in TEXTS if words(t)}
    assert {r.extraction_id: r.claims_deduped for r in catalog.QUERIES["claims_deduped"](spark, folder).collect()} == want
