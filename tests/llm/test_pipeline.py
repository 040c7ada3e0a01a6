"""The pipeline's stages, each against a plain version on its own input."""

import re

import pytest

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input rows, output rows) of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        before, columns = docs.collect(), docs.columns
        at = f"{tmp_path_factory.mktemp('stage')}/out"
        stage(spark, docs, SF).write.parquet(at)
        docs = spark.read.parquet(at)
        out[name] = (before, docs.collect(), columns, docs.columns)
    return out


def test_order_and_columns(stages):
    assert list(stages) == ["language ID", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    for _, (_, _, columns, made) in list(stages.items())[:-1]:
        assert made == columns


def test_language_keeps_whole_texts(stages):
    before, after, *_ = stages["language ID"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert all(len(r.text) < 60 for r in before if r.doc_id in gone) and set(after) <= set(before)


def test_near_copies(stages):
    before, after, *_ = stages["MinHash near-dedup"]
    sets = {}
    for r in before:
        w = r.text.encode().lower().split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in sets:
        for y in sets:
            both = len(sets[x] & sets[y]) if x < y else 0
            if both and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    assert {r.doc_id for r in after} == {i for i in sets if find(i) == i}


def test_benchmark_text(spark, stages):
    before, after, *_ = stages["benchmark decontamination"]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    runs = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = split(r.text)
        runs |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    hit = {r.doc_id for r in before if any(tuple(w[i : i + 10]) in runs for w in [split(r.text)] for i in range(len(w) - 9))}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - hit


def test_mix_and_files(stages):
    before, after, *_ = stages["mixing sources to target weights"]
    assert set(after) <= set(before) and len(after) > 0
    tokens = stages["token-ID / binary output"][1]
    assert sorted(r.doc_id for r in tokens) == sorted(r.doc_id for r in after)
    at = 0
    for r in sorted(tokens, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_run(spark, stages):
    assert sorted(pipeline.run(spark, SF).collect()) == sorted(stages["token-ID / binary output"][1])
