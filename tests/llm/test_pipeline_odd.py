"""All stages on odd rows, and the folders that they leave."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from proofmill.llm import scratch

#: Columns that clash with names the stages use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_language` string, _text_key long, node long, key long, row string, size long"
LONG = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
EN, FR = "the cat sat on the mat and then it went home again " * 4, "le chat est sur la table et il mange du pain avec nous " * 4


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, EN, "en", "a"), (1, EN, "en", "a"), (None, FR, "fr", None), (2, None, None, None), (3, "", "en", "a"), (4, "12 34 !", "fr", "b"), (5, LONG, "en", "b"), (None, None, "en", "a"), (6, FR + "fin", "fr", "b")]
    return spark.createDataFrame([(i, t, lang, s, 0, "x", 1, 2, 3, "r", 4) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("bench"))
    spark.createDataFrame([(1, "le chat est sur la table et il mange du pain avec")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def ids(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_language(spark, odd, folder):
    made = pipeline.identify_language(spark, odd, folder)
    assert made.columns == odd.columns
    got = ids(made)
    assert got[(1, EN)] == 2 and got[(None, FR)] == 1 and not any(t in (None, "", "12 34 !") for _, t in got)


def test_near_copies_and_benchmark(spark, odd, folder):
    made = pipeline.drop_near_copies(spark, odd, folder)
    assert made.columns == odd.columns
    assert ids(made) == Counter([(1, EN), (6, FR + "fin"), (2, None), (3, ""), (4, "12 34 !"), (5, LONG), (None, None)])
    made = pipeline.drop_benchmark_text(spark, odd, folder)
    assert made.columns == odd.columns
    assert ids(made) == Counter([(1, EN), (1, EN), (2, None), (3, ""), (4, "12 34 !"), (5, LONG), (None, None)])


def test_mix_and_tokens(spark, odd, folder):
    made = pipeline.mix_sources(spark, odd, folder)
    assert made.columns == odd.columns and set(ids(made)) <= set(ids(odd)) and made.count() > 0
    tokens = pipeline.write_token_files(spark, odd, folder).collect()
    assert Counter(r.doc_id for r in tokens) == Counter(r.doc_id for r in odd.collect())
    assert [r.n_tokens for r in tokens if r.doc_id in (2, 3)] == [1, 1]
    assert pipeline.write_token_files(spark, odd.where("false"), folder).count() == 0


def test_folders_are_apart(spark):
    """What one session or stage removes is its own alone."""
    kept = scratch.stored(spark.range(3), "kept")
    with scratch.scope(spark) as at:
        inside = scratch.stored(spark.range(5), "inside")
        assert inside.count() == 5 and inside._stored_at.startswith(at + "/") and not kept._stored_at.startswith(at)
        with scratch.scope(spark) as other:
            scratch.stored(spark.range(1), "other")
        assert not os.path.exists(other.removeprefix("file://")) and inside.count() == 5
    assert not os.path.exists(at.removeprefix("file://")) and kept.count() == 3
    scratch.drop(kept)
    assert not os.path.exists(kept._stored_at.removeprefix("file://"))


def test_samples_are_the_values_own(spark):
    df = spark.range(20_000).select(F.col("id"), F.lit("x").alias("t"))
    one, two = (sorted(r.id for r in scratch.sampled(d, 200, "id").collect()) for d in (df, df.repartition(7)))
    assert one == two and 120 < len(one) < 300
    assert scratch.sampled(df, 200, "t").count() <= 1  # one value, however many rows hold it
