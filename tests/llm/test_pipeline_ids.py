"""The pipeline's filters on null and repeated ids, empty tables and clashing columns."""

import pytest

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, source string, lang string, text string, n_chars long, _text_key string"
COPY = " ".join(f"copy{i}" for i in range(60))
OTHER = " ".join(f"other{i}" for i in range(60))
ALONE = " ".join(f"alone{i}" for i in range(60))
LEAK = " ".join(f"leak{i}" for i in range(14))


def frame(spark, rows):
    return spark.createDataFrame([(i, "web", "en", t, len(t or ""), "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("bench"))
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def pairs(made):
    return sorted(((r.doc_id, r.text) for r in made.collect()), key=repr)


def test_near_copies_without_ids(spark, folder):
    rows = [(None, COPY), (5, COPY), (None, COPY + " end"), (7, OTHER), (7, OTHER), (7, ALONE), (8, OTHER), (None, LEAK), (None, LEAK), (9, None), (9, None), (None, "")]
    made = pipeline.drop_near_copies(spark, frame(spark, rows), folder)
    assert made.columns == frame(spark, []).columns
    assert pairs(made) == sorted([(5, COPY), (7, OTHER), (7, ALONE), (None, LEAK), (9, None), (9, None), (None, "")], key=repr)


def test_benchmark_text_without_ids(spark, folder):
    rows = [(None, "a " + LEAK), (None, ALONE), (3, LEAK), (3, OTHER), (4, None), (5, "")]
    made = pipeline.drop_benchmark_text(spark, frame(spark, rows), folder)
    assert made.columns == frame(spark, []).columns
    assert pairs(made) == sorted([(None, ALONE), (3, OTHER), (4, None), (5, "")], key=repr)


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES[:-1]])
def test_empty(spark, folder, stage):
    made = stage(spark, frame(spark, []), folder)
    assert made.count() == 0 and made.columns == frame(spark, []).columns
