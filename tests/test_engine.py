"""Sources, streaming, report, command line helpers and noise laws."""

import pytest
from pyspark.sql import functions as F

from proofmill.operators import noise, report, tallies
from proofmill.operators.calls import looked_up, resolved
from proofmill.operators.integrity import violations
from proofmill.sources import artifacts
from proofmill.streaming import pool


def test_config_and_markers():
    assert artifacts.Config.parse({"seed": 3, "noise_rates": [0.0, 0.1]}).noise_rates == (0.0, 0.1)
    with pytest.raises(ValueError):
        artifacts.Config.parse({"sede": 3})
    text = "a <!-- n:start -->\nold\n<!-- n:end --> b"
    assert "new" in artifacts.replace_block(text, "n", "new") and "old" not in artifacts.replace_block(text, "n", "new")
    with pytest.raises(ValueError):
        artifacts.replace_block(text, "other", "x")


def test_json_round_trip_and_pruning(spark, tmp_path):
    rows = spark.createDataFrame([("p1", "f1", "age", ("int", "34"), "specific", "volunteer", "core", None)], artifacts.FACTS)
    rows.write.json(f"{tmp_path}/facts")
    assert artifacts.read_json(spark, f"{tmp_path}/facts", artifacts.FACTS, per_file=False).collect() == rows.collect()
    tagged = rows.withColumns({"run_id": F.lit("r1"), "tag": F.lit("t")})
    artifacts.write_table(tagged, str(tmp_path / "run"), "facts")
    assert artifacts.latest_run(spark.read.parquet(f"{tmp_path}/run/facts")) == "r1"


def test_cache(spark):
    cache = spark.createDataFrame([("k1", '{"a": 1}'), ("k1", '{"a": 1}'), ("k2", "{broken")], "cache_key string, payload string")
    got = {r.cache_key: r.payload for r in artifacts.cached(spark.createDataFrame([("k1",), ("k2",), ("k3",)], "cache_key string"), cache).collect()}
    assert got == {"k1": '{"a": 1}', "k2": None, "k3": None}


def test_calls(spark):
    req = spark.createDataFrame([("r", "role:r:1"), ("r", "role:r:2"), ("s", "role:s:1")], "role string, key string")
    canned = spark.createDataFrame([("role:r:1", "one"), ("role:r", "any")], "key string, response string")
    assert {r.key: (r.response, r.state) for r in looked_up(req, canned).collect()} == {"role:r:1": ("one", "ok"), "role:r:2": ("any", "ok"), "role:s:1": (None, "provider_error")}
    tries = spark.createDataFrame([(1, 1, "provider_error"), (1, 2, "refusal"), (1, 3, "ok"), (2, 1, "provider_error"), (2, 2, "provider_error")], "id int, attempt int, status string")
    assert {r.id: (r.attempts, r.status) for r in resolved(tries, ["id"]).collect()} == {1: (2, "refusal"), 2: (2, "provider_error")}


def test_noise_laws(spark):
    def turns(rows):
        return spark.createDataFrame(rows, "transcript_id long, turn_ord long, speaker string, text string")

    one = [(1, 1, "user", "so. " + "word " * 200 + "end!"), (1, 2, "interviewer", "not this")]
    words = noise.words_of_turns(turns(one))
    edited = noise.edits(words, 0.3).collect()
    more = noise.edits(noise.words_of_turns(turns([*one, (1, 3, "user", "another turn")])), 0.3).where("turn_ord = 1").collect()
    assert sorted(edited) == sorted(more)  # another turn moves nothing
    assert not any(r.fired for r in noise.edits(words, 0.0).collect())
    struck = noise.struck(noise.sentence_index(noise.edits(words, 0.9)))
    assert struck.where("changed and operation != 'punctuation'").count() == 0
    assert noise.sentence_index(words).agg(F.max("sentence")).first()[0] == 1


def test_violations(spark):
    rows = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert {r.rule: r.n for r in violations(rows, {"big": F.col("a") > 1, "b": F.col("b") == "x", "none": F.lit(False)}).collect()} == {"big": 1, "b": 1, "none": 0}


def test_stream_pools_like_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([("t", "e1", "precision", 1, 2), ("t", "e2", "precision", 3, 4)], "tag string, extraction_id string, key string, num long, den long").withColumn("scored_at", F.timestamp_seconds(F.lit(0)))
    rows.write.parquet(f"{tmp_path}/in")
    query = pool.pooled(pool.read_tallies(spark, f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("pooled").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    r = spark.table("pooled").first()
    assert (r.num, r.den) == (4, 6)


def test_report(spark):
    rows = spark.createDataFrame([("precision", 6, 9), ("recall_by_field.age", 0, 0)], "key string, num long, den long")
    made = report.rows_of(tallies.valued(rows))
    assert "66.7%" in report.markdown(made) and "n/a" in report.markdown(made)
    assert "<script" not in report.page(made) and "http" not in report.page(made)
