"""Texts of no learned language are rejected, short clean ones are not."""

import random
import string

from pyspark.sql import functions as F

from proofmill.llm import language_id


def test_gibberish_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_id.held_out(F.col("doc_id"))
    dictionaries = language_id.fit(docs.where(~held))
    rnd = random.Random(3)
    noise = [" ".join("".join(rnd.choices(string.ascii_lowercase, k=rnd.randint(2, 9))) for _ in range(100)) for _ in range(200)]
    clean = [" ".join(r.text.split()[:20]) for r in docs.where(held & F.col("lang").isNotNull()).select("text").limit(300).collect() if len((r.text or "").split()) >= 20]
    rows = spark.createDataFrame([("noise", t) for t in noise] + [("clean", t) for t in clean], "kind string, text string")
    share = {r.kind: r.share for r in rows.select("kind", language_id.identify(rows, dictionaries).alias("p")).groupBy("kind").agg(F.avg(F.col("p.rejected").cast("int")).alias("share")).collect()}
    assert share["noise"] > 0.8 and share["clean"] < 0.03
