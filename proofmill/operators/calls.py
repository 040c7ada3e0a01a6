"""Calls to an outside service as tables: canned responses and attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def looked_up(requests: DataFrame, canned: DataFrame) -> DataFrame:
    """Requests (role, key) with the response under their key, else under their role; state tells an error from an answer."""
    exact = canned.withColumnRenamed("response", "_exact")
    by_role = canned.select(F.col("key").alias("_role_key"), F.col("response").alias("_by_role"))
    rows = requests.join(exact, "key", "left").withColumn("_role_key", F.concat(F.lit("role:"), "role")).join(by_role, "_role_key", "left")
    rows = rows.withColumn("response", F.coalesce("_exact", "_by_role"))
    return rows.withColumn("state", F.when(F.col("response").isNull(), "provider_error").otherwise("ok")).drop("_exact", "_by_role", "_role_key")


def resolved(attempts: DataFrame, key: list[str]) -> DataFrame:
    """(key, attempts, status) of the attempt that ends a call: the first that is no provider error, or the last."""
    order = F.struct((F.col("status") == "provider_error").alias("again"), F.when(F.col("status") == "provider_error", -F.col("attempt")).otherwise(F.col("attempt")).alias("at"))
    return attempts.groupBy(*key).agg(F.min_by(F.struct("attempt", "status"), order).alias("won")).select(*key, F.col("won.attempt").alias("attempts"), "won.status")


def keyed(requests: DataFrame, nonce: str | None = None) -> DataFrame:
    """Requests with the key of their answer: all that can change it, and the nonce, which runs of one configuration differ by."""
    parts = ["effort", "json_schema", "max_tokens", "messages", "model", "role", "system", "thinking"]
    extra = F.lit(nonce).cast("string") if nonce is not None or "nonce" not in requests.columns else F.col("nonce")
    whole = F.struct(*[F.coalesce(F.col(p).cast("string"), F.lit("null")).alias(p) if p in requests.columns else F.lit("null").alias(p) for p in parts], F.coalesce(extra, F.lit("null")).alias("nonce"))
    return requests.withColumn("cache_key", F.sha2(F.to_json(whole).cast("binary"), 256))


def called(requests: DataFrame, cache: DataFrame, attempts: DataFrame, schema_ok: Column, most: int = 3) -> DataFrame:
    """Requests (cache_key, ...) with how they ended: status, reason, attempts, cached, payload.

    ``cache``: cache_key, payload, of answers alone; one that is no JSON is a
    miss. ``attempts``: cache_key, attempt, status, reason, payload, as a
    service gave them in turn. Up to ``most`` are made: an error is tried again
    only if it is the provider's own; an answer that breaks the schema
    (``schema_ok`` over its columns) is asked for once more, wherever in the
    turn that falls, and a second one ends the call.
    """
    hits = cache.where(F.try_parse_json("payload").isNotNull()).groupBy("cache_key").agg(F.min("payload").alias("_hit"))
    fine = F.col("status") == "ok"
    broken = fine & ~F.coalesce(schema_ok, F.lit(False))
    tried = attempts.where(F.col("attempt") <= most).withColumn("_broken", broken)
    before = Window.partitionBy("cache_key").orderBy("attempt")
    nth = F.sum(F.col("_broken").cast("int")).over(before)
    last = F.col("attempt") == F.max("attempt").over(Window.partitionBy("cache_key"))
    again = (~fine & (F.coalesce("reason", F.lit("provider_error")) == "provider_error")) | (F.col("_broken") & (nth == 1))
    tried = tried.withColumn("_ends", ~again | last)
    invalid = F.col("_broken")
    ended = tried.where("_ends").groupBy("cache_key").agg(F.min_by(F.struct("attempt", F.when(invalid, "error").otherwise(F.col("status")).alias("status"), F.when(invalid, "schema_invalid").otherwise(F.col("reason")).alias("reason"), "payload"), "attempt").alias("e"))
    rows = requests.join(hits, "cache_key", "left").join(ended, "cache_key", "left")
    hit = F.col("_hit").isNotNull()
    return rows.select(
        *requests.columns, hit.alias("cached"), F.when(hit, 0).otherwise(F.coalesce("e.attempt", F.lit(0))).alias("attempts"),
        F.when(hit, "ok").otherwise(F.coalesce("e.status", F.lit("error"))).alias("status"), F.when(~hit, F.when(F.col("e").isNull(), "provider_error").otherwise(F.col("e.reason"))).alias("reason"),
        F.when(hit, F.col("_hit")).when(F.col("e.status") == "ok", F.col("e.payload")).alias("payload"),
    )


def to_cache(results: DataFrame) -> DataFrame:
    """(cache_key, payload) of fresh answers; errors are never kept."""
    return results.where("status = 'ok' and not cached").groupBy("cache_key").agg(F.min("payload").alias("payload"))


def usage(completions: DataFrame, by: list[str]) -> DataFrame:
    """Token counts added up; a missing count is none."""
    names = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
    return completions.groupBy(*by).agg(*[F.sum(F.coalesce(F.col(n), F.lit(0))).alias(n) for n in names])
