"""Run folders, JSON artifacts, caches and configuration."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmill.functions import constants as C

VALUE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("s", T.StringType())])
FACTS = T.StructType([T.StructField(n, t) for n, t in (("persona_id", T.StringType()), ("fact_id", T.StringType()), ("field", T.StringType()), ("value", VALUE), ("specificity", T.StringType()), ("disclosure", T.StringType()), ("importance", T.StringType()), ("decoy_value", T.StringType()))])
TURNS = T.StructType([T.StructField(n, t) for n, t in (("transcript_id", T.StringType()), ("turn_ord", T.IntegerType()), ("turn_id", T.StringType()), ("speaker", T.StringType()), ("question_id", T.StringType()), ("is_followup", T.BooleanType()), ("text", T.StringType()), ("word_count", T.LongType()), ("disclosed_fact_ids", T.ArrayType(T.StringType())))])
ALIGNMENTS = T.StructType([T.StructField(n, t) for n, t in (("extraction_id", T.StringType()), ("claim_id", T.StringType()), ("field", T.StringType()), ("value", VALUE), ("method", T.StringType()), ("verdict", T.StringType()), ("matched_fact_id", T.StringType()), ("span_turn_id", T.StringType()), ("span_text", T.StringType()))])


def read_json(spark: SparkSession, path: str, schema: T.StructType, per_file: bool = True) -> DataFrame:
    """Artifacts of a fixed schema; one that does not fit stops the read."""
    return spark.read.schema(schema).option("multiLine", per_file).option("mode", "FAILFAST").json(path)


def write_json(df: DataFrame, root: str, name: str, id_col: str) -> None:
    """One file an object: ``{root}/{name}/{id_col}=...``; readers of one id read its folder alone."""
    df.withColumn(f"_{id_col}", F.col(id_col)).write.mode("overwrite").partitionBy(f"_{id_col}").json(f"{root}/{name}")


def save_json(path: str, payload) -> None:
    """A small summary, indented and with sorted keys; folders are made."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload, indent=2, sort_keys=True, default=str) + "\n")


def read_settings(path: str) -> dict:
    """A JSON or, by its ending, YAML file."""
    text = Path(path).read_text()
    if not path.endswith((".yaml", ".yml")):
        return json.loads(text)
    try:
        import yaml
    except ImportError:
        raise ValueError(f"{path}: PyYAML is not installed; give JSON") from None
    return yaml.safe_load(text)


def load_script(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """A question script's settings and its questions in order (place, question_id, text, targets, max_followups); unknown targets and repeated ids are refused."""
    given = read_settings(path)
    questions = given.get("questions", [])
    ids = [q["question_id"] for q in questions]
    if len(set(ids)) < len(ids):
        raise ValueError(f"{path}: question ids repeat")
    if unknown := sorted({t for q in questions for t in q["targets"]} - set(C.ALL_FIELDS)):
        raise ValueError(f"{path}: unknown targets {unknown}")
    rows = [(i, q["question_id"], q["text"], q["targets"], q.get("max_followups", 1)) for i, q in enumerate(questions)]
    about = {"followup_trigger_words": C.FOLLOWUP_TRIGGER_WORDS, "order_seed": None} | {k: v for k, v in given.items() if k != "questions"}
    return about, spark.createDataFrame(rows, "place int, question_id string, text string, targets array<string>, max_followups int")


def profile_schema(path: str) -> T.StructType:
    """The columns of a profile's JSON Schema; one that requires more than arrays or the summary is refused, as it would fail every incomplete profile."""
    given = read_settings(path)
    if over := sorted(set(given.get("required", [])) - set(C.ARRAY_FIELDS) - set(C.UNSCORED_FIELDS)):
        raise ValueError(f"{path}: required fields {over}")
    kinds = {"integer": T.LongType(), "boolean": T.BooleanType(), "array": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(n, kinds.get(p.get("type"), T.StringType())) for n, p in given["properties"].items()])


def load_aggregate(spark: SparkSession, path: str) -> DataFrame:
    """(key, value, den, lo, hi, floor) of an aggregate: a table, or a JSON file with metrics, n, ci and floor by key."""
    if not path.endswith(".json"):
        return spark.read.parquet(path)
    given = json.loads(Path(path).read_text())
    metrics, n, ci, floor = (given.get(k) or {} for k in ("metrics", "n", "ci", "floor"))
    number = lambda x: None if x is None or isinstance(x, bool | str) else float(x)
    rows = [(k, number(metrics.get(k)), n.get(k), *map(number, ci.get(k) or (None, None)), number(floor.get(k))) for k in sorted({*metrics, *n})]
    return spark.createDataFrame(rows, "key string, value double, den long, lo double, hi double, floor double")


def write_edit_logs(logs: DataFrame, root: str) -> None:
    """Edit logs beside the transcripts, one a transcript."""
    write_json(logs, root, "edits", "transcript_id")


def audit_labels(labels: DataFrame) -> DataFrame:
    """(claim_id, agrees) of labels in either spelling: ``agrees``, or ``label`` with the words agree and disagree."""
    if "agrees" in labels.columns:
        return labels.select("claim_id", F.col("agrees").cast("boolean").alias("agrees"))
    word = F.lower(F.trim("label"))
    return labels.select("claim_id", F.when(word == "agree", True).when(word == "disagree", False).alias("agrees"))


def code_version(root: str = ".") -> str:
    """The commit of a work tree, with -dirty if files have changed; dev without one."""
    import subprocess

    def git(*args: str) -> str:
        try:
            return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=5, check=True).stdout.strip()
        except (subprocess.SubprocessError, OSError):
            return ""

    commit = git("rev-parse", "--short", "HEAD")
    return (commit + "-dirty" * bool(git("status", "--porcelain"))) if commit else "dev"


def canonical_json(value) -> str:
    """JSON that is equal for equal values: sorted keys, no blanks, letters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def write_table(df: DataFrame, root: str, name: str, by: tuple[str, ...] = ("run_id", "tag"), fmt: str = "parquet") -> None:
    """Append to a run table; readers that name a tag read its folder alone."""
    df.write.mode("append").partitionBy(*[c for c in by if c in df.columns]).format(fmt).save(f"{root}/{name}")


def latest_run(runs: DataFrame) -> str | None:
    return runs.agg(F.max("run_id")).first()[0]


def append_failures(failures: DataFrame, root: str) -> None:
    failures.write.mode("append").json(f"{root}/failures")


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with their cached payload, null for a miss; a payload that is no JSON is a miss."""
    good = cache.where(F.try_parse_json("payload").isNotNull())
    first = Window.partitionBy("cache_key").orderBy("payload")
    return requests.join(good.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth"), "cache_key", "left")


def cache_key(*parts: str) -> F.Column:
    return F.sha2(F.to_json(F.struct(*sorted(parts))).cast("binary"), 256)


def cacheable(completions: DataFrame) -> DataFrame:
    """Only answers are kept; errors are asked for again."""
    return completions.where("status = 'ok'").dropDuplicates(["cache_key"])


def first_nonempty(*tables: DataFrame) -> DataFrame:
    """The first table that has rows, else the last."""
    return next((t for t in tables[:-1] if not t.isEmpty()), tables[-1])


@dataclass(frozen=True)
class Config:
    """A run's settings; unknown keys are refused."""

    run_name: str = "run"
    personas: int = 3
    seed: int = 7
    noise_rates: tuple[float, ...] = (0.0,)
    floor_runs: int = 5
    roles: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Config:
        return cls.parse(read_settings(path))

    @classmethod
    def parse(cls, given: dict) -> Config:
        if unknown := sorted(set(given) - {f.name for f in fields(cls)}):
            raise ValueError(f"unknown settings: {unknown}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def replace_block(text: str, name: str, body: str) -> str:
    """``text`` with what stands between the two markers of ``name`` replaced; each must occur exactly once."""
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    if text.count(start) != 1 or text.count(end) != 1 or text.index(start) > text.index(end):
        raise ValueError(f"markers of {name} must occur once each, in order")
    return text[: text.index(start) + len(start)] + "\n" + body + "\n" + text[text.index(end) :]
