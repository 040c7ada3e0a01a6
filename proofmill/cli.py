"""Command line: run, smoke, report, diff and info."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from proofmill.functions import constants as C
from proofmill.operators import gate, judging, report, scores
from proofmill.sources import artifacts
from proofmill.sources.lab import SCRIPT, lab


def run(spark: SparkSession, data: str, root: str, tag: str = "v1", config: artifacts.Config | None = None) -> dict:
    """Evaluate all customers under ``data``: score files, the aggregate with floors, the report and the manifest, in a run folder of its own."""
    config = config or artifacts.Config()
    made = lab(spark, data)
    version = artifacts.canonical_json({"config": config.__dict__, "tag": tag})
    name = spark.range(1).select(F.concat(F.lit(datetime.now(UTC).strftime("%Y%m%d-%H%M-")), F.substring(F.sha2(F.lit(version).cast("binary"), 256), 1, 6))).first()[0]
    tagged = {"run_id": F.lit(name), "tag": F.lit(tag)}
    artifacts.write_table(scores.scores(made.tallies, ["persona_id"]).withColumns(tagged), root, "scores")
    pooled = scores.aggregate(made.tallies, gate.expected_keys(spark, question_ids=tuple(q["question_id"] for q in SCRIPT)), scores.exact_floors(made.facts))
    artifacts.write_table(pooled.withColumns(tagged), root, "aggregates")
    failed = made.played[1].where("status != 'ok'")
    artifacts.append_failures(failed.select(F.lit("sim").alias("stage"), "persona_id", "status"), root)
    manifest = {
        "run_id": name, "tag": tag, "code_version": artifacts.code_version(), "personas": made.sheets.count(),
        "styles": {r["style"]: r["count"] for r in made.sheets.groupBy("style").count().collect()}, "excluded": {r["status"]: r["count"] for r in failed.groupBy("status").count().collect()},
    }
    artifacts.save_json(f"{root}/{name}/manifest.json", manifest)
    stored = spark.read.parquet(f"{root}/aggregates").where((F.col("run_id") == name) & (F.col("tag") == tag)).drop("den").withColumnRenamed("n", "den")
    health = judging.pooled_health(made.health).first().asDict()
    report.write(report.context(stored, health, manifest), f"{root}/{name}/report/{tag}", f"Run {name}")
    return manifest


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="proofmill")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "smoke"):
        one = sub.add_parser(name)
        one.add_argument("--data", required=name == "run", default="/root/testdata/sf0.001")
        one.add_argument("--root", default="runs")
        one.add_argument("--tag", default="v1")
        one.add_argument("--config")
    one = sub.add_parser("report")
    one.add_argument("pooled")
    one.add_argument("--out", default=".")
    two = sub.add_parser("diff")
    two.add_argument("--baseline", required=True)
    two.add_argument("--candidate", required=True)
    two.add_argument("--floors", required=True)
    two.add_argument("--out")
    sub.add_parser("info")
    args = parser.parse_args(argv)
    if args.command == "info":
        print(f"code {artifacts.code_version()}; {len(C.SCORED_FIELDS)} scored fields; gated: {', '.join(C.GATED_KEYS)}")
        return 0
    spark = SparkSession.builder.getOrCreate()
    if args.command in ("run", "smoke"):
        manifest = run(spark, args.data, args.root, args.tag, artifacts.Config.load(args.config) if args.config else None)
        print(artifacts.canonical_json(manifest))
        bad = sum(manifest["excluded"].values())
        return int(args.command == "smoke" and bad > 0.1 * manifest["personas"])
    if args.command == "report":
        report.write(report.context(artifacts.load_aggregate(spark, args.pooled)), args.out)
        return 0
    sides = [artifacts.load_aggregate(spark, p) for p in (args.baseline, args.candidate, args.floors)]
    found = gate.diff(*sides)
    print(report.diff_markdown(found))
    if args.out:
        report.write_diff(found, args.out, Path(args.baseline).stem, Path(args.candidate).stem)
    if reason := gate.invalid_reason(found):
        print(reason, file=sys.stderr)
    return gate.exit_code(found)


if __name__ == "__main__":
    sys.exit(main())
