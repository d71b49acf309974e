"""Command line: run grids of methods over prepared streams, the study's suites, and checks of results and files.

    python -m driftloom.cli run --data stream.parquet --classes 4 --out results/execution_runs/a --methods proposed fixed_rank --seeds 7 13
    python -m driftloom.cli run-drift --out results/execution_runs/drift
    python -m driftloom.cli verify --records results/records --summary results/summary.csv --by method --metrics ari nmi --runs 10
    python -m driftloom.cli verify-manifest --data 'data/*' --manifest manifest.csv

A stream is a Parquet table (t, features, label).  `run` leaves out runs that are there already, unless
forced; `--dry-run` only prints the plan.  The suites (run-controlled, run-rank, run-ablation, run-drift,
run-sensitivity) run on the generated drift stream.  Checks end with status 1 if something differs.
"""

from __future__ import annotations

import argparse
import json
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ABLATION, DATASETS, SEEDS, SENSITIVITY
from .kernels.methods import METHODS
from .operators import checks, traces
from .operators.quality import windows_summary
from .plans import run_queries, runner
from .session import build
from .sources import files, sinks, study
from .sources.controlled import read_controlled

CONTROLLED = ("proposed", "fixed_rank", "twstream", "fra_art")


def told(rows: list[dict]) -> None:
    print(json.dumps(rows, indent=1, default=str))


def differs(df: DataFrame, what: str) -> bool:
    rows = [r.asDict() for r in df.limit(1000).collect()]
    told([{"check": what, "differences": rows}])
    return bool(rows)


def finished(spark: SparkSession, out: str) -> DataFrame | None:
    try:
        return spark.read.json(out)
    except Exception as e:
        if files.is_absent(e):
            return None
        raise


def run(args: argparse.Namespace) -> int:
    plan = [(m, s, args.dataset, {}) for m in args.methods for s in args.seeds]
    if args.dry_run:
        told([{"dataset": args.dataset, "method": m, "seed": s} for m, s, *_ in plan])
        return 0
    spark, out = build(), sinks.guarded(args.out)
    cells, done = runner.run_cells(spark, plan), None if args.force else finished(spark, out)
    if done is not None:
        cells = sinks.still_to_run(cells, done.select("method", F.col("seed").cast("int").alias("seed")), ["method", "seed"])
    stream = spark.read.parquet(args.data)
    stream = stream.where(F.col("t") < args.rows) if args.rows else stream
    scored = runner.evaluate(stream, cells, args.classes, args.chunk)
    runs = windows_summary(scored, ["method", "seed"]).withColumn("dataset", F.lit(args.dataset)).withColumn("full_stream", F.lit(not args.rows))
    sinks.resume_runs(runs, out, force=args.force)
    return 0


def suite(plan, make):
    """A command that prints a plan, or writes a table of the controlled stream."""

    def do(args: argparse.Namespace) -> int:
        if args.dry_run:
            told(plan(args))
            return 0
        spark = build()
        sinks.write_table(make(spark, args), args.out, force=args.force)
        return 0

    return do


def _controlled(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    cells = runner.run_cells(spark, [(m, s, "controlled", {}) for m in args.methods for s in args.seeds])
    scored = runner.evaluate(run_queries.controlled_stream(spark), cells, 4, 1000, starts=10, steps=300)
    return windows_summary(scored, ["method", "seed"])


SUITES = {
    "run-controlled": (lambda a: [{"method": m, "seed": s} for m in a.methods for s in a.seeds], _controlled),
    "run-rank": (lambda a: [{"method": "proposed", "seed": s} for s in a.seeds], lambda spark, a: run_queries.rank_summary(spark, tuple(a.seeds))),
    "run-ablation": (lambda a: [{"variant": v, "seed": s} for v in ABLATION for s in a.seeds], lambda spark, a: run_queries.rank_summary(spark, tuple(a.seeds), ABLATION)),
    "run-drift": (lambda a: [{"method": "proposed", "seed": s, "drift": d} for s in a.seeds for d in (3000, 6000)], lambda spark, a: run_queries.drift_response(spark, tuple(a.seeds))),
    "run-sensitivity": (lambda a: [{"axis": k, "value": v, "seed": a.seeds[0]} for k, vs in SENSITIVITY.items() for v in vs], lambda spark, a: run_queries.sensitivity_grid(spark, a.seeds[0])),
}


def profile(args: argparse.Namespace) -> int:
    """Median and largest seconds of each method over repeated runs of the controlled stream, and its state."""
    spark, rows = build(), []
    stream = run_queries.controlled_stream(spark).cache()
    n = stream.count()
    for method in args.methods:
        took, state = [], 0
        for _ in range(args.repeat):
            began = time.perf_counter()
            final = runner.run_matrix(stream, runner.run_cells(spark, [(method, args.seeds[0], "profile", {})])).where(F.col("kind") == "final").first()
            took.append(time.perf_counter() - began)
            state = json.loads(final["counters"])["state_bytes"]
        rows.append({"method": method, "ms_per_1000_median": 1e6 * statistics.median(took) / n, "ms_per_1000_max": 1e6 * max(took) / n, "state_mb": state / 2**20})
    told(rows)
    return 0


def summarize(args: argparse.Namespace) -> int:
    runs = build().read.json(sinks.guarded(args.out))
    told([r.asDict() for r in traces.seed_summary(runs, ["dataset", "method"], "ari_mean").orderBy("dataset", "method").collect()])
    told([r.asDict() for r in traces.mean_of_means(runs, ["method"], ["dataset"], "ari_mean").orderBy("method").collect()])
    return 0


def status(args: argparse.Namespace) -> int:
    told([r.asDict() for r in files.digests(build(), args.data).orderBy("path").collect()])
    return 0


def verify(args: argparse.Namespace) -> int:
    """Records against the summary that is said to come from them."""
    spark = build()
    records, summary = spark.read.option("multiLine", True).option("recursiveFileLookup", True).json(args.records), files.read_results_csv(spark, args.summary)
    return int(differs(checks.summary_mismatches(records, summary, args.by, args.metrics, args.runs), "summary"))


def verify_manifest(args: argparse.Namespace) -> int:
    """Files against a table (path, sha256), by the end of their paths: both ways, content included."""
    spark = build()
    listed = files.read_results_csv(spark, args.manifest).select("path", "sha256")
    name = F.substring_index("path", "/", -1)
    found = files.digests(spark, args.data)
    return int(differs(checks.set_difference(listed.select(name.alias("name"), "sha256"), found.select(name.alias("name"), "sha256"), ["name", "sha256"]), "manifest"))


def verify_data(args: argparse.Namespace) -> int:
    """Each data set that is there, with its origin and whether its shape holds."""
    spark, rows = build(), []
    for name in DATASETS:
        try:
            got = study.load(spark, args.root, name, packaged=True)
            rows.append({"dataset": name, "source": got.source, "canonical": got.canonical, "rows": got.labels.count()})
        except FileNotFoundError as e:
            rows.append({"dataset": name, "missing": str(e)})
    told(rows)
    return int(any("missing" in r for r in rows))


def prepare(args: argparse.Namespace) -> int:
    """A raw file as a prepared stream."""
    spark = build()
    if args.kind == "csv":
        stream = files.read_headerless_csv(spark, args.data, args.features)
    else:
        stream = files.read_arff(spark, args.data)
    stream.write.mode("overwrite" if args.force else "errorifexists").parquet(args.to)
    return 0


def controlled(args: argparse.Namespace) -> int:
    read_controlled(build()).write.mode("overwrite" if args.force else "errorifexists").parquet(args.to)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="driftloom")
    sub = top.add_subparsers(required=True)

    def command(name: str, do, *required: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for flag in required:
            p.add_argument(flag, required=True)
        p.set_defaults(do=do)
        return p

    def grid(p: argparse.ArgumentParser, methods: tuple[str, ...] | None) -> None:
        if methods:
            p.add_argument("--methods", nargs="+", choices=METHODS, default=list(methods))
        p.add_argument("--seeds", nargs="+", type=int, choices=SEEDS, default=list(SEEDS))
        p.add_argument("--dry-run", action="store_true")
        p.add_argument("--force", action="store_true")

    p = command("run", run, "--data", "--out")
    p.add_argument("--classes", type=int, required=True)
    p.add_argument("--dataset", default="stream")
    p.add_argument("--chunk", type=int, default=1000)
    p.add_argument("--rows", type=int, default=0)
    grid(p, METHODS)
    for name, (plan, make) in SUITES.items():
        p = command(name, suite(plan, make), "--out")
        grid(p, CONTROLLED if name == "run-controlled" else None)
    p = command("profile-resources", profile)
    p.add_argument("--repeat", type=int, default=5)
    grid(p, CONTROLLED)
    command("summarize", summarize, "--out")
    command("status", status, "--data")
    p = command("verify", verify, "--records", "--summary")
    p.add_argument("--by", nargs="+", required=True)
    p.add_argument("--metrics", nargs="+", required=True)
    p.add_argument("--runs", type=int, default=len(SEEDS))
    command("verify-manifest", verify_manifest, "--data", "--manifest")
    command("verify-data", verify_data, "--root")
    p = command("prepare", prepare, "--data", "--to")
    p.add_argument("--kind", choices=("csv", "arff"), required=True)
    p.add_argument("--features", type=int, default=54)
    p.add_argument("--force", action="store_true")
    p = command("controlled", controlled, "--to")
    p.add_argument("--force", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.do(args)


if __name__ == "__main__":
    sys.exit(main())
