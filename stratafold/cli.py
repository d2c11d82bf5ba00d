"""Command line: ``python -m stratafold.cli --config scan.yml [command]``."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from stratafold.engine import Engine
from stratafold.plans import artifacts, execution
from stratafold.sources.config import load_config

COMMANDS = ("run", "scan", "duplicates", "similarity", "plan", "execute", "report", "waste", "largest", "clusters", "merge-review", "older")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratafold")
    p.add_argument("command", nargs="?", default="run", choices=COMMANDS)
    p.add_argument("--config", required=True)
    for flag in ("--rescan", "--delta", "--replan", "--show-suppressed"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--plan", help="the plan to execute or review")
    p.add_argument("--cluster", help="merge-review: the cluster to change")
    p.add_argument("--cycle", action="store_true", help="merge-review: make the cluster's next folder its master")
    p.add_argument("--status", choices=("pending", "approved", "rejected", "skipped"))
    return p


def review(engine: Engine, args: argparse.Namespace) -> None:
    """Changes one cluster of a plan, where one is named, and shows the clusters."""
    path = args.plan or artifacts.latest(engine.config.home, "plan")
    plan = artifacts.Plan.of(engine.spark, path)
    if args.cluster and args.cycle:
        plan.cycle_master(args.cluster, engine.hashed_files())
    if args.cluster and args.status:
        plan.set_status(args.cluster, args.status)
    if args.cluster and (args.cycle or args.status) and Path(path).is_file():
        plan.export(Path(path), artifacts.header(path))
    for cluster, members in plan.nested(args.show_suppressed, most_files=15):
        print(artifacts.detail_text(cluster, members))
    print(plan.status_counts())


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    config = load_config(args.config)
    if args.command == "execute" and not args.plan:
        parser().error("execute needs --plan")
    engine = Engine(spark or SparkSession.builder.appName("stratafold").getOrCreate(), config, print)
    if args.command != "scan":
        for r in engine.stale_roots().collect():
            print(f"{r['root']}: " + ("never scanned" if r["age_days"] is None else f"last scanned {r['age_days']} days ago"))
    if args.command == "execute":
        print(execution.run_plan(engine.spark, args.plan, config.home))
    elif args.command == "merge-review":
        review(engine, args)
    elif args.command == "waste":
        print(artifacts.waste_text([r.asDict() for r in engine.waste().collect()]))
    elif args.command == "run":
        for k, v in engine.run(args.rescan, args.delta, args.replan).items():
            print(f"{k}: {v}")
    elif args.command == "scan":
        engine.preflight()
        print(engine.scan(args.rescan, args.delta))
    elif args.command in ("duplicates", "similarity"):
        print(getattr(engine, args.command)(args.rescan).count())
    elif args.command == "plan":
        print(engine.plan(args.replan))
    elif args.command == "report":
        print(engine.report())
    elif args.command == "older":
        print(engine.older())
    elif args.command == "clusters":
        shown = engine.clusters()
        rows = shown["members"].drop("turn", "key").join(shown["clusters"].drop("turn"), "cluster_id")
        for line in (rows if args.show_suppressed else rows.filter("not is_suppressed")).orderBy("top", "cluster_id", "path").toJSON().toLocalIterator():
            print(line)
    else:
        for line in engine.largest().toJSON().toLocalIterator():
            print(line)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
