"""generate, validate and validate-real. Exit codes: 0 done, 2 a real run not accepted, 3 blocked, 4 error."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("causeway").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="causeway")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("generate", help="generate a ledger and write its bundle")
    one.add_argument("--config", default="configs/generator_behavior.yaml")
    two = commands.add_parser("validate", help="check a bundle against every rule")
    two.add_argument("--dir", default="data/synthetic/behavior_run")
    three = commands.add_parser("validate-real", help="run the strict protocol against a raw directory")
    for name, where in (("--config", "configs/generator_behavior.yaml"), ("--raw-dir", "data/raw"), ("--out", "data/synthetic/behavior_run/strict_report.json")):
        three.add_argument(name, default=where)
    three.add_argument("--tier", choices=["smoke", "real"], default="smoke")
    three.add_argument("--backend", choices=["auto", "full", "sgc"])
    three.add_argument("--seeds")
    three.add_argument("--k", type=int)
    three.add_argument("--sage-only", action="store_true", help="only the first of the graph networks")
    args = parser.parse_args(argv)
    if args.command == "generate":
        from .simulation import bundle, config, generate

        c = config.load(args.config)
        raw = Path("data/raw").resolve()
        if Path(c.out_dir).resolve().is_relative_to(raw):
            print("refusing to write generated data inside data/raw", file=sys.stderr)
            return 4
        spark = session()
        ledger = generate.generate(spark, c, bundle.volume(spark, c.stats_dir))
        bundle.write(ledger, c.out_dir)
        print(f"generated {ledger.nodes.count()} transactions and {ledger.edges.count()} edges")
        return 0
    if args.command == "validate":
        from .simulation import validate

        try:
            validate.validate_behavior(session(), args.dir)
        except ValueError as x:
            print(f"invalid: {x}", file=sys.stderr)
            return 4
        print(f"validated {args.dir}")
        return 0
    from .plans import protocol

    try:
        seeds = [int(x) for x in args.seeds.split(",") if x] if args.seeds is not None else None
    except ValueError as x:
        print(f"status=error: invalid seeds: {x}", file=sys.stderr)
        return 4
    report = protocol.validate_real(session(), args.config, args.raw_dir, args.out, args.tier, args.backend, seeds, args.k, args.sage_only)
    print(f"status={report['status']} -> {args.out}")
    if report["status"] != "completed":
        print(report.get("error"), file=sys.stderr)
        return 3 if report["status"] == "blocked" else 4
    return 2 if report["benchmark_tier"] == "real" and not (report["acceptance_eligible"] and report["acceptance"]["target_met"]) else 0


if __name__ == "__main__":
    sys.exit(main())
