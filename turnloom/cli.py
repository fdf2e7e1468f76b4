"""Command line: run a configured pipeline, results as JSON on standard output."""

from __future__ import annotations

import argparse
import json
import sys

from turnloom.config import load_config
from turnloom.plans.build import PipelineError, run_pipeline


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="turnloom")
    run = p.add_subparsers(dest="command", required=True).add_parser("run", help="run the stages of a configuration")
    run.add_argument("--config", required=True)
    run.add_argument("--dry-run", action="store_true")
    args = p.parse_args(argv)
    try:
        config = load_config(args.config)
        spark = None
        if not args.dry_run:
            from turnloom.session import session

            spark = session()
        print(json.dumps(run_pipeline(spark, config, args.dry_run, lambda s: print(f"stage {s}", file=sys.stderr)), indent=2))
    except (OSError, ValueError, KeyError, PipelineError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
