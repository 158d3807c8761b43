"""Entry for spark-submit: `python -m cellgauge.plans.submit vertical --data ...`."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from cellgauge.operators.fusion import META, WEIGHTED
from cellgauge.plans.horizontal import run_horizontal
from cellgauge.plans.jobs import JobConfig, JobResult
from cellgauge.plans.vertical import run_vertical
from cellgauge.session import build_session
from cellgauge.sources import sinks
from cellgauge.sources.schema import canonical_names
from cellgauge.sources.tables import FORMATS, read_table

# Range of the test share.
TEST_SIZE_MIN, TEST_SIZE_MAX = 0.1, 0.5

JOBS = {"vertical": run_vertical, "horizontal": run_horizontal}


def parse(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="cellgauge")
    parser.add_argument("approach", choices=list(JOBS))
    parser.add_argument("--data", required=True, help="CSV, Parquet, ORC or JSON path")
    parser.add_argument("--format", choices=sorted(set(FORMATS.values())))
    parser.add_argument("--test-size", type=float, default=0.2)
    parser.add_argument("--random-state", type=int, default=42)
    parser.add_argument("--output", default="results")
    parser.add_argument("--trees", type=int, default=100)
    parser.add_argument("--depth", type=int, default=10)
    parser.add_argument("--layout", type=int, help="training partitions, for repeatable forests")
    parser.add_argument("--strategy", choices=[WEIGHTED, META], default=WEIGHTED)
    parser.add_argument("--approximate", action="store_true", help="approximate percentiles")
    parser.add_argument("--strict", action="store_true", help="stop on a failed split check")
    args = parser.parse_args(argv)
    problem = argument_problem(args)
    if problem:
        parser.error(problem)
    return args


def argument_problem(args: argparse.Namespace) -> str | None:
    """The first thing wrong with the options, None when all is well."""
    if not TEST_SIZE_MIN <= args.test_size <= TEST_SIZE_MAX:
        return f"test size must be between {TEST_SIZE_MIN} and {TEST_SIZE_MAX}"
    if args.random_state < 0:
        return "random state must be non-negative"
    return None


def write_results(result: JobResult, output: str) -> None:
    sinks.write_csv(result["comparison"], f"{output}/comparison")
    sinks.write_metrics_json(result["metrics"], f"{output}/metrics")
    sinks.write_text(result["report"], f"{output}/summary")


def main(argv: Sequence[str] | None = None) -> int:
    """Run a job; 0 when it is done, 1 with a logged message when it fails."""
    args = parse(argv)
    logging.basicConfig(level=logging.INFO)
    spark = build_session(f"cellgauge-{args.approach}")
    try:
        run_job(spark, args)
    except (FileNotFoundError, ValueError) as error:
        logging.error("%s", error)
        return 1
    except Exception:
        logging.exception("the %s job failed", args.approach)
        return 1
    return 0


def run_job(spark: SparkSession, args: argparse.Namespace) -> None:
    # The job itself applies the column contract, so that it can report what does not parse.
    df = canonical_names(read_table(spark, args.data, args.format))
    config = JobConfig(
        args.test_size,
        args.random_state,
        args.trees,
        args.depth,
        args.strategy,
        not args.approximate,
        args.strict,
        args.layout,
    )
    result = JOBS[args.approach](df, config)
    write_results(result, args.output)
    sinks.write_json(
        sinks.run_record(
            spark, args.approach, args.data, args.test_size, args.random_state, args.output
        ),
        f"{args.output}/config",
    )
    result["comparison"].show(truncate=False)
    result.close()


if __name__ == "__main__":
    sys.exit(main())
