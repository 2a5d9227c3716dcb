"""``python -m millrace.jobs.scale --input trips.csv --with-std``"""

from __future__ import annotations

import argparse

from millrace.functions.fields import split_names
from millrace.plans.preparation import scaling_run, zscore_run
from millrace.session import cluster_session
from millrace.sinks.records import result_line, write_run_record
from millrace.sources.tables import TRIP_FEATURES


def main(argv: list[str] | None = None) -> int:
    cli = argparse.ArgumentParser(description="Scale the numeric columns of a CSV file")
    cli.add_argument("--input", required=True)
    cli.add_argument("--run-id", default="")
    cli.add_argument("--numeric-cols", type=split_names, default=list(TRIP_FEATURES))
    cli.add_argument("--with-mean", action="store_true")
    cli.add_argument("--with-std", action="store_true")
    cli.add_argument("--zscore", action="store_true", help="z-scores; keeps the other columns")
    cli.add_argument("--repartition", type=int, default=0)
    cli.add_argument("--topn", type=int, default=10, help="heaviest partitions to report")
    cli.add_argument("--cache", action="store_true")
    cli.add_argument("--record", default="", help="folder to append the run record to")
    args = cli.parse_args(argv)

    spark = cluster_session("scale " + args.run_id)
    if args.zscore:
        run, check = zscore_run(spark, args.input, args.numeric_cols, args.run_id)
        check.show(len(args.numeric_cols), truncate=False)
    else:
        run = scaling_run(
            spark,
            args.input,
            columns=args.numeric_cols,
            with_mean=args.with_mean,
            with_std=args.with_std,
            partitions=args.repartition,
            cache=args.cache,
            top=args.topn,
            run_id=args.run_id,
        )
    print(result_line(run.result))
    if args.record:
        write_run_record(spark, run.result, args.record)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
