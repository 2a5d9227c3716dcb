"""``python -m millrace.jobs.encode --input binned.csv``"""

from __future__ import annotations

import argparse

from millrace.functions.fields import TOP_CATEGORY, split_names
from millrace.plans.preparation import encoding_run, fixed_encoding_run
from millrace.session import cluster_session
from millrace.sinks.records import result_line, write_run_record
from millrace.sources.tables import TRIP_FEATURES


def main(argv: list[str] | None = None) -> int:
    cli = argparse.ArgumentParser(description="One-hot encode category columns of a CSV file")
    cli.add_argument("--input", required=True)
    cli.add_argument("--run-id", default="")
    cli.add_argument("--target-cols", type=split_names, default=list(TRIP_FEATURES))
    cli.add_argument("--drop-last", action="store_true")
    cli.add_argument("--fixed-width", action="store_true", help="no fit, dense, all columns kept")
    cli.add_argument("--top-category", type=int, default=TOP_CATEGORY)
    cli.add_argument("--repartition", type=int, default=0)
    cli.add_argument("--topn", type=int, default=10, help="heaviest partitions to report")
    cli.add_argument("--cache", action="store_true")
    cli.add_argument("--record", default="", help="folder to append the run record to")
    args = cli.parse_args(argv)

    spark = cluster_session("encode " + args.run_id)
    if args.fixed_width:
        run = fixed_encoding_run(
            spark, args.input, args.target_cols, args.top_category, args.repartition, args.run_id
        )
    else:
        run = encoding_run(
            spark,
            args.input,
            columns=args.target_cols,
            drop_last=args.drop_last,
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
