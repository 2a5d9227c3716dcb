"""``python -m millrace.jobs.summarize --log driver.log --metrics folder --out folder``"""

from __future__ import annotations

import argparse

from millrace.plans.run_summary import summarize_run
from millrace.session import cluster_session
from millrace.sinks.summaries import node_report, overall_report, run_report


def main(argv: list[str] | None = None) -> int:
    cli = argparse.ArgumentParser(description="Summarize node metrics and the result of a run")
    cli.add_argument("--log", required=True)
    cli.add_argument("--metrics", required=True, help="folder of metrics_<node>.csv files")
    cli.add_argument("--out", required=True, help="folder for the summary and the reports")
    cli.add_argument("--print", action="store_true", help="show the reports as well")
    args = cli.parse_args(argv)

    summary = summarize_run(cluster_session("summarize"), args.log, args.metrics)
    summary.write(args.out)
    if args.print:
        for report in (
            node_report(summary.nodes).orderBy("node"),
            overall_report(summary.overall).orderBy("position"),
            run_report(summary.result),
        ):
            print("\t".join(report.columns))
            for row in report.toLocalIterator():  # all rows, a partition at a time
                print("\t".join(map(str, row)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
