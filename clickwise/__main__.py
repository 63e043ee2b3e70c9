"""Command-line entry (STR-11): ``python -m clickwise <job> ...``.

Jobs: ``ingest`` (Q1), ``aggregate`` (Q2 with its tables), ``report`` (RPT-1),
``retention`` (SNK-7), ``compact`` (AGG-11).  Spark settings come from the
session (``spark-submit --conf``); job parameters from ``JobConfig`` and its
environment overrides.
"""

from __future__ import annotations

import argparse
import sys

from clickwise.config import JobConfig


def _session():
    from clickwise.session import build_session
    return build_session(app_name="clickwise")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="clickwise")
    sub = p.add_subparsers(dest="job", required=True)

    s = sub.add_parser("ingest", help="request log -> de-duplicated click events")
    s.add_argument("--requests", required=True)
    s.add_argument("--out")
    s.add_argument("--checkpoint", required=True)
    s.add_argument("--kafka-servers")

    s = sub.add_parser("aggregate", help="click events -> late split, minute table, rollups")
    s.add_argument("--events", required=True)
    s.add_argument("--split-base", required=True)
    s.add_argument("--tables", required=True)
    s.add_argument("--checkpoint", required=True)
    s.add_argument("--format", default="json")
    s.add_argument("--kafka", action="store_true")
    s.add_argument("--encoding", choices=("json", "avro"), default="json", help="of the topic's values")
    s.add_argument("--avro-writer", action="append", metavar="ID=FILE", default=[],
                   help="a writer schema by its id in the frame (repeatable); values of other ids become dead letters")
    s.add_argument("--part-col")
    s.add_argument("--keep-accepted", action="store_true", help="also write the accepted clicks per batch")
    s.add_argument("--jdbc-url", help="also append minute rows to a database (or CLICKWISE_JDBC_*)")
    s.add_argument("--jdbc-table")

    s = sub.add_parser("report", help="advertiser report at a grain")
    s.add_argument("--tables", required=True)
    s.add_argument("--grain", choices=("minute", "hour", "day"), default="hour")
    s.add_argument("--advertiser")
    s.add_argument("--start")
    s.add_argument("--end")
    s.add_argument("--sessions", choices=("summed", "merged"), default="summed", help="merged: from the stored sketches")
    s.add_argument("--whole-range", action="store_true", help="one row for the range instead of one per period")
    s.add_argument("--out", help="write JSON lines here instead of printing")
    s.add_argument("--limit", type=int, help="rows printed when --out is not given (default: all)")

    s = sub.add_parser("retention", help="drop rows past the retention horizon")
    s.add_argument("--table", required=True)
    s.add_argument("--time-col", default="window_start")
    s.add_argument("--now", required=True)

    s = sub.add_parser("compact", help="keep only the latest version of each minute row")
    where = s.add_mutually_exclusive_group(required=True)
    where.add_argument("--table", help="a batch-written minute table")
    where.add_argument("--tables", help="base folder of a streaming job, running or not: all its tables")
    s.add_argument("--months", type=int, nargs="*", help="with --table: these months only")
    return p


def _writers(given: list[str]) -> dict[int, str]:
    """ID=FILE arguments -> schema id -> Avro schema."""
    out = {}
    for arg in given:
        number, _, path = arg.partition("=")
        with open(path, encoding="utf-8") as f:
            out[int(number)] = f.read()
    return out


def main(argv=None, spark=None) -> int:
    args = _parser().parse_args(argv)
    cfg = JobConfig.load()
    from clickwise.session import size_shuffle_partitions
    spark = spark or _session()
    if args.job == "ingest":
        from clickwise.sources.streams import request_log_stream
        from clickwise.streaming.ingest import start_ingest
        size_shuffle_partitions(spark, args.requests)
        q = start_ingest(request_log_stream(spark, args.requests), args.out, args.checkpoint, cfg,
                         kafka_servers=args.kafka_servers)
        q.awaitTermination()
    elif args.job == "aggregate":
        from clickwise.streaming.job import AggregationPaths, run_aggregation
        paths = AggregationPaths(args.events, args.split_base, args.tables, args.checkpoint)
        if args.jdbc_url:
            cfg = cfg.with_(jdbc_url=args.jdbc_url, jdbc_table=args.jdbc_table or cfg.jdbc_table)
        if not args.kafka:
            size_shuffle_partitions(spark, args.events)
        run_aggregation(spark, cfg, paths, fmt=args.format, use_kafka=args.kafka, encoding=args.encoding,
                        part_col=args.part_col, keep_accepted=args.keep_accepted, writers=_writers(args.avro_writer))
        spark.streams.awaitAnyTermination()
    elif args.job == "report":
        from clickwise.plans.report import as_json_lines, click_report
        size_shuffle_partitions(spark, args.tables)
        rep = click_report(spark, args.tables, args.grain, args.advertiser, args.start, args.end, sessions=args.sessions,
                           per_period=not args.whole_range)
        if args.out:
            as_json_lines(rep).write.mode("overwrite").text(args.out)
        else:
            print("\t".join(rep.columns))
            ordered = rep.orderBy(*rep.columns[:2])
            for n, row in enumerate(ordered.toLocalIterator()):
                if n == args.limit:
                    print(f"(cut after {n} rows; more exist)")
                    break
                print("\t".join(str(v) for v in row))
    elif args.job == "retention":
        from clickwise.sinks.tables import apply_retention
        size_shuffle_partitions(spark, args.table)
        print(apply_retention(spark, args.table, args.time_col, args.now, cfg.retention_years))
    elif args.job == "compact":
        size_shuffle_partitions(spark, args.table or args.tables)
        if args.tables:
            from clickwise.streaming.minutes import compact_tables
            print(compact_tables(spark, args.tables))
        else:
            from clickwise.operators.storage import compact_months
            compact_months(spark, args.table, args.months)
    return 0


if __name__ == "__main__":
    sys.exit(main())
