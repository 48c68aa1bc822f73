"""Command line.

    spark-submit tidemark load   CSV_FOLDER TABLE_FOLDER
    spark-submit tidemark run    TABLE_FOLDER [--config FILE] [--asof DAY]
    spark-submit tidemark audit  TABLE_FOLDER [--log FOLDER]
    spark-submit tidemark export TABLE_FOLDER OUT_FOLDER

``run`` exits with 1 if a metric failed, 2 if one alerts, else 0.
"""

from __future__ import annotations

import argparse
import sys
from datetime import date, datetime

from tidemark.monitor import Monitor
from tidemark.operators.evaluate import display_rows, run_summary
from tidemark.plans import session
from tidemark.plans.registry import load_specs
from tidemark.sources.csvtables import load_tables, row_counts
from tidemark.sources.starschema import StarSchema, write_parquet


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    commands = p.add_subparsers(dest="command", required=True)
    load = commands.add_parser("load")
    load.add_argument("source")
    load.add_argument("tables")
    load.add_argument("--pattern", default="{table}.csv")
    for name in ("run", "audit", "export"):
        c = commands.add_parser(name)
        c.add_argument("tables")
        c.add_argument("--asof", type=date.fromisoformat)
        if name == "run":
            c.add_argument("--config")
        if name == "audit":
            c.add_argument("--log")
        if name == "export":
            c.add_argument("out")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session()
    if args.command == "load":
        write_parquet(load_tables(spark, args.source, args.pattern), args.tables)
        row_counts(StarSchema.from_parquet(spark, args.tables).tables).show(truncate=False)
        return 0
    source = StarSchema.from_parquet(spark, args.tables, args.asof)
    if args.command == "run":
        status = Monitor(source, load_specs(args.config) if args.config else None).kpis()
        rows = status.persist()          # one row per metric
        display_rows(rows).show(100, truncate=False)
        summary = run_summary(rows).first()
        return summary["run_status"] if summary["total"] else 0
    monitor = Monitor(source)
    if args.command == "audit":
        monitor.audit().drop("description").show(truncate=False)
        monitor.health().show(truncate=False)
        if args.log:
            monitor.record_audit(args.log, datetime.now())
        return 0
    monitor.export(args.out).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
