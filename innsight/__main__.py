"""Build every entitled report for every tenant (the batch job), from the command line.

    spark-submit --conf spark.checkpoint.dir=hdfs:///shared/ckpt \\
        -m innsight --registry ctl.dashboard_customers --schema sales --out s3://bucket/marts

Tables are read from the session catalog: per-tenant tables under ``--schema``
(``{PREFIX}_REPORT_ITEMS`` ...), or, with ``--shared SUFFIX=table`` pairs,
one shared table per source with a ``tenant`` column.  Prints one status
line per report and exits non-zero when a report failed.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from innsight.plans.job import SHARED_SOURCES, build_marts, build_shared_marts
from innsight.session import apply_scale_conf, ensure_checkpoint_dir
from innsight.sources.registry import load_registry
from innsight.sources.tables import TableCatalog, check_identifier


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="innsight", description=__doc__.split("\n")[0])
    ap.add_argument("--registry", required=True, help="customers control table")
    ap.add_argument("--out", required=True, help="output folder (shared storage)")
    ap.add_argument("--schema", default=None, help="schema of the per-tenant tables")
    ap.add_argument("--format", default="parquet", choices=("parquet", "csv"))
    ap.add_argument("--tenant", action="append", help="only these tenants (repeatable)")
    ap.add_argument("--parallelism", type=int, default=4, help="tenant pages built concurrently")
    ap.add_argument("--shared", action="append", default=[], metavar="SUFFIX=TABLE",
                    help=f"shared source table; SUFFIX in {', '.join(SHARED_SOURCES)}")
    ap.add_argument("--email-table", action="append", default=[], metavar="NAME=TABLE",
                    help="shared email source named NAME in the registry")
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName("innsight-marts").getOrCreate()
    apply_scale_conf(spark)  # what the session sets itself is kept
    ensure_checkpoint_dir(spark)
    registry = load_registry(spark.table(check_identifier(args.registry)))
    if args.shared:
        tables = {}
        for pair in args.shared:
            suffix, table = pair.split("=", 1)
            if suffix not in SHARED_SOURCES:
                ap.error(f"unknown source {suffix!r}")
            tables[suffix] = spark.table(check_identifier(table))
        emails = {}
        for pair in args.email_table:
            name, table = pair.split("=", 1)
            emails[name] = spark.table(check_identifier(table))
        results = build_shared_marts(registry, tables, emails, args.out)
    else:
        catalog = TableCatalog(spark, schema=args.schema)
        results = build_marts(registry, catalog, args.out, args.format, args.tenant, args.parallelism)
    for r in results:
        print(f"{r.status:8s} {r.tenant:20s} {r.page:20s} {r.report:16s} {r.detail}")
    return 1 if any(r.status == "failed" for r in results) else 0


if __name__ == "__main__":
    sys.exit(main())
