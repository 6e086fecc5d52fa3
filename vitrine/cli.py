"""Command line: run a registered query and write its result, export snapshots,
write the catalogue mart.

    spark-submit -m vitrine.cli run product_page --tables ROOT --out OUT [--format parquet|json]
    spark-submit -m vitrine.cli export --tables SF_DIR --out ROOT
    spark-submit -m vitrine.cli mart --tables ROOT --out OUT

``--tables`` is either a snapshot root (``users/``, ``products/``, ...) or a
directory of the driver's source tables. Outputs go to new directories only.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from vitrine.operators import listing
from vitrine.plans import QUERIES
from vitrine.plans.queries import cat
from vitrine.session import ensure_checkpoint_dir
from vitrine.sources import snapshots


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="vitrine")
    sub = ap.add_subparsers(dest="cmd", required=True)
    run = sub.add_parser("run")
    run.add_argument("query", choices=sorted(QUERIES))
    run.add_argument("--tables", required=True)
    run.add_argument("--out", required=True)
    run.add_argument("--format", default="parquet", choices=["parquet", "json"])
    exp = sub.add_parser("export")
    exp.add_argument("--tables", required=True)
    exp.add_argument("--out", required=True)
    mart = sub.add_parser("mart")
    mart.add_argument("--tables", required=True)
    mart.add_argument("--out", required=True)
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName(f"vitrine-{args.cmd}").getOrCreate()
    ensure_checkpoint_dir(spark)
    if args.cmd == "run":
        df = QUERIES[args.query].build(spark, args.tables)
        getattr(df.write.mode("errorifexists"), args.format)(args.out)
    elif args.cmd == "export":
        snapshots.export(cat(spark, args.tables), args.out)
    else:
        c = cat(spark, args.tables)
        listing.write_catalogue_mart(listing.catalogue_mart(c.products, c.users, c.product_variations), args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
