"""``python -m pointloom``: list queries, run one over a folder of tables, or convert points."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main() -> None:
    p = argparse.ArgumentParser(prog="pointloom")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="names of all queries")
    run = sub.add_parser("run", help="run a query and write its rows as Parquet")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("out")
    convert = sub.add_parser("convert", help="point files to Parquet, CSV or LAS")
    convert.add_argument("kind", choices=["las", "ply", "pcd", "packed"])
    convert.add_argument("source")
    convert.add_argument("out")
    convert.add_argument("--to", choices=["parquet", "csv", "las"], default="parquet")
    args = p.parse_args()

    from pointloom.plans import catalog

    if args.command == "queries":
        print("\n".join(sorted(catalog.QUERIES)))
        return
    spark = SparkSession.builder.appName("pointloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "run":
        catalog.QUERIES[args.query](spark, args.tables).write.parquet(args.out)
        return
    from pointloom.sources import points, sinks

    rows = points.read_points(spark, args.source, args.kind)
    if args.to == "parquet":
        rows.write.parquet(args.out)
    elif args.to == "csv":
        sinks.write_table(rows, args.out)
    else:
        for path in sinks.write_las(rows.na.fill(0), args.out):
            print(path)


if __name__ == "__main__":
    main()
