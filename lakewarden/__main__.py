"""Assesses one table: python -m lakewarden TABLE [--dataset NAME] [--regulations FOLDER] [--out FOLDER]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lakewarden.plans import pipeline
from lakewarden.sources import tables


def main() -> None:
    parser = argparse.ArgumentParser(prog="lakewarden")
    parser.add_argument("table", help="a CSV file, or parquet")
    parser.add_argument("--dataset", help="name by which required columns and business key are known")
    parser.add_argument("--regulations", help="folder of markdown files, to cite")
    parser.add_argument("--out", help="folder for the report and the audit log")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("lakewarden").getOrCreate()
    df = tables.read_csv(spark, args.table) if args.table.endswith(".csv") else spark.read.parquet(args.table)
    name = args.dataset or args.table.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    passages = tables.read_regulations(spark, args.regulations) if args.regulations else None
    assessed = pipeline.assess(df, name, passages=passages)
    doc = pipeline.report(assessed, df)
    print(pipeline.markdown(doc))
    if args.out:
        tables.write_report(spark, doc, f"{args.out}/report")
        tables.append_audit(pipeline.audit_table(spark, assessed.audit), f"{args.out}/audit")


if __name__ == "__main__":
    main()
