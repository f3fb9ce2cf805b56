"""Command line: run a query over a data directory, import price lists, or report metrics."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.functions.scalars import bar
from tidemark.operators import metrics
from tidemark.sources import files, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="run a registered query")
    q.add_argument("name", choices=sorted(queries.QUERIES))
    q.add_argument("data")
    q.add_argument("--out", help="folder for the result as Parquet; without it twenty rows are shown")
    i = sub.add_parser("import", help="compile a folder of price lists into one table a security")
    i.add_argument("folder")
    i.add_argument("out")
    s = sub.add_parser("spine", help="the price lists of a span of days that a folder lacks")
    s.add_argument("start")
    s.add_argument("end")
    s.add_argument("folder")
    b = sub.add_parser("backtest", help="metrics of labelled rows as JSON lines, or of generated ones")
    b.add_argument("--path")
    b.add_argument("--json", action="store_true")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    if a.command == "query":
        df = queries.QUERIES[a.name](spark, a.data)
        if a.out:
            df.write.mode("overwrite").parquet(a.out)
        else:
            df.show(20, truncate=False)
    elif a.command == "import":
        sinks.write_securities(files.security_rows(files.workbooks(spark, a.folder)), a.out)
    elif a.command == "spine":
        names = spark.read.format("binaryFile").load(a.folder).select(F.substring_index("path", "/", -1).alias("file_name"))
        for row in files.missing_files(files.date_spine(spark, a.start, a.end), names).orderBy("day").toLocalIterator():
            print(row["day"], row["file_name"])
    else:
        rows = files.synthetic_predictions(spark)
        if a.path:
            shape = "predicted_direction string, price_label string, predicted_confidence double, impact_type string, ticker string, correct boolean"
            rows = spark.read.schema(shape).json(a.path)
        for report in (metrics.overall(rows), metrics.precision_recall_f1(rows), metrics.by_confidence(rows).withColumn("bar", bar(F.col("accuracy")))):
            if a.json:
                print("\n".join(report.toJSON().collect()))
            else:
                report.show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
