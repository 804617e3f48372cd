"""Commands: ``python -m folioscope scan`` reads a directory of images with an engine, ``audit`` judges a table of pages.

``scan DIRECTORY OUTPUT --engine MODULE:NAME [--max-length N]`` writes one Markdown file for each image;
``audit TABLE [--verbose]`` prints the verdicts of documents (Parquet: document, text, prose, markdown,
real_tables, cells, content_images). Both end with 1 if something failed.
"""

from __future__ import annotations

import argparse
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import api
from .functions import text as T
from .sources import providers, sinks


def engine_of(name: str):
    module, _, attribute = name.partition(":")
    return getattr(import_module(module), attribute)


def scan(spark: SparkSession, directory: str, output: str, engine, max_length: int) -> int:
    """Writes name, report of every image that was read as Parquet under output; the number of failures."""
    found = providers.scan_images(api.read_images(spark, directory), engine, max_length)
    reports = found.select("name", T.stem(F.col("name")).alias("stem"), "error", sinks.batch_report(F.col("name"), F.col("raw"), tool=False).alias("report"))
    reports.write.mode("overwrite").parquet(output)
    counts = providers.batch_counts(spark.read.parquet(output)).first()
    print(f"{counts.files} files, {counts.ok} read, {counts.failed} failed")
    return counts.failed


def audit(spark: SparkSession, table: str, verbose: bool) -> int:
    """Prints a line for each document that failed (for every one with verbose); the number of failed documents."""
    found = api.audit(spark.read.parquet(table)).cache()
    for r in (found if verbose else found.where("failed")).orderBy("document").toLocalIterator():
        print(f"{r.document}: {'FAILED' if r.failed else 'ok'}, {r.pages_with_problems} of {r.pages} pages with {r.problems} problems")
    return found.where("failed").count()


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folioscope", description=__doc__.split("\n", 1)[0])
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("scan")
    one.add_argument("directory")
    one.add_argument("output")
    one.add_argument("--engine", required=True)
    one.add_argument("--max-length", type=int, default=8192)
    two = commands.add_parser("audit")
    two.add_argument("table")
    two.add_argument("--verbose", action="store_true")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("folioscope").getOrCreate()
    failed = scan(spark, given.directory, given.output, engine_of(given.engine), given.max_length) if given.command == "scan" else audit(spark, given.table, given.verbose)
    return int(failed > 0)


if __name__ == "__main__":
    raise SystemExit(main())
