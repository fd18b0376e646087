"""``python -m leafwright WHAT INPUT OUTPUT``: from files to JSON lines, lines of text or EPUB files.

``units``, ``glossary``, ``coverage``, ``candidates`` and ``translate`` read text or EPUB files; ``assemble`` reads what
``translate`` wrote. ``translate`` and, for renderings, ``glossary`` take a model: a function of a request's text that
returns the reply's, as ``--model package.module:function``, which the executors can import too.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from leafwright import api
from leafwright.functions.text import safe_filename
from leafwright.operators import coverage, planning, progress, segment
from leafwright.scratch import table
from leafwright.sources import books, connectors

#: What ``translate`` writes.
PAIRS = T.StructType([T.StructField(n, T.LongType() if n.endswith("_no") else T.StringType()) for n in ("book", "chapter_no", "title", "unit_no", "unit", "translation", "source_hash")])


def _model(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _lines(rows: DataFrame, output: str) -> None:
    rows.write.mode("overwrite").json(output)


def translate(spark: SparkSession, args) -> int:
    """Translate what is missing; units whose books changed or that were stored blank are asked for again."""
    stored = spark.read.schema(PAIRS).json(args.stored) if args.stored else None
    pairs = table(api.build_book(api.read_books(spark, args.input), _model(args.model), stored, args.language, args.proof), "pairs")
    _lines(pairs.select(PAIRS.names), args.output)
    try:
        gates = progress.required(pairs)
    except progress.TranslationError as failure:
        print(failure, file=sys.stderr)
        return 2
    return _told(gates.where("status <> 'complete'"))


def assemble(spark: SparkSession, args) -> int:
    """Write the EPUB file of each complete book, all or none; books with blanks are named and refused."""
    made = table(api.publish(spark.read.schema(PAIRS).json(args.input).drop("source_hash"), source=args.language), "epubs")
    connectors.register(spark, connectors.FileSink)
    files = made.where("status = 'written'").select(safe_filename("book").alias("name"), "epub")
    files.selectExpr("concat(name, '.epub') AS name", "epub AS content").write.format("named_files").mode("overwrite").option("path", args.output).save()
    return _told(made.where("status <> 'written'"))


def _told(rows: DataFrame) -> int:
    """Names up to ten books that aren't complete; 1 if there are any."""
    some = rows.select("book", "status").orderBy("book").limit(10).collect()
    for r in some:
        print(f"{r['book']}: {r['status']}", file=sys.stderr)
    return 1 if some else 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="leafwright", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("what", choices=["units", "glossary", "coverage", "candidates", "translate", "assemble"])
    parser.add_argument("input", help="text or EPUB files (a glob is possible); for assemble the folder of translate")
    parser.add_argument("output", help="folder for JSON lines (or lines of text for coverage, or files for assemble)")
    parser.add_argument("--model", help="package.module:function")
    parser.add_argument("--language", default="en", help="the books' language")
    parser.add_argument("--stored", help="folder of an earlier translate")
    parser.add_argument("--proof", action="store_true", help="ask for a second pass")
    args = parser.parse_args(argv)
    if args.what == "translate" and not args.model:
        parser.error("translate needs --model")
    spark = SparkSession.builder.getOrCreate()
    if args.what == "translate":
        return translate(spark, args)
    if args.what == "assemble":
        return assemble(spark, args)
    if args.what == "candidates":
        _lines(books.local_candidates(spark, args.input), args.output)
        return 0
    rows = api.read_books(spark, args.input)
    if args.what == "units":
        _lines(segment.book_units(rows), args.output)
    elif args.what == "glossary":
        terms = planning.glossary(planning.term_counts(rows, language=args.language))
        _lines(planning.rendered(table(terms, "terms"), _model(args.model)) if args.model else terms, args.output)
    else:
        lines = coverage.coverage_lines(coverage.code_points(rows))
        lines.orderBy("line_no").select("line").coalesce(1).write.mode("overwrite").text(args.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
