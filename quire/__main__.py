"""The command line: ``python -m quire convert|inspect|validate|report|version``.

Paths may be patterns that name many books. Exit codes: 0 good, 1 errors, 2 fatal, 3 wrong usage; of
several books the worst counts.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import convert as C
from .operators import inspection, validate
from .operators import report as R
from .runtime import VERSION
from .sources import bookdir
from .sources.epub import read_archives

FATAL, USAGE = 2, 3


class Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        self.print_usage(sys.stderr)
        print(f"usage: {message}", file=sys.stderr)
        raise SystemExit(USAGE)


def arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = Parser(prog="quire", description="EPUB 2 and 3 publications as Markdown book directories.")
    commands = parser.add_subparsers(dest="command", required=True, parser_class=Parser)
    c = commands.add_parser("convert", help="write book directories")
    c.add_argument("books")
    c.add_argument("--output", "-o", required=True, help="a folder that all executors share")
    c.add_argument("--strict", action="store_true", help="some warnings count as errors")
    c.add_argument("--verbose", "-v", action="store_true", help="print warnings")
    c.add_argument("--debug", action="store_true", help="print remarks")
    i = commands.add_parser("inspect", help="metadata, spine and navigation")
    i.add_argument("books")
    i.add_argument("--json", action="store_true")
    v = commands.add_parser("validate", help="check book directories")
    v.add_argument("folder", help="the folder that holds the books' folders")
    v.add_argument("--json", action="store_true")
    v.add_argument("--verbose", "-v", action="store_true", help="print warnings")
    r = commands.add_parser("report", help="print the reports of book directories")
    r.add_argument("folder")
    commands.add_parser("version")
    return parser.parse_args(argv)


def table(issues: DataFrame, where: str) -> None:
    """Issues as lines, for people."""
    rows = issues.select("book_id", "severity", "code", where).orderBy("book_id", "severity", "code", where)
    for r in rows.toLocalIterator():
        print(f"{r[1]:<8} {r[2]:<28} {r[0]}  {r[3] or ''}", file=sys.stderr)


def worst(issues: DataFrame) -> int:
    """The exit code of the worst book."""
    codes = R.rolled_up(issues).select(R.exit_code(F.col("status")).alias("code")).distinct()
    return max((r["code"] for r in codes.collect()), default=0)  # three rows at most


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    spark = spark or SparkSession.builder.appName("quire").getOrCreate()
    try:
        if args.command == "convert":
            books = C.convert(read_archives(spark, args.books), strict=args.strict)
            written = bookdir.write_directories(C.directory_files(books), args.output).select("book_id").distinct().count()
            table(R.visible(books.issues, args.verbose, args.debug), "message")
            print(f"{written} books in {args.output}")
            return worst(books.issues)
        if args.command == "inspect":
            rows = inspection.inspected(read_archives(spark, args.books))
            for r in rows.orderBy("book_id").toLocalIterator():
                told = json.loads(r["payload"])
                print(json.dumps(told, indent=2) if args.json else f"{told['title'] or told['source_filename']} ({told['epub_version']}): {', '.join(told['authors'])}; spine {len(told['spine'])}, nav {len(told['nav_toc'])}, ncx {len(told['ncx_toc'])}, issues {len(told['issues'])}, {told['status']}")
            return FATAL if rows.where("status = 'fatal'").count() else 0
        if args.command == "validate":
            files = bookdir.read_directories(spark, args.folder, everything=True)
            issues = validate.validate(files.select("book_id").distinct(), files)
            if args.json:
                for line in issues.toJSON().toLocalIterator():
                    print(line)
            else:
                table(R.visible(issues, args.verbose), "at")
            return worst(issues)
        reports = bookdir.read_directories(spark, args.folder).where("path = 'conversion-report.json'")
        found = 0
        for r in reports.orderBy("book_id").toLocalIterator():
            found += 1
            print(r["text"], end="")
        return 0 if found else FATAL
    except Exception as e:  # noqa: BLE001 - the exit code tells what kind it was
        if "PATH_NOT_FOUND" not in str(e):
            raise
        print(f"usage: no such path: {e}", file=sys.stderr)
        return USAGE


if __name__ == "__main__":
    sys.exit(main())
