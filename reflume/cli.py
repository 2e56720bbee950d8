"""Command line: reports of .docx files.

python -m reflume.cli PATH [-d | -j | --format text|detailed|json|html] [--enable author-date|numeric] [--severity RULE=LEVEL]
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from reflume.operators import report, rules
from reflume.plans.lint import Options, analyse, release
from reflume.sources import docx

FORMATS = {"text": report.render_text, "detailed": report.render_detailed, "json": report.serialize, "html": report.render_html}


def reports(spark: SparkSession, path: str, options: Options = Options()) -> list[dict]:
    """The report of every file that path names, by file; unreadable and missing files have an error report."""
    try:
        parsed = docx.read_docx(spark, path).cache()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return [report.error_report(path, "FileNotFoundError", path)]
    ctx = analyse(docx.blocks(parsed), options)
    issues = rules.ordered(rules.run_rules(ctx, options.enabled, options.severity_overrides, options.custom_rules))
    ran = rules.active_rules(options.enabled, options.custom_rules)
    out = [report.report(r.asDict(recursive=True), rule_ids=ran) for r in report.report_rows(ctx, issues).collect()]
    have = {r["meta"]["file"] for r in out}
    for row in parsed.select("doc_id", "error").collect():
        if row.error is not None:
            out.append(report.error_report(row.doc_id, row.error.name, row.error.detail))
        elif row.doc_id not in have:  # a package without blocks
            out.append(report.empty_report(row.doc_id, ran))
    release(ctx)
    parsed.unpersist()
    return sorted(out, key=lambda r: r["meta"]["file"])


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(
        prog="reflume", description="Checks that the citations of .docx manuscripts and their bibliographies agree.",
        epilog="Exit codes: 0 no issue, 1 issues found, 2 a document could not be read, 3 a document has an unsupported format.",
    )
    out.add_argument("path", help="a .docx file, or any path that Spark reads")
    shape = out.add_mutually_exclusive_group()
    shape.add_argument("--format", choices=sorted(FORMATS), default="text")
    shape.add_argument("-d", "--detailed", dest="format", action="store_const", const="detailed", help="all issues with their evidence")
    shape.add_argument("-j", "--json", dest="format", action="store_const", const="json", help="the report as JSON")
    out.add_argument("--enable", action="append", choices=sorted(rules.SEGMENTS))
    out.add_argument("--severity", action="append", default=[], metavar="RULE=LEVEL")
    out.add_argument("-v", "--version", action="version", version=report.PROGRAM)
    return out


def main(argv: Sequence[str] | None = None) -> int:
    given = parser().parse_args(argv)
    overrides = dict(s.split("=", 1) for s in given.severity if "=" in s)
    spark = SparkSession.builder.appName("reflume").getOrCreate()
    found = reports(spark, given.path, Options(enabled=given.enable, severity_overrides=overrides))
    for value in found:
        if "error" in value:
            sys.stderr.write(f"reflume: {value['meta']['file']}: {value['error']['message']}\n")
        if "error" not in value or given.format == "json":
            sys.stdout.write(FORMATS[given.format](value))
    return max((report.exit_code(value) for value in found), default=0)


if __name__ == "__main__":
    sys.exit(main())
