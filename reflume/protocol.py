"""Analyses asked for by messages: requests, replies, errors in plain words, and the state of runs.

A request has an id that all of its replies carry. Of several runs of a session
only the newest counts: replies to older ones may still come and are passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reflume.operators import report
from reflume.plans import lint
from reflume.sources import docx

#: What each error is told as, and the key of the advice beneath it.
ERRORS = {
    "NotADocxError": ("This file does not look like a DOCX document. Try a .docx file exported from Word or Google Docs.", "error.guidance.not-docx"),
    "ZipBombError": ("This document was rejected for safety — it exceeds the size limits.", "error.guidance.oversize"),
    "ParseFailureError": ("The document could not be parsed.", "error.guidance.parse-failure"),
    "UnsupportedFormatError": ("This DOCX uses an unsupported format (encryption or unknown compression).", "error.guidance.unsupported"),
    "TimeBudgetExceededError": ("The analysis took too long and was stopped to keep the app responsive.", "error.guidance.time-budget"),
}
GENERIC = "error.guidance.generic"


def describe(name: str) -> str:
    """An error's name in plain words."""
    return ERRORS[name][0] if name in ERRORS else f"Unexpected error: {name}"


def guidance_key(name: str) -> str:
    return ERRORS[name][1] if name in ERRORS else GENERIC


def error_of(e: object) -> dict[str, str]:
    """name and message of an error, or of a reply's error as it came; names that are not known become Error."""
    if isinstance(e, dict):
        name, message = e.get("name"), e.get("message")
        if isinstance(name, str) and isinstance(message, str):
            return {"name": name, "message": message}
        return {"name": name if name in ERRORS else "Error", "message": str(e)}
    name = getattr(e, "name", None) if isinstance(e, docx.PackageError) else type(e).__name__
    return {"name": name if name in ERRORS else "Error", "message": str(e)}


def request(id: str, data: bytes, file: str, bibliography: Sequence[str] | None = None) -> dict:
    """A request for an analysis; bibliography: ids of the blocks to take for it, where they were picked by hand."""
    out = {"id": id, "type": "analyze", "bytes": data, "fileName": file}
    return out if bibliography is None else out | {"bibliographyBlockIds": list(bibliography)}


def is_kind(message: dict, kind: str) -> bool:
    """Whether a reply is of a kind: stage, done or error."""
    return message.get("type") == kind


def handle(spark: SparkSession, message: dict, reply: Callable[[dict], None], options: lint.Options = lint.Options(), seconds: float | None = lint.SECONDS) -> None:
    """Replies to a request: stage as each stage begins, then done with the report, or error."""
    own = {"id": message["id"]}
    ctx = None
    try:
        file, ids = message["fileName"], message.get("bibliographyBlockIds")
        row = docx.parse(file, message["bytes"])
        if row["error"]:
            raise docx.PackageError(row["error"]["name"], row["error"]["detail"])
        blocks = docx.blocks(docx.parse_packages(spark.createDataFrame([(file, bytearray(message["bytes"]))], "doc_id string, content binary")))
        if ids is not None:
            picked = spark.createDataFrame([(file, list(ids))], "doc_id string, block_ids array<string>")
            options = lint.Options(**{**vars(options), "bibliography_blocks": picked})
        ctx, issues = lint.run(blocks, options, lambda stage: reply(own | {"type": "stage", "stage": stage}), seconds)
        ran = lint.rules.active_rules(options.enabled, options.custom_rules)
        rows = report.report_rows(ctx, issues).collect()
        done = report.report(rows[0].asDict(recursive=True), file, ran) if rows else report.empty_report(file, ran)
        last = {"type": "done", "report": done}
    except Exception as e:  # a reply says what went wrong
        last = {"type": "error", "error": error_of(e)}
    finally:
        if ctx is not None:
            lint.release(ctx)
    reply(own | last)


def run_states(events: DataFrame) -> DataFrame:
    """session, generation, status (idle, analyzing, done, error) and stages of each session's newest run.

    events: session, seq, generation, kind (start, stage, done, error, reset), stage.
    What older runs still send, whenever it comes, changes nothing.
    """
    newest = F.max("generation").over(Window.partitionBy("session"))
    rows = events.withColumn("newest", newest).where("generation = newest")
    last = F.max_by("kind", F.struct(F.col("kind").isin("done", "error", "reset"), "seq"))
    status = F.when(last == "reset", "idle").when(last.isin("done", "error"), last).otherwise("analyzing")
    stages = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "stage", F.struct("seq", "stage")))), lambda x: x["stage"])
    return rows.groupBy("session", "generation").agg(status.alias("status"), stages.alias("stages"))
