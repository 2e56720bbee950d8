"""The whole analysis: blocks in, issues and reports out."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import SparkContext, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reflume.operators import bibliography, citations, matching, rules
from reflume.plans import store
from reflume.schema import SEVERITIES, STAGES

#: What numbers() takes of a citation.
NUMERIC = ("doc_id", "block_ord", "block_id", "paragraph_index", "kind", "family", "tokens", "reason", "nth")
#: Seconds that the analysis of one document may take by default.
SECONDS = 30.0


class TimeBudgetExceededError(Exception):
    """A run took longer than it may."""


@dataclass
class Options:
    enabled: Sequence[str] | None = None
    severity_overrides: Mapping[str, str] | None = None
    custom_rules: Sequence[rules.Rule] = ()
    weights: matching.Weights = matching.Weights()
    bibliography_blocks: DataFrame | None = None  # doc_id, block_ids


def analyse(blocks: DataFrame, options: Options = Options(), keep: bool = True) -> rules.Context:
    """All tables of an analysis. Blocks are dealt by document once; every later join and window keeps that.

    keep: hold the tables that several rules read (memory first, then disk), so
    that texts are read and matched once; release() lets go of them.
    """
    held: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        if keep:
            held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    blocks = hold(blocks.repartition("doc_id"))
    documents, section = bibliography.bibliography(blocks, options.bibliography_blocks)
    documents = hold(documents)
    entries = hold(bibliography.parse_entries(bibliography.entry_blocks(blocks, section)))
    extracted = hold(citations.extract(blocks))
    cited = hold(citations.numbered(extracted))
    matches = hold(matching.combine(cited, matching.match_items(cited, entries, options.weights)))
    status, tokens = matching.entry_status(entries, matches), matching.numeric_tokens(cited, entries)
    return rules.Context(blocks, documents, cited, extracted.where("kind = 'invalid'"), entries, matches, status, tokens, held)


#: What a store may hold of an analysis, in the order in which one is made from others.
TABLES = ("entries", "citations", "matches")


def stored(blocks: DataFrame, tables: Sequence[str] = TABLES, options: Options = Options()) -> rules.Context:
    """The analysis with the named tables written to the shared folder and read from there.

    So plans stay short however many rules read a table, each reads the columns
    it needs, and nothing hangs on how long a result is held. The files go when
    the driver ends. blocks: best dealt by document already; they are read once
    for each table.
    """
    folder = store.folder(blocks.sparkSession)

    def put(df: DataFrame, name: str) -> DataFrame:
        return store.write(df, f"{folder}/{name}") if name in tables else df

    documents, section = bibliography.bibliography(blocks, options.bibliography_blocks)
    entries = put(bibliography.parse_entries(bibliography.entry_blocks(blocks, section)), "entries")
    cited = put(citations.numbered(citations.extract(blocks, ("author-date", "numeric"))), "citations")
    matches = put(matching.combine(cited, matching.match_items(cited, entries, options.weights)), "matches")
    status, tokens = matching.entry_status(entries, matches), matching.numeric_tokens(cited, entries)
    return rules.Context(blocks, documents, cited, citations.extract(blocks, ("invalid",)), entries, matches, status, tokens)


def numbers(blocks: DataFrame) -> rules.Context:
    """The analysis of numeric citations alone: neither entries are read nor names matched. Citations are numbered among the numeric ones."""
    documents, section = bibliography.bibliography(blocks)
    listed = bibliography.entry_blocks(blocks, section)
    cited = citations.numbered(citations.extract(blocks, ("numeric",), NUMERIC))
    return rules.Context(blocks, documents, cited, citations.extract(blocks, ("invalid",)), listed, None, None, matching.numeric_tokens(cited, listed))


def release(ctx: rules.Context) -> None:
    """Lets go of the tables that analyse() holds, those made from others first."""
    while ctx.held:
        ctx.held.pop().unpersist(blocking=True)


def lint(blocks: DataFrame, options: Options = Options()) -> DataFrame:
    """Ordered issues of all documents."""
    return rules.ordered(rules.run_rules(analyse(blocks, options), options.enabled, options.severity_overrides, options.custom_rules))


@contextmanager
def time_budget(sc: SparkContext, seconds: float | None) -> Iterator[Callable[[str], None]]:
    """Gives a function that raises TimeBudgetExceededError once the time is over; jobs that run by then are cancelled."""
    if seconds is None:
        yield lambda label: None
        return
    tag, late = f"reflume-{uuid.uuid4().hex}", time.monotonic() + seconds

    def check(label: str) -> None:
        if time.monotonic() > late:
            raise TimeBudgetExceededError(f"processing time budget exceeded at {label}")

    timer = threading.Timer(seconds, sc.cancelJobsWithTag, [tag])
    timer.daemon = True
    timer.start()
    sc.addJobTag(tag)
    try:
        yield check
    except TimeBudgetExceededError:
        raise
    except Exception as e:  # a cancelled job's error, or another one in time
        if time.monotonic() > late:
            raise TimeBudgetExceededError("processing time budget exceeded within a job") from e
        raise
    finally:
        sc.removeJobTag(tag)
        timer.cancel()


def run(
    blocks: DataFrame, options: Options = Options(), on_stage: Callable[[str], None] | None = None, seconds: float | None = None
) -> tuple[rules.Context, DataFrame]:
    """The analysis and its ordered issues, worked out stage by stage.

    on_stage is told the name of each stage as it begins. seconds: None, or what
    all stages together may take; TimeBudgetExceededError beyond it. The tables
    are held until release().
    """
    say = on_stage or (lambda stage: None)
    with time_budget(blocks.sparkSession.sparkContext, seconds) as check:
        ctx = analyse(blocks, options)
        try:
            for stage, table in zip(STAGES, (ctx.blocks, ctx.documents, ctx.citations, ctx.matches, None), strict=True):
                check(stage)
                say(stage)
                if table is None:
                    table = rules.ordered(rules.run_rules(ctx, options.enabled, options.severity_overrides, options.custom_rules))
                    ctx.held.append(table.persist(StorageLevel.MEMORY_AND_DISK))
                table.write.format("noop").mode("overwrite").save()
            check("the end")
        except Exception:
            release(ctx)
            raise
    return ctx, table


def severity_counts(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """doc_id and the number of issues of each severity, zeros kept."""
    per = issues.groupBy("doc_id").agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES))
    return documents.select("doc_id").join(per, "doc_id", "left").select("doc_id", *(F.coalesce(F.col(s.lower()), F.lit(0)).alias(s.lower()) for s in SEVERITIES))
