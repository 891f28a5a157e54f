"""Issues, severities, status and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import VERSION
from .manifests import json_of

# Severities from least to most, and the status of the worst.
SEVERITIES = ("debug", "info", "warning", "error", "fatal")
STATUS = {"fatal": "fatal", "error": "completed_with_errors", "warning": "completed_with_warnings"}
# Warnings that strict mode treats as errors.
STRICT_CODES = ("LINK_UNRESOLVED", "ASSET_MISSING", "RENDER_MISSING_SOURCE")
# Names of the counters, by kind of event.
COUNTERS = {"document": "source_documents", "file": "generated_files", "image": "images_copied", "unresolved": "unresolved_links", "skipped": "assets_skipped"}


def rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int")


def status(worst: Column) -> Column:
    """Status of the highest rank of a report."""
    name = F.get(F.array(*map(F.lit, SEVERITIES)), worst - 1)
    out = F.lit("ok")
    for severity, value in reversed(STATUS.items()):
        out = F.when(name == severity, value).otherwise(out)
    return out


def rolled_up(issues: DataFrame, book: str = "book_id") -> DataFrame:
    """Per book: number of issues and status; counted before the shuffle, so one book with most issues is no hot key."""
    return issues.groupBy(book).agg(F.count(F.lit(1)).alias("issues"), status(F.max(rank(F.col("severity")))).alias("status"))


def exit_code(state: Column) -> Column:
    return F.when(state == "fatal", 2).when(state == "completed_with_errors", 1).otherwise(0)


def strict(issues: DataFrame) -> DataFrame:
    promoted = (F.col("severity") == "warning") & F.col("code").isin(*STRICT_CODES)
    return issues.withColumn("severity", F.when(promoted, "error").otherwise(F.col("severity")))


def visible(issues: DataFrame, verbose: bool = False, debug: bool = False) -> DataFrame:
    """Issues a console shows: errors and worse; warnings if verbose, what is less if debug."""
    n = rank(F.col("severity"))
    return issues.where((n >= 4) | (F.lit(verbose) & (n == 3)) | (F.lit(debug) & (n < 3)))


def stats(events: DataFrame, book: str = "book_id") -> DataFrame:
    """Counters of a conversion from tagged events (kind)."""
    return events.groupBy(book).agg(*(F.count_if(F.col("kind") == k).alias(v) for k, v in COUNTERS.items()))


def report_file(books: DataFrame, issues: DataFrame, events: DataFrame, book: str = "book_id") -> DataFrame:
    """book, report_json: status, issues and counters of every book."""
    state = books.select(book).join(rolled_up(issues, book), book, "left").join(stats(events, book), book, "left")
    listed = issues.groupBy(book).agg(F.sort_array(F.collect_list(F.struct("severity", "code", "message", F.col("message").alias("where")))).alias("list"))
    counters = F.struct(*(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS.values()))
    empty = F.array().cast("array<struct<severity:string,code:string,message:string,where:string>>")
    whole = F.struct(
        F.coalesce("status", F.lit("ok")).alias("status"), F.lit(VERSION).alias("tool_version"), F.struct(F.lit(None).cast("string").alias("epubcheck")).alias("source_validation"),
        F.coalesce("list", empty).alias("issues"), counters.alias("stats"),
    )
    return state.join(listed, book, "left").select(book, json_of(whole).alias("report_json"))
