"""Schema contracts as columns: each gives the errors of a row as "path: message; path: message", empty if it is valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: UTC times only: an offset other than Z is refused.
ISO_Z = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"


def format_issues(issues: Column) -> Column:
    """array of struct(path, message) on one line; a message without a path stands alone."""
    path = lambda x: F.when(x["path"] != "", F.concat(x["path"], F.lit(": "))).otherwise("")
    return F.array_join(F.transform(issues, lambda x: F.concat(path(x), x["message"])), "; ")


def issues(*checks: tuple[str, Column, str]) -> Column:
    """Those of (path, failed, message) that failed; a check that is null has not failed."""
    each = F.array(*(F.when(failed, F.struct(F.lit(path).alias("path"), F.lit(message).alias("message"))) for path, failed, message in checks))
    return F.filter(each, lambda x: x.isNotNull())


def split(df: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``errors``)."""
    marked = df.withColumn("errors", errors)
    return marked.where("errors = ''").drop("errors"), marked.where("errors <> ''")


def _missing(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def segment_errors() -> Column:
    return format_issues(issues(
        ("speaker", _missing(F.col("speaker")), "empty"), ("start_ms", F.col("start_ms").isNull() | (F.col("start_ms") < 0), "negative"),
        ("end_ms", F.col("end_ms") < F.col("start_ms"), "before start_ms"), ("end_ms", F.col("end_ms").isNull() | (F.col("end_ms") < 0), "negative")))
