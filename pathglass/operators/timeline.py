"""The timeline: spans that intersect a window, in order of their start (Q3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathglass.functions.scalars import duration
from pathglass.operators.call_paths import named

#: Stands for a bound or an end that is not known.
FOREVER = (1 << 63) - 1


def timeline(spans: DataFrame, functions: DataFrame, thread: str | None = None, start_ns: int | None = None, end_ns: int | None = None, min_duration_ns: int | None = None, contains: str | None = None) -> DataFrame:
    """Matching spans with name, duration (complete ones only) and whether the window clips them.

    The window is half open. A span of unknown start counts from 0, one of unknown
    end to the end of time, so a span that ends at 0 never matches. A minimum
    duration drops spans of unknown duration, a name filter those without a name.
    """
    low, high = start_ns or 0, FOREVER if end_ns is None else end_ns
    rows = spans if thread is None else spans.filter(F.col("thread") == thread)
    rows = rows.filter((F.coalesce("start_ns", F.lit(0)) < high) & (F.coalesce("end_ns", F.lit(FOREVER)) > low))
    if min_duration_ns is not None:
        rows = rows.filter(F.col("end_ns") - F.col("start_ns") >= min_duration_ns)
    rows = named(rows, functions)
    if contains is not None:
        rows = rows.filter(F.col("name").contains(contains))
    never = F.lit(False)
    before = F.coalesce(F.col("start_ns") < start_ns, never) if start_ns is not None else never
    behind = F.coalesce(F.col("end_ns") > end_ns, never) if end_ns is not None else never
    return rows.select(
        "id",
        "thread",
        F.col("name").alias("function"),
        "start_ns",
        "end_ns",
        F.when(F.col("completeness") == "complete", duration(F.col("start_ns"), F.col("end_ns"))).alias("duration_ns"),
        "completeness",
        (before | behind).alias("clipped"),
    )


def timeline_order(analysis: str = "a") -> list:
    """By start, unknown first, then by the span's id as text."""
    return [F.asc_nulls_first("start_ns"), F.concat(F.lit(f"{analysis}:sp"), F.col("id").cast("string")).asc()]


def selected(rows: DataFrame, thread: str | None = None, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Instruction rows of a thread at half-open times; unknown times only without bounds (FLT5)."""
    rows = rows if thread is None else rows.filter(F.col("thread") == thread)
    if start_ns is not None:
        rows = rows.filter(F.col("time_ns") >= start_ns)
    return rows if end_ns is None else rows.filter(F.col("time_ns") < end_ns)
