"""Hot paths: call statistics by function, by call path or by inline chain (AGG1 to AGG4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathglass.functions.scalars import UNKNOWN, duration, shorten_path
from pathglass.operators.call_paths import call_paths, named
from pathglass.operators.quantiles import nearest_ranks
from pathglass.operators.self_time import with_self_times
from pathglass.storage import cut

#: A 99th percentile needs this many calls.
P99_CALLS = 1_000


def contained(start_ns: int | None, end_ns: int | None) -> Column:
    """Whether a span lies within the window; a bound needs both of the span's times."""
    inside = F.lit(True)
    if start_ns is not None:
        inside = inside & (F.col("start_ns") >= start_ns)
    if end_ns is not None:
        inside = inside & (F.col("end_ns") <= end_ns)
    if start_ns is not None or end_ns is not None:
        inside = inside & F.col("start_ns").isNotNull() & F.col("end_ns").isNotNull()
    return F.coalesce(inside, F.lit(False))


def hotpaths(spans: DataFrame, functions: DataFrame, group: str = "function", depth: int = 0, thread: str | None = None, contains: str | None = None, start_ns: int | None = None, end_ns: int | None = None, own: bool = True) -> DataFrame:
    """A row for each function or call path: entries, calls, sums, percentiles.

    Every span of the thread with a matching name is an entry, in the window or
    not. Complete spans within the window are calls and carry the sums; sums
    over nothing are null. ``contains`` looks at the path as shown. Without ``own``
    neither self times nor percentiles are computed nor given.
    """
    spans = spans.select("id", *([] if thread is None else ["thread"]), "function", "parent", "start_ns", "end_ns", "completeness")
    kept = spans if thread is None else spans.filter(F.col("thread") == thread)
    if group == "path":
        rows = call_paths(spans, functions)
        rows = (rows if thread is None else rows.filter(F.col("thread") == thread)).withColumn("path", shorten_path(F.col("path"), depth))
    else:
        rows = named(kept, functions).withColumn("path", F.coalesce("name", F.lit(UNKNOWN)))
    if contains is not None:
        rows = rows.filter(F.col("path").contains(contains))
    called = F.col("completeness").eqNullSafe("complete") & contained(start_ns, end_ns)
    sums = {
        "observed_entries": F.count(F.lit(1)),
        "complete_calls": F.count_if("called"),
        "inclusive_sum_ns": F.sum("inclusive"),
        "self_sum_ns": F.sum("own"),
        "excluded_incomplete": F.count_if(~F.col("called")),
        "n_eligible": F.count("inclusive"),
    }
    measures = {"called": called, "inclusive": F.when(called, duration(F.col("start_ns"), F.col("end_ns")))}
    if not own:
        return rows.select("path", *(c.alias(n) for n, c in measures.items())).groupBy("path").agg(*(c.alias(n) for n, c in sums.items() if n != "self_sum_ns"))
    # Self times look at all children, also those of other names.
    rows = with_self_times(rows.select("id", "path", "completeness", "start_ns", "end_ns"), spans)
    # Three aggregations read these few columns.
    rows = cut(rows.select("path", *(c.alias(n) for n, c in measures.items()), F.when(called, F.col("self_ns")).alias("own")), "calls")
    sums = rows.groupBy("path").agg(*(c.alias(n) for n, c in sums.items()))
    ranks = nearest_ranks(rows.select("path", F.col("inclusive").alias("value")), "path", (50, 95, 99))
    out = sums.join(ranks, "path", "left")
    return out.withColumn("p99", F.when(F.col("n_eligible") >= P99_CALLS, F.col("p99")))


def hotpaths_inline(inline_rows: DataFrame, functions: DataFrame, depth: int = 0, thread: str | None = None, contains: str | None = None) -> DataFrame:
    """A row for each symbol with its inline chain, outermost first: blocks, instructions, time.

    ``contains`` looks at the whole chain, before it is shortened to ``depth`` names.
    A sum that no long holds is null; the other sums and rows stand.
    """
    rows = inline_rows if thread is None else inline_rows.filter(F.col("thread") == thread)
    rows = named(rows, functions)
    names = F.concat(F.array(F.coalesce("name", F.lit(UNKNOWN))), F.reverse(F.coalesce("chain", F.array().cast("array<string>"))))
    rows = rows.withColumn("full", F.array_join(names, " > "))
    if contains is not None:
        rows = rows.filter(F.col("full").contains(contains))
    # The symbol and that many names of its chain.
    short = F.array_join(F.slice(names, 1, depth + 1), " > ") if depth > 0 else F.col("full")
    return rows.withColumn("path", short).groupBy("path").agg(
        F.try_sum("blocks").alias("observed_entries"),
        F.lit(0).cast("long").alias("complete_calls"),
        F.try_sum("elapsed_ns").alias("self_sum_ns"),
        F.try_sum("blocks").alias("n_eligible"),
        F.try_sum("instructions").alias("instructions"),
    )


SORTS = {
    "inclusive": ("inclusive_sum_ns",),
    "self_time": ("self_sum_ns", "inclusive_sum_ns"),
    "calls": ("observed_entries",),
}


def sort_order(sort: str, inline: bool = False) -> list[Column]:
    """Falling measures, nulls last, then the path."""
    if inline:
        by = ("self_sum_ns",) if sort == "self_time" else ("instructions",)
    else:
        by = SORTS[sort]
    return [F.desc_nulls_last(c) for c in by] + [F.asc("path")]


def totals(rows: DataFrame) -> DataFrame:
    """One row of sums over all result rows, before any paging."""
    columns = {"self_sum_ns": "self_sum_ns", "inclusive_sum_ns": "inclusive_sum_ns", "complete_calls": "complete_calls", "instructions": "instructions"}
    return rows.agg(*((F.sum(c) if c in rows.columns else F.lit(None).cast("long")).alias(name) for name, c in columns.items()))
