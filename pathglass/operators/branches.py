"""Instruction rows: branch outcomes, branch sites, inline profiles, block attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathglass.functions.scalars import address_hex

CONDITIONAL = ("conditional",)
INDIRECT = ("indirect_jump", "indirect_call")

#: A block is ignored if it would span more bytes.
MAX_BLOCK = 1 << 20


def with_next(instructions: DataFrame) -> DataFrame:
    """``instructions`` with ``next_ip`` (JN12): where the thread went on, null if its next row is not the next in sequence."""
    order = Window.partitionBy("thread").orderBy("id")
    follows = F.lead("sequence").over(order) == F.col("sequence") + 1
    return instructions.withColumn("next_ip", F.when(follows, F.lead("virt_ip").over(order)))


def branch_sites(instructions: DataFrame) -> DataFrame:
    """A row for each address with conditional or indirect branches (AGG5).

    Counts of the outcomes of conditionals, the share taken of those known as text
    with six decimals (null if none is), the first symbol, and the distinct targets
    of indirect branches in the order they were first seen. An indirect branch went
    where the thread's next instruction is; one without a next counts nowhere.
    """
    indirect = F.col("kind").isin(*INDIRECT)
    rows = with_next(instructions).filter((F.col("kind") == "conditional") | (indirect & F.col("next_ip").isNotNull()))
    count = lambda what: F.count_if((F.col("kind") == "conditional") & F.coalesce(F.col("outcome") == what, F.lit(what == "unknown")))
    # First sightings combine before the shuffle: no list of all rows of a hot site.
    firsts = rows.filter(indirect).groupBy("virt_ip", "next_ip").agg(F.min("id").alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "next_ip")))
    targets = firsts.groupBy("virt_ip").agg(F.transform(ordered, lambda s: address_hex(s["next_ip"])).alias("indirect_targets"))
    sites = rows.groupBy("virt_ip").agg(
        F.min_by("symbol", F.when(F.col("symbol").isNotNull(), F.col("id"))).alias("symbol"),
        count("taken").alias("taken"),
        count("not_taken").alias("not_taken"),
        count("unknown").alias("unknown"),
    )
    known = F.col("taken") + F.col("not_taken")
    fraction = F.bround(F.col("taken").cast("decimal(19,0)") / known.cast("decimal(19,0)"), 6).cast("decimal(8,6)").cast("string")
    out = sites.join(targets, "virt_ip", "left")
    return out.select(
        address_hex(F.col("virt_ip")).alias("site"),
        "symbol",
        "taken",
        "not_taken",
        "unknown",
        F.when(known > 0, fraction).alias("taken_fraction"),
        F.coalesce("indirect_targets", F.array().cast("array<string>")).alias("indirect_targets"),
    )


def site_order() -> list[Column]:
    """Most executed conditionals first, then the site's text (SRT4)."""
    return [F.desc(F.col("taken") + F.col("not_taken") + F.col("unknown")), F.asc("site")]


def inline_profile(instructions: DataFrame) -> DataFrame:
    """By symbol and innermost inlined function: instructions, share, addresses (AGG6); nulls group."""
    counts = instructions.groupBy("symbol", "inlined", "virt_ip").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy("symbol", "inlined").agg(F.sum("n").alias("instructions"), F.count("virt_ip").alias("distinct_addresses"), F.min("virt_ip").alias("first"))
    total = rows.agg(F.sum("instructions").alias("total"))
    share = F.col("instructions").cast("double") / F.col("total")
    # One row against a few: the grand total.
    return rows.join(F.broadcast(total)).select("symbol", "inlined", "instructions", share.alias("fraction"), "distinct_addresses", address_hex(F.col("first")).alias("first_address"))


def outcomes(samples: DataFrame) -> DataFrame:
    """``samples`` with sequence and outcome (WIN1, WIN2).

    Samples are (pid, tid, seq, is_error, ip, kind, branch_target, fallthrough). A
    conditional is taken if the thread's next sample is at its target, not taken if
    at the fallthrough; unknown at the end, across a decoder error, at any other
    address, or if target and fallthrough are one. Error rows count in the sequence
    behind the thread's first sample, and are dropped.
    """
    order = Window.partitionBy("pid", "tid").orderBy("seq")
    begun = F.max(~F.col("is_error")).over(order)
    rows = samples.withColumn("begun", begun.cast("long")).withColumn("sequence", F.sum("begun").over(order)).drop("begun")
    rows = rows.withColumn("next_ip", F.lead("ip").over(order)).withColumn("next_error", F.lead("is_error").over(order))
    lost = F.coalesce("next_error", F.lit(True)) | F.coalesce(F.col("branch_target") == F.col("fallthrough"), F.lit(False))
    outcome = F.when(lost, "unknown").when(F.col("next_ip") == F.col("branch_target"), "taken").when(F.col("next_ip") == F.col("fallthrough"), "not_taken").otherwise("unknown")
    rows = rows.withColumn("outcome", F.when(F.col("kind") == "conditional", outcome))
    return rows.filter(~F.col("is_error")).drop("next_ip", "next_error", "is_error")


def windowed_outcomes(samples: DataFrame, start_ns: int, end_ns: int, slack_ns: int = 1_000_000) -> DataFrame:
    """Outcomes of a half-open window; reading goes on a little so that its last conditional resolves (FLT13)."""
    near = samples.filter((F.col("time_ns") >= start_ns) & (F.col("time_ns") < end_ns + slack_ns))
    return outcomes(near).filter(F.col("time_ns") < end_ns)


def straight_blocks(branches: DataFrame) -> DataFrame:
    """Blocks run between branches (WIN3): (thread, start, end, elapsed_ns).

    A block runs from the thread's previous branch target to this branch's address;
    none follows a boundary, and none that would run backwards or too far counts.
    ``branches`` is (thread, seq, time_ns, from_ip, to_ip, breaks).
    """
    order = Window.partitionBy("thread").orderBy("seq")
    rows = branches.select("thread", F.lag("to_ip").over(order).alias("start"), F.col("from_ip").alias("end"), (F.col("time_ns") - F.lag("time_ns").over(order)).alias("elapsed_ns"), F.lag("breaks").over(order).alias("broken"))
    fits = (F.col("end") >= F.col("start")) & (F.col("end") - F.col("start") <= MAX_BLOCK)
    return rows.filter(~F.col("broken") & fits).select("thread", "start", "end", F.greatest(F.coalesce("elapsed_ns", F.lit(0)), F.lit(0)).alias("elapsed_ns"))


def attribute_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks that know function, chain and instructions, summed (AGG7)."""
    sums = blocks.groupBy("thread", "function", "chain").agg(F.sum("instructions").alias("instructions"), F.count(F.lit(1)).alias("blocks"), F.sum("elapsed_ns").alias("elapsed_ns"))
    return sums
