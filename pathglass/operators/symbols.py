"""Addresses to mappings, functions and inline frames: range and as-of joins (JN4 to JN8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathglass.storage import counted, cut

#: Ranges are covered by pages of 2**PAGE_BITS bytes: a probe is compared with what begins or ends in its own.
PAGE_BITS = 12
#: Blocks of a cover double up to the whole address space.
LEVELS = 64 - PAGE_BITS
#: As-of joins are carried over pages of 2**CARRY_BITS bytes, and so of as many addresses at most.
CARRY_BITS = 16


def cover(low: Column, high: Column) -> Column:
    """The pages of [low, high) as aligned blocks of 2**level pages, at most two a level: structs (level, block)."""
    first, behind = F.shiftright(low, PAGE_BITS), F.shiftright(high - 1, PAGE_BITS) + 1

    def at(level: Column) -> Column:
        left = -F.call_function("shiftright", -first, level)
        right = F.call_function("shiftright", behind, level)
        odd = lambda x: x.bitwiseAND(1) == 1
        block = lambda x: F.struct(level.alias("level"), x.alias("block"))
        none = F.array().cast("array<struct<level:int,block:bigint>>")
        return F.when(left >= right, none).otherwise(F.concat(F.when(odd(left), F.array(block(left))).otherwise(none), F.when(odd(right), F.array(block(right - 1))).otherwise(none)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), at))


def within(probes: DataFrame, ranges: DataFrame, keys: tuple[str, ...], at: str, low: str, high: str) -> DataFrame:
    """``probes`` joined with every range [low, high) of their keys that holds ``at``.

    A range of any width is covered by a few aligned blocks, and a probe lies in one
    block of each level, so both meet by an equi-join: a row for each level that the
    ranges use and probe, of which there are at most LEVELS.
    """
    covers = ranges.filter(F.col(high) > F.col(low)).withColumn("__c", F.explode(cover(F.col(low), F.col(high))))
    covers = cut(covers.select(*ranges.columns, F.col("__c.level").alias("__level"), F.col("__c.block").alias("__block")), "covers")
    levels = sorted(r["__level"] for r in covers.select("__level").distinct().collect())
    rows = probes.withColumn("__level", F.explode(F.array(*map(F.lit, levels or [0]))))
    rows = rows.withColumn("__block", F.expr(f"shiftright({at}, __level + {PAGE_BITS})"))
    met = rows.join(counted(covers), [*keys, "__level", "__block"])
    return met.filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__level", "__block")


def map_addresses(samples: DataFrame, mappings: DataFrame, keys: tuple[str, ...] = ("pid",)) -> DataFrame:
    """``samples`` (id, keys, ip, seq) with the mapping that holds them (JN4).

    A mapping (keys, start, end, generation, seq, path...) applies to samples behind
    it; of several the newest generation wins. With a column ``upto`` a mapping must
    hold that address too.
    """
    own = [c for c in mappings.columns if c not in (*keys, "start", "end", "seq", "generation")]
    m = mappings.select(*keys, F.col("start").alias("m_start"), F.col("end").alias("m_end"), F.col("seq").alias("m_seq"), "generation", *own)
    found = within(samples, m, keys, "ip", "m_start", "m_end").filter(F.col("m_seq") <= F.col("seq"))
    if "upto" in samples.columns:
        found = found.filter(F.col("upto") < F.col("m_end"))
    best = F.max_by(F.struct("m_start", "m_end", "generation", *own), F.col("generation")).alias("m")
    hits = found.groupBy("id").agg(best)
    out = samples.join(hits, "id", "left")
    return out.select(*samples.columns, F.col("m.m_start").alias("map_start"), F.col("m.generation").alias("generation"), *(F.col(f"m.{c}").alias(c) for c in own))


def symbolize(probes: DataFrame, functions: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """``probes`` (keys, address...) with the nearest function at or below (JN5).

    As of the address: the last function that starts there or before, if the address
    lies before its end. An address behind the end of the nearest one has none,
    though an earlier, longer one may span it. Both sides become one sequence in
    which each address carries on the last start seen; long sequences are cut at
    pages, with the last start before a page carried over. Addresses are made
    distinct first, so no page holds more than it has bytes.
    """
    asked = cut(probes.select(*keys, "address").filter("address is not null").distinct(), "asked")
    pages = (*keys, "page")
    starts = functions.select(*keys, F.col("start").alias("at"), F.lit(0).alias("side"), F.struct("start", "id", "name", "end").alias("f"))
    # Of functions at one address the smallest id goes.
    starts = starts.groupBy(*keys, "at", "side").agg(F.min_by("f", "f.id").alias("f"))
    starts = starts.withColumn("page", F.shiftright("at", CARRY_BITS))
    rows = asked.withColumn("at", F.col("address")).withColumn("side", F.lit(1)).withColumn("page", F.shiftright("address", CARRY_BITS))
    used = rows.select(*pages).distinct()
    ends = starts.groupBy(*pages).agg(F.max_by("f", "at").alias("f"))
    # For every page in use, the last start of an earlier page: over pages, not rows.
    along = used.withColumn("f", F.lit(None).cast(starts.schema["f"].dataType)).unionByName(ends)
    before = Window.partitionBy(*keys).orderBy("page").rangeBetween(Window.unboundedPreceding, -1)
    carried = along.withColumn("f", F.last("f", ignorenulls=True).over(before)).select(*pages, "f").filter("f is not null").dropDuplicates(list(pages))
    heads = carried.withColumn("at", F.shiftleft(F.col("page"), CARRY_BITS)).withColumn("side", F.lit(-1))
    both = rows.withColumn("f", F.lit(None).cast(starts.schema["f"].dataType)).unionByName(starts, allowMissingColumns=True).unionByName(heads, allowMissingColumns=True)
    order = Window.partitionBy(*pages).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("g", F.last("f", ignorenulls=True).over(order)).filter("side = 1")
    hit = F.col("address") < F.col("g.end")
    found = both.filter(hit).select(*keys, "address", F.col("g.id").alias("function"), F.col("g.name").alias("symbol"), (F.col("address") - F.col("g.start")).alias("offset"))
    out = probes.join(counted(cut(found, "symbols")), [*keys, "address"], "left")
    return out.select(*probes.columns, "function", "symbol", "offset")


def inline_frames(addresses: DataFrame, ranges: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """``addresses`` (id, keys, address, symbol) with frames and the innermost inlined function (JN8).

    ``ranges`` is (keys, lo, hi, frames), frames innermost first; the shortest range
    that holds an address wins. The innermost is null if it is the symbol itself.
    Distinct addresses are looked up, however many rows have them.
    """
    asked = cut(addresses.select(*keys, "address").filter("address is not null").distinct(), "asked")
    rows = within(asked, ranges.select(*keys, "lo", "hi", "frames"), keys, "address", "lo", "hi")
    best = rows.groupBy(*keys, "address").agg(F.min_by("frames", F.struct(F.col("hi") - F.col("lo"), "lo")).alias("frames"))
    out = addresses.join(counted(cut(best, "inlined")), [*keys, "address"], "left").select(*addresses.columns, "frames")
    inner = F.get(F.col("frames"), F.lit(0))["function"]
    return out.withColumn("inlined", F.when(~inner.eqNullSafe(F.col("symbol")), inner))


def file_offset_address(probes: DataFrame, segments: DataFrame) -> DataFrame:
    """``probes`` (id, image_id, file_offset) with the image address of their segment (JN6), the first that holds them."""
    held = segments.select("image_id", "file_off", (F.col("file_off") + F.col("file_size")).alias("file_end"), "vaddr")
    rows = within(probes.select("id", "image_id", "file_offset"), held, ("image_id",), "file_offset", "file_off", "file_end")
    first = rows.groupBy("id").agg(F.min_by(F.col("file_offset") - F.col("file_off") + F.col("vaddr"), "file_off").alias("address"))
    return probes.join(first, "id", "left")
