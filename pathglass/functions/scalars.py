"""Identifiers, addresses, names, times and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest integer that a JSON number carries exactly.
MAX_NS = (1 << 53) - 1

#: Separator and mark of names that are joined into one path.
PATH_SEPARATOR, TRUNCATED, UNKNOWN = "/", "...", "<unknown>"


def address_hex(address: Column) -> Column:
    """``0x`` and lower-case digits."""
    return F.concat(F.lit("0x"), F.lower(F.hex(address)))


def parse_address(text: Column) -> Column:
    """Hexadecimal with or without ``0x``; null if it is none or does not fit a signed long."""
    digits = F.regexp_extract(text, r"^\s*(?:0[xX])?([0-9a-fA-F]{1,16})\s*$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).try_cast("long"))


def namespaced_id(analysis: Column, kind: str, number: Column) -> Column:
    """``analysis:kind-number``; kinds are e, sp, f, l and g."""
    return F.concat(analysis, F.lit(":" + kind), number.cast("string"))


def split_namespaced_id(text: Column) -> Column:
    """struct(analysis, kind, number), parted at the last colon; null if malformed."""
    pattern = r"^(.+):(sp|e|f|l|g)([0-9]+)$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    return F.when(text.rlike(pattern), F.struct(part(1).alias("analysis"), part(2).alias("kind"), part(3).try_cast("long").alias("number")))


def thread_name(tid: Column, generation: Column) -> Column:
    """``t_<tid>``, with ``_g<n>`` from the first reuse of the tid on."""
    return F.concat(F.lit("t_"), tid.cast("string"), F.when(generation > 0, F.concat(F.lit("_g"), generation.cast("string"))).otherwise(""))


def linkage_stem(name: Column) -> Column:
    """A symbol without its trailing ``::h<hash>``."""
    return F.regexp_replace(name, "::h[0-9a-fA-F]{8,}$", "")


def path_leaf(path: Column) -> Column:
    return F.element_at(F.split(path, PATH_SEPARATOR), -1)


def shorten_path(path: Column, depth: int) -> Column:
    """The first ``depth`` names, and the mark if others followed; 0 keeps all."""
    if depth <= 0:
        return path
    names = F.split(path, PATH_SEPARATOR)
    short = F.concat(F.array_join(F.slice(names, 1, depth), PATH_SEPARATOR), F.lit(PATH_SEPARATOR + TRUNCATED))
    return F.when(F.size(names) > depth, short).otherwise(path)


def trace_time_ns(text: Column) -> Column:
    """``seconds.fraction`` in nanoseconds, by integers only; 0 and malformed text are null."""
    pattern = r"^([0-9]+)\.([0-9]+)$"
    seconds = F.regexp_extract(text, pattern, 1).try_cast("long")
    fraction = F.rpad(F.substring(F.regexp_extract(text, pattern, 2), 1, 9), 9, "0").try_cast("long")
    ns = F.try_add(F.try_multiply(seconds, F.lit(1_000_000_000)), fraction)
    return F.nullif(ns, F.lit(0).cast("long"))


def tsc_to_ns(tsc: Column, zero: int, shift: int, mult: int) -> Column:
    """Counter ticks in nanoseconds, high and low part scaled apart to stay within range."""
    ticks = tsc.cast("decimal(38,0)")
    unit = F.lit(1 << shift).cast("decimal(38,0)")
    high = F.floor(ticks / unit).cast("decimal(38,0)")
    low = ticks - high * unit
    return (F.lit(zero).cast("decimal(38,0)") + high * mult + F.floor(low * mult / unit)).cast("long")


def duration(start: Column, end: Column) -> Column:
    """Never negative; null if a side is unknown."""
    return F.greatest(F.lit(0).cast("long"), end - start)


def relative_delta(delta: Column, baseline: Column) -> Column:
    return F.when(baseline != 0, delta.cast("double") / baseline.cast("double"))


def content_key(*parts: Column) -> Column:
    """SHA-256 over the parts, each followed by a NUL; a null part counts as empty."""
    fed = [x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit("\0"))]
    return F.sha2(F.concat(*fed), 256)


def is_missing_image(path: Column, missing: Column) -> Column:
    """Whether an entry of the array starts with the path."""
    return F.coalesce(F.exists(missing, lambda m: m.startswith(path)), F.lit(False))


def self_percent(self_ns: Column, total_ns: Column) -> Column:
    return F.when(total_ns > 0, 100.0 * self_ns / total_ns)
