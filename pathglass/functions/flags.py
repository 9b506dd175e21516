"""The flag words of trace text: their set, the boundaries and the kind they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The flag words that the trace text format prints, and what they mean.
WORDS = {
    "call": "call",
    "return": "return",
    "jcc": "jcc",
    "jmp": "jmp",
    "int": "int",
    "iret": "iret",
    "syscall": "syscall",
    "sysret": "sysret",
    "async": "async",
    "abrt": "tx_abort",
    "strt": "tr_start",
    "start": "tr_start",
    "end": "tr_end",
    "vmentry": "vmentry",
    "vmexit": "vmexit",
}
# First words of two-word flags, which mean nothing alone.
FIRST_WORDS = ("tr", "hw", "tx", "trace", "begin")
# Letters of the raw form, printed for combinations without a name.
LETTERS = {"c": "call", "r": "return", "o": "jcc", "s": "syscall", "y": "async", "i": "int", "A": "tx_abort", "B": "tr_start", "E": "tr_end"}
SILENT_LETTERS, UNNAMED_LETTERS = "b", "xghDt"

BOUNDARIES = ("trace_begin", "trace_end", "async_event", "transaction", "interrupt", "syscall")


def flag_set(text: Column) -> Column:
    """The distinct flags in a text of flag words; ``unknown`` stands for other words.

    ``hw int`` is one flag of its own. A null text has no flags.
    """
    words = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"(^|\s)hw\s+int(?=\s|$)", " hw_int"), r"\s+"), lambda w: w != "")
    named = F.create_map(*(F.lit(x) for pair in (WORDS | {"hw_int": "hw_int"}).items() for x in pair))
    by_letter = F.create_map(*(F.lit(x) for pair in (LETTERS | dict.fromkeys(UNNAMED_LETTERS, "unknown")).items() for x in pair))
    raw = "^[" + "".join(LETTERS) + SILENT_LETTERS + UNNAMED_LETTERS + "]{1,16}$"

    def one(word: Column) -> Column:
        letters = F.filter(F.transform(F.split(word, ""), lambda c: F.try_element_at(by_letter, c)), lambda f: f.isNotNull())
        return (
            F.when(word.isin(*FIRST_WORDS), F.array().cast("array<string>"))
            .when(F.map_contains_key(named, word), F.array(F.try_element_at(named, word)))
            .when(word.rlike(raw), letters)
            .otherwise(F.array(F.lit("unknown")))
        )

    return F.array_distinct(F.flatten(F.transform(words, one)))


def _any(flags: Column, *names: str) -> Column:
    return F.arrays_overlap(flags, F.array(*map(F.lit, names)))


def boundary(flags: Column) -> dict[str, Column]:
    """The boundary bits by name, from a flag set."""
    return {
        "trace_begin": _any(flags, "tr_start"),
        "trace_end": _any(flags, "tr_end"),
        "async_event": _any(flags, "async", "hw_int"),
        "transaction": _any(flags, "tx_abort"),
        "interrupt": _any(flags, "int", "iret", "hw_int"),
        "syscall": _any(flags, "syscall", "sysret"),
    }


def flow_kind(flags: Column) -> Column:
    """What the transfer was; boundaries go before branch classes, a jump is the default."""
    return (
        F.when(_any(flags, "tr_start"), "trace_begin")
        .when(_any(flags, "tr_end"), "trace_end")
        .when(_any(flags, "async", "hw_int", "int", "iret", "syscall", "sysret", "tx_abort", "vmentry", "vmexit"), "async_boundary")
        .when(_any(flags, "call"), "call")
        .when(_any(flags, "return"), "return")
        .when(_any(flags, "jcc"), "conditional")
        .otherwise("jump")
    )
