"""Requests: what may be asked, checked before anything runs."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pathglass.errors import invalid
from pathglass.functions.scalars import MAX_NS

KINDS = ("summary", "quality", "timeline", "hotpaths", "at_instant", "instructions", "branches", "inline_profile", "source", "images", "comparison")
GROUPS = ("function", "path", "inline")
SORTS = ("inclusive", "self_time", "calls")

#: Kinds that need an analysis with instructions.
NEED_INSTRUCTIONS = ("instructions", "branches", "inline_profile")

DEFAULT_LIMIT, MAX_LIMIT = 50, 200
#: Names of an inline chain shown unless a request says otherwise.
INLINE_DEPTH = 3


@dataclass(frozen=True)
class Selection:
    """A thread and a half-open window; everything is optional."""

    thread: str | None = None
    start_ns: int | None = None
    end_ns: int | None = None

    def __post_init__(self):
        for bound in (self.start_ns, self.end_ns):
            if bound is not None and not 0 <= bound <= MAX_NS:
                raise invalid(f"times lie between 0 and {MAX_NS}")
        if self.start_ns is not None and self.end_ns is not None and self.start_ns >= self.end_ns:
            raise invalid("the window's start must lie before its end")

    @property
    def timed(self) -> bool:
        return self.start_ns is not None or self.end_ns is not None

    def check_covered(self, start_ns: int | None, end_ns: int | None) -> None:
        """The window must not reach out of what the analysis covers."""
        if self.start_ns is not None and start_ns is not None and self.start_ns < start_ns:
            raise invalid(f"the analysis starts at {start_ns}", "choose a window within the covered range")
        if self.end_ns is not None and end_ns is not None and self.end_ns > end_ns:
            raise invalid(f"the analysis ends at {end_ns}", "choose a window within the covered range")


@dataclass(frozen=True)
class Query:
    kind: str
    selection: Selection = field(default_factory=Selection)
    cursor: str | None = None
    limit: int | None = None
    group: str = "function"
    sort: str = "inclusive"
    depth: int | None = None
    contains: str | None = None
    min_duration_ns: int | None = None
    at_ns: int | None = None
    address: int | None = None
    function_id: int | None = None
    location_id: int | None = None
    evidence: str | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise invalid(f"unknown kind {self.kind}", f"use one of {', '.join(KINDS)}")
        if self.kind == "hotpaths":
            if self.group not in GROUPS or self.sort not in SORTS:
                raise invalid(f"unknown group or sort: {self.group}, {self.sort}")
            if self.group == "inline" and self.selection.timed:
                raise invalid("inline rows have no times", "drop the window")
        if self.kind == "at_instant" and self.at_ns is None:
            raise invalid("at_instant needs at_ns")
        if self.kind == "source" and all(x is None for x in (self.address, self.function_id, self.location_id, self.evidence)):
            raise invalid("source needs an address, a location, a function or an evidence id")
        self.page()

    def page(self) -> tuple[int, int]:
        """(offset, limit); a cursor is the offset of the next page."""
        limit = DEFAULT_LIMIT if self.limit is None else self.limit
        if not 1 <= limit <= MAX_LIMIT:
            raise invalid(f"limit lies between 1 and {MAX_LIMIT}")
        if self.cursor is None:
            return 0, limit
        if not self.cursor.isdigit():
            raise invalid("the cursor is not one that a page returned")
        return int(self.cursor), limit

    def shown_depth(self) -> int:
        """Names shown, 0 for all."""
        return (INLINE_DEPTH if self.group == "inline" else 0) if self.depth is None else self.depth


def parse_query(body: dict) -> Query:
    """A request as JSON gives it; unknown fields are refused."""
    body = dict(body)
    selection = body.pop("selection", None) or {}
    for given, known in ((selection, Selection), (body, Query)):
        extra = set(given) - {f.name for f in fields(known)}
        if extra:
            raise invalid(f"unknown fields: {', '.join(sorted(extra))}")
    if "kind" not in body:
        raise invalid("a request has a kind")
    return Query(selection=Selection(**selection), **body)


def parse_cpu_list(text: str) -> list[int]:
    """``4-7,9`` as ascending distinct numbers."""
    out: set[int] = set()
    for part in text.split(","):
        low, dash, high = part.strip().partition("-")
        if not low.isdigit() or (dash and not high.isdigit()) or (dash and int(high) < int(low)):
            raise invalid(f"not a cpu list: {text}")
        out.update(range(int(low), int(high if dash else low) + 1))
    return sorted(out)


def parse_address_filter(text: str) -> dict[str, str | None]:
    """``kind:symbol[@image]``; the image stands behind the last ``@``."""
    kind, colon, rest = text.partition(":")
    if not colon or not kind or not rest:
        raise invalid(f"not an address filter: {text}")
    symbol, at, image = rest.rpartition("@")
    return {"kind": kind, "symbol": symbol if at else rest, "image": image if at else None}
