"""Call spans and gaps from branch records (STR1).

Only the call stack needs a state machine, and only between two places where the
stack is known to be empty. So expressions do the rest: kinds and boundaries from
flags, symbols by join, samples that cannot matter are dropped. What a record needs
to know of the thread before it (generation, last time, whether tracing had ended,
resets) is found within ranges of the stream and carried over their borders by one
row a range and thread, so a thread that holds most records spreads over tasks.
Threads are cut into segments behind every record that unwinds the stack for good.
Each segment is fed in order from a sorted stream: a long one takes time, not memory.

A segment of very many records is cut further, at plain calls, into pieces that are fed
at once, each without knowing the stack that it is given. A piece matches its own calls
and returns; what reaches below its first frame is left over, with the frames that stay
open: the piece's effect on any stack. What the pieces of a thread leave over, one after
the other, has the same effect as all their records, and is fed as usual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathglass.functions.flags import BOUNDARIES, boundary, flag_set, flow_kind
from pathglass.functions.scalars import thread_name
from pathglass.operators.records import first_times, in_ranges
from pathglass.storage import counted as counted_rows
from pathglass.storage import cut

UNKNOWN_THREAD = "t_unknown"

#: What a group of records gives: spans, then gaps; ``row`` tells which.
OUTPUT = (
    "row string, thread string, key long, function long, parent_key long, start_ns long, end_ns long, completeness string, "
    "start_event long, end_event long, call_site long, kind string, extent_known boolean, reason string, mismatch boolean"
)
NAMES = [part.split()[0] for part in OUTPUT.split(", ")]

#: What the state machine reads of a record, in this order.
READ = ["record_type", "time_ns", "cpu", "cpu_first_ns", "code", "message", "regressed_from", "event_id", "from_fn", "to_fn", "ip", "kind", *BOUNDARIES]

# The reasons that gaps state.
REASONS = {
    "moved": "thread moved from cpu {} to cpu {}; execution in between was overwritten in the AUX ring",
    "no_start": "{}; no trace start before next sample",
    "elsewhere": "{}; resumed elsewhere",
    "async": "async or interrupt transfer",
    "regression": "time regression",
    "lost": "PERF_RECORD_LOST",
}


class CallStack:
    """The stack of one thread, fed with its records in order; plain values, so it can be stored."""

    def __init__(self, thread: str, frames=None, pending=None):
        self.thread, self.frames, self.pending, self.out = thread, [] if frames is None else frames, pending, []

    def _emit(self, frame, end, event, completeness, mismatch=False) -> None:
        key, function, parent, start, opened, _, site = frame
        self.out.append(("span", self.thread, key, function, parent, start, end, completeness, opened, event, site, None, None, None, mismatch))

    def gap(self, kind, start, end, known, reason, event=None) -> None:
        """A gap, shown by the event ``event``."""
        self.out.append(("gap", self.thread, None, None, None, start, end, None, event, None, None, kind, known, reason, None))

    def interrupt(self) -> None:
        while self.frames:
            frame = self.frames.pop()
            self._emit(frame, None, frame[4], "interrupted_by_gap")

    def finish(self, end=None) -> None:
        """Close what is open, innermost first: the thread has exited, or nothing follows."""
        self.pending = None
        while self.frames:
            frame = self.frames.pop()
            self._emit(frame, end, frame[4], "open_both" if frame[5] == "open_start" else "open_end")

    def _open(self, event, sub, function, start, state, site=None) -> None:
        parent = self.frames[-1][0] if self.frames else None
        self.frames.append([2 * event + sub, function, parent, start, event, state, site])

    def _resolve(self, now, cpu, cpu_first, event, source, target, begins) -> bool:
        """What a record says about tracing that had ended; True if it says all there is."""
        function, left, left_cpu, reason = self.pending
        self.pending = None
        entered = target if target is not None else source
        if cpu is not None and cpu != left_cpu and left is not None and (cpu_first is None or cpu_first > left):
            end = cpu_first if cpu_first is not None else now
            self.interrupt()
            self.gap("ring_truncation", left, end, end is not None, REASONS["moved"].format("?" if left_cpu is None else left_cpu, cpu), event)
            if begins and entered is not None:
                self._open(event, 0, entered, now, "open_start")
            return begins
        if not begins:
            self.interrupt()
            self.gap("unknown", left, now, False, REASONS["no_start"].format(reason), event)
            return False
        if function is not None and target == function:
            self.gap("trace_boundary", left, now, left is not None and now is not None, reason, event)
            if not self.frames:
                self._open(event, 0, function, left if left is not None else now, "open_start")
            return True
        self.interrupt()
        self.gap("unknown", left, now, False, REASONS["elsewhere"].format(reason), event)
        if entered is not None:
            self._open(event, 0, entered, now, "open_start")
        return True

    def push(self, key, function, parent, start, opened, state, site) -> None:
        """A frame that a piece has left open; without a parent of its own it stands on what is open here."""
        self.frames.append([key, function, parent if parent is not None or not self.frames else self.frames[-1][0], start, opened, state, site])

    def mark(self, ref) -> None:
        """Say what is open where a piece's frames were put."""
        top = self.frames[-1] if self.frames else (None, None)
        self.out.append(("ref", self.thread, ref, top[1], top[0], *[None] * 10))

    def feed(self, record) -> None:
        """One record, a tuple of READ: a sample, a decoder error or the thread's exit."""
        record_type, now, cpu, cpu_first, code, message, regressed, event, source, target, ip, kind, begins, ends, async_event, transaction, interrupt, syscall = record
        if record_type == "decoder_error":
            self.interrupt()
            self.gap("missing_image" if code == 5 else "decoder_error", now, None, False, message)
            return
        if record_type == "task":
            self.finish(now)
            return
        if regressed is not None:
            self.interrupt()
            self.gap("time_regression", regressed, now, True, REASONS["regression"], event)
        if self.pending is not None and self._resolve(now, cpu, cpu_first, event, source, target, begins):
            return
        if ends:
            reason = "syscall" if syscall else "async" if async_event else "interrupt" if interrupt else "trace end"
            self.pending = (source, now, cpu, reason)
        elif async_event or interrupt or transaction:
            self.interrupt()
            self.gap("unknown", now, None, False, REASONS["async"], event)
        elif begins:
            entered = target if target is not None else source
            if not self.frames and entered is not None:
                self._open(event, 0, entered, now, "open_start")
        elif syscall:
            return
        elif kind == "call":
            self._open(event, 0, target, now, "open_end", ip)
        elif kind == "return":
            if self.frames:
                frame = self.frames.pop()
                top = self.frames[-1][1] if self.frames else None
                astray = top is not None and target is not None and top != target
                self._emit(frame, now, event, "open_both" if frame[5] == "open_start" else "complete", astray)
            else:
                self._emit([2 * event, source, None, None, event, None, None], now, event, "uncertain_unwind")
                if target is not None:
                    self._open(event, 1, target, now, "open_start")
        elif source is not None and target is not None and source != target:
            parent = None
            if self.frames:
                frame = self.frames.pop()
                parent = frame[2]
                self._emit(frame, now, event, "uncertain_unwind")
            self._open(event, 0, target, now, "open_start")
            self.frames[-1][2] = parent
        elif source is None and target is not None and self.frames and self.frames[-1][1] is None:
            self.frames[-1][1] = target


class Piece:
    """Records between two plain calls of a thread, fed without the stack that they are given.

    Frames that the piece has opened are treated as usual. A record that would look
    at the stack below them, or change it, is left over, for the stack that is given; so
    are open frames at the end. The parent of a piece's outermost frames is what is
    open below them then: they carry a reference in its place, the key of the
    first frame that was opened since the last record left over.
    """

    def __init__(self, thread: str):
        self.stack, self.left, self.out, self.ref, self.ended = CallStack(thread), [], [], None, None
        #: Whether the stack below waits for what follows the end of tracing.
        self.waits = False

    def _leave(self, record, ended=None) -> None:
        self.left += [("record", r) for r in (ended, record) if r is not None]
        self.ref = None
        if record[0] == "sample":
            self.waits = record[READ.index("trace_end")]
        else:
            self.waits = record[0] != "task" and (self.waits or ended is not None)

    def _give(self, target=None) -> None:
        """The stack's rows; what has no parent in the piece refers to what is below it, which a return's target is compared with."""
        for row in self.stack.out:
            lowest = row[0] == "span" and row[4] is None
            self.out.append((*row, self.ref if lowest else None, target if lowest else None))
        self.stack.out = []

    def feed(self, record) -> None:
        stack = self.stack
        record_type, now, cpu, cpu_first, _, _, regressed, event, source, target, _, kind, begins, ends, async_event, transaction, interrupt, syscall = record
        sample = record_type == "sample"
        plain = sample and regressed is None and not (begins or ends or async_event or transaction or interrupt or syscall)
        if not stack.frames:
            if not plain or kind != "call" or self.waits:
                self._leave(record)
                return
            if self.ref is None:
                self.ref = 2 * event
                self.left.append(("mark", self.ref))
            stack.feed(record)
            return
        cuts = not sample or regressed is not None
        if not cuts and stack.pending is None:
            cuts = not ends and (async_event or interrupt or transaction)
        elif not cuts:
            function, left, left_cpu, _ = stack.pending
            moved = cpu is not None and cpu != left_cpu and left is not None and (cpu_first is None or cpu_first > left)
            cuts = moved or not begins or function is None or target != function
        if not cuts:
            self.ended = record if ends else self.ended
            stack.feed(record)
            self._give(target if plain and kind == "return" else None)
            return
        ended = self.ended if stack.pending is not None else None
        stack.pending = None
        if record_type == "task":
            stack.finish(now)
        else:
            stack.interrupt()
        self._give()
        self._leave(record, ended)

    def finish(self) -> None:
        """Leave over what is still open."""
        self.left += [("push", tuple(frame)) for frame in self.stack.frames]
        if self.stack.pending is not None:
            self._leave(self.ended)
        self.stack.frames, self.stack.pending = [], None


def classify(records: DataFrame) -> DataFrame:
    """Records with kind and boundary bits from their flags."""
    rows = records.withColumn("set", flag_set(F.col("flags")))
    rows = rows.withColumn("kind", flow_kind(F.col("set")))
    return rows.withColumns(boundary(F.col("set"))).drop("set")


THREAD = ("part", "pid", "tid")


def _before(what: Column) -> Column:
    """The last value of a thread's earlier records in the same range of the stream."""
    return F.last(what, ignorenulls=True).over(Window.partitionBy(*THREAD).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))


def _sum_before(what: Column) -> Column:
    return F.coalesce(F.sum(what.cast("long")).over(Window.partitionBy(*THREAD).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def _over_earlier(what: Column) -> Column:
    """Of one row for each range and thread: over the ranges before."""
    return what.over(Window.partitionBy("pid", "tid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))


def prepare(records: DataFrame, everything: DataFrame | None = None, mark: bool = False) -> DataFrame:
    """What the state machine reads, from classified records with ``from_fn`` and ``to_fn``.

    Samples that cannot matter are left out; with ``mark`` they stay, marked by ``moot``.

    ``records`` is what :func:`with_event_ids` gives. Optional columns ``from_map``
    and ``to_map`` name the mappings of both ends. ``everything`` holds records of
    other processes too, whose samples say when a cpu's history begins.
    """
    for name in ("from_map", "to_map"):
        if name not in records.columns:
            records = records.withColumn(name, F.lit(None).cast("long"))
    rows = records.filter("(record_type in ('sample', 'decoder_error') or (record_type = 'task' and task_kind = 'exit')) and pid is not null and tid is not null")
    # One row for each cpu.
    rows = rows.drop("cpu_first_ns").join(F.broadcast(first_times(records if everything is None else everything).withColumnRenamed("first_ns", "cpu_first_ns")), "cpu", "left")
    sample, leaves = F.col("record_type") == "sample", F.col("record_type") == "task"
    timed = sample & F.col("time_ns").isNotNull()

    # An exit ends a generation if the thread was seen since the exit before.
    borders = rows.groupBy(*THREAD).agg(F.max(F.when(leaves, F.col("seq"))).alias("x"), F.max(F.when(sample, F.col("seq"))).alias("s"))
    borders = borders.select(*THREAD, _over_earlier(F.max("x")).alias("exit_in"), _over_earlier(F.max("s")).alias("seen_in"))
    rows = rows.join(borders, list(THREAD))
    exit_before = F.coalesce(_before(F.when(leaves, F.col("seq"))), "exit_in", F.lit(-1).cast("long"))
    rows = rows.withColumn("closes", leaves & F.coalesce(F.coalesce(_before(F.when(sample, F.col("seq"))), "seen_in") > exit_before, F.lit(False)))
    rows = rows.withColumn("closed", _sum_before(F.col("closes")))
    # Behind a transfer that nothing follows, or an error while tracing, no frame is open.
    reset = sample & ~F.col("trace_end") & (F.col("async_event") | F.col("interrupt") | F.col("transaction"))
    last = {"last_time": (timed, "time_ns"), "last_end": (sample, "trace_end")}
    rows = rows.withColumns({name: _before(F.when(where, F.struct("closed", F.col(c).alias("value")))) for name, (where, c) in last.items()})
    rows = cut(rows.withColumn("reset", reset).withColumn("resets", _sum_before(reset)).drop("exit_in", "seen_in"), "threads")

    ends = rows.groupBy(*THREAD).agg(
        F.sum(F.col("closes").cast("long")).alias("closes"),
        F.sum(F.coalesce("reset", F.lit(False)).cast("long")).alias("resets"),
        *(F.max_by(F.struct("closed", F.col(c).alias("value")), F.when(where, F.col("seq"))).alias(name) for name, (where, c) in last.items()),
    )
    ends = ends.withColumns({"closed_in": F.coalesce(_over_earlier(F.sum("closes")), F.lit(0).cast("long")), "resets_in": F.coalesce(_over_earlier(F.sum("resets")), F.lit(0).cast("long"))})
    whole = lambda name: F.when(F.col(name).isNotNull(), F.struct((F.col("closed_in") + F.col(name)["closed"]).alias("closed"), F.col(name)["value"].alias("value")))
    ends = ends.select(*THREAD, "closed_in", "resets_in", *(_over_earlier(F.last(whole(name), ignorenulls=True)).alias(f"{name}_in") for name in last))
    rows = rows.join(ends, list(THREAD)).withColumn("generation", (F.col("closed_in") + F.col("closed")).cast("int"))

    def known(name: str) -> Column:
        """The value, if it is of the record's own generation."""
        own = F.when(F.col(name)["closed"] == F.col("closed"), F.col(name)["value"])
        carried = F.when(F.col(f"{name}_in")["closed"] == F.col("generation"), F.col(f"{name}_in")["value"])
        return F.when(F.col(name).isNotNull(), own).otherwise(carried)

    rows = rows.withColumn("thread", thread_name(F.col("tid"), F.col("generation")))
    rows = rows.withColumn("regressed_from", F.when(sample & (F.col("time_ns") < known("last_time")), known("last_time")))
    unbound = ~F.greatest(*(F.coalesce(b, F.lit(False)) for b in BOUNDARIES))
    same = F.col("from_fn").eqNullSafe(F.col("to_fn"))
    inside = F.col("from_fn").isNotNull() | (F.col("from_map").eqNullSafe(F.col("to_map")) & ((F.col("kind") == "conditional") | F.col("from_map").isNull()))
    plain = sample & F.col("kind").isin("jump", "conditional") & unbound & same & inside
    moot = plain & F.col("regressed_from").isNull() & ~F.coalesce(known("last_end"), F.lit(False))
    rows = rows.withColumns({"retained": sample & ~plain, "segment": F.col("resets_in") + F.col("resets"), "moot": moot, "fresh": sample & unbound & (F.col("kind") == "call") & F.col("regressed_from").isNull() & ~F.coalesce(known("last_end"), F.lit(False))})
    rows = rows if mark else rows.filter(~F.col("moot")).drop("moot")
    return rows.drop("closes", "closed", "closed_in", "reset", "resets", "resets_in", *last, *(f"{name}_in" for name in last))


SEGMENT = ("pid", "tid", "generation", "segment")


#: Records of a segment from which it is cut into pieces.
LONG = 50_000

#: What a piece gives: its rows with ``at`` 0, where ``ref`` stands for a parent below the piece, whose function
#: ``target`` is compared with; then, numbered, what it leaves over.
FED = (
    f"pid int, tid int, generation int, segment long, piece int, at long, of_thread string, item string, {OUTPUT}, ref long, target long, "
    + ", ".join(f"r_{name} {kind}" for name, kind in zip(READ, ["string", "long", "long", "long", "long", "string"] + ["long"] * 5 + ["string"] + ["boolean"] * 6, strict=True))
)


def _batch(rows: list, schema: str):
    import pyarrow as pa

    types = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32()}
    fields = [(n, types[t]) for n, t in (part.split() for part in schema.split(", "))]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def _fed(prepared: DataFrame) -> DataFrame:
    """OUTPUT of segments, each fed whole."""

    def run(batches):
        stack, current = None, None
        for b in batches:
            out: list = []
            columns = [b.column(c).to_pylist() for c in (*SEGMENT, "thread", *READ)]
            for row in zip(*columns, strict=True):
                if row[:4] != current:
                    if stack is not None:
                        stack.finish()
                        out += stack.out
                    stack, current = CallStack(row[4]), row[:4]
                stack.feed(row[5:])
            if stack is not None:
                out += stack.out
                stack.out = []
            yield _batch(out, OUTPUT)
        if stack is not None:
            stack.finish()
            yield _batch(stack.out, OUTPUT)

    rows = prepared.select(*SEGMENT, "thread", "seq", *READ).repartition(*SEGMENT).sortWithinPartitions(*SEGMENT, "seq")
    return rows.select(*SEGMENT, "thread", *READ).mapInArrow(run, OUTPUT)


def pieces(rows: DataFrame) -> DataFrame:
    """``rows`` of long segments with ``piece``: each range of the stream begins one with its first plain call, if it has any."""
    firsts = rows.groupBy(*SEGMENT, "part").agg(F.min(F.when(F.col("fresh"), F.col("seq"))).alias("first"))
    begun = F.when(F.col("first").isNotNull(), F.col("part"))
    earlier = Window.partitionBy(*SEGMENT).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("before", F.coalesce(F.last(begun, ignorenulls=True).over(earlier), F.lit(-1)))
    met = rows.join(counted_rows(cut(firsts, "pieces")), [*SEGMENT, "part"])
    return met.withColumn("piece", F.when(F.col("seq") >= F.col("first"), F.col("part")).otherwise(F.col("before"))).drop("first", "before")


def _fed_in_pieces(rows: DataFrame) -> DataFrame:
    """OUTPUT of long segments: pieces at once, then what they leave over."""
    keys, frame = (*SEGMENT, "piece"), ("key", "function", "parent_key", "start_ns", "start_event", "completeness", "call_site")
    nothing, no_record = (None,) * len(NAMES), (None,) * len(READ)

    def run(batches):
        piece, current, at = None, None, 0

        def given() -> list:
            nonlocal at
            out = [(*current, 0, None, None, *row, *no_record) for row in piece.out]
            for what, value in piece.left:
                at += 1
                head = (*current, at, piece.stack.thread, what)
                if what == "record":
                    out.append((*head, *nothing, None, None, *value))
                elif what == "mark":
                    out.append((*head, *nothing, value, None, *no_record))
                else:
                    fields = dict(zip(frame, value, strict=True))
                    out.append((*head, *(fields.get(n) for n in NAMES), None, None, *no_record))
            piece.out, piece.left = [], []
            return out

        for b in batches:
            out: list = []
            columns = [b.column(c).to_pylist() for c in (*keys, "thread", *READ)]
            for row in zip(*columns, strict=True):
                if row[:5] != current:
                    if piece is not None:
                        piece.finish()
                        out += given()
                    piece, current, at = Piece(row[5]), row[:5], 0
                piece.feed(row[6:])
            if piece is not None:
                out += given()
            yield _batch(out, FED)
        if piece is not None:
            piece.finish()
            yield _batch(given(), FED)

    dealt = rows.select(*keys, "thread", "seq", *READ).repartition(*keys).sortWithinPartitions(*keys, "seq")
    fed = cut(dealt.select(*keys, "thread", *READ).mapInArrow(run, FED), "pieces-fed")

    def rest(batches):
        stack, current = None, None
        for b in batches:
            out: list = []
            names = (*SEGMENT, "of_thread", "item", "ref", *frame, *(f"r_{n}" for n in READ))
            for row in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if row[:4] != current:
                    if stack is not None:
                        stack.finish()
                        out += stack.out
                    stack, current = CallStack(row[4]), row[:4]
                if row[5] == "record":
                    stack.feed(row[7 + len(frame) :])
                elif row[5] == "mark":
                    stack.mark(row[6])
                else:
                    stack.push(*row[7 : 7 + len(frame)])
            if stack is not None:
                out += stack.out
                stack.out = []
            yield _batch(out, OUTPUT)
        if stack is not None:
            stack.finish()
            yield _batch(stack.out, OUTPUT)

    left = fed.filter("at > 0").repartition(*SEGMENT).sortWithinPartitions(*keys, "at")
    below = cut(left.mapInArrow(rest, OUTPUT), "pieces-left")
    refs = below.filter("row = 'ref'").select(F.col("key").alias("ref"), F.col("function").alias("ref_function"), F.col("parent_key").alias("ref_key"))
    above = fed.filter("at = 0").select(*NAMES, "ref", "target").join(counted_rows(cut(refs, "pieces-refs")), "ref", "left")
    astray = F.coalesce(F.col("target") != F.col("ref_function"), F.lit(False))
    above = above.withColumns({"parent_key": F.coalesce("parent_key", "ref_key"), "mismatch": F.col("mismatch") | astray})
    return above.select(*NAMES).unionByName(below.filter("row <> 'ref'").select(*NAMES))


def _segments(prepared: DataFrame, records: DataFrame) -> DataFrame:
    # A thread of few records has no long segment: threads are counted first, in two columns of what is written.
    busy = cut(records.groupBy("pid", "tid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LONG).select("pid", "tid"), "busy-threads")
    if busy.isEmpty():
        return _fed(prepared)
    sizes = prepared.join(counted_rows(busy), ["pid", "tid"], "left_semi").groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LONG).drop("n")
    sizes = cut(sizes, "long-segments")
    if sizes.isEmpty():
        return _fed(prepared)
    few = counted_rows(sizes)
    return _fed(prepared.join(few, list(SEGMENT), "left_anti")).unionByName(_fed_in_pieces(pieces(prepared.join(few, list(SEGMENT), "left_semi"))))


def with_event_ids(records: DataFrame) -> DataFrame:
    """``records`` with ``part``, their range of the stream, and ``event_id``, the 0-based rank of a sample in it.

    Records are written once, sorted into ranges, several streams as one; each range
    numbers its own samples from one number for each range on. No global window.
    """
    ranged = in_ranges(records)
    sample = F.col("record_type") == "sample"
    sizes = ranged.groupBy("part").agg(F.count_if(sample).alias("n"))
    base = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.sum(sample.cast("long")).over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - 1
    numbered = ranged.join(F.broadcast(base), "part").withColumn("event_id", F.when(sample, F.col("base") + rank))
    return numbered.drop("base")


def reconstruct(records: DataFrame, counted: bool = False, everything: DataFrame | None = None, prepared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(spans, gaps) of classified records with functions; seq must be unique.

    Spans carry ``key``, twice the opening event plus which of two it opened, in
    place of a number: keys sort as spans open, and ``parent`` is a key too. Records
    without a task stand for losses on an unknown thread. With ``counted`` spans
    say whether their return landed outside of the function open below (``mismatch``),
    and gaps which event showed them (``event``). ``prepared`` is what :func:`prepare`
    gave for the records, if that is at hand.
    """
    if prepared is None:
        records = records if "event_id" in records.columns else cut(with_event_ids(records), "numbered")  # read four times
        prepared = prepare(records, everything)
    found = cut(_segments(prepared, records), "reconstructed")
    spans = found.filter("row = 'span'").select(F.col("key").alias("id"), "thread", "function", F.col("parent_key").alias("parent"), "start_ns", "end_ns", "completeness", "start_event", "end_event", "call_site", *(["mismatch"] if counted else []))
    lost = records.filter("record_type = 'lost' or (record_type = 'decoder_error' and (pid is null or tid is null))")
    is_lost = F.col("record_type") == "lost"
    kind = F.when(is_lost, "pt_loss").when(F.col("code") == 5, "missing_image").otherwise("decoder_error")
    nowhere = lost.select(F.lit(UNKNOWN_THREAD).alias("thread"), kind.alias("kind"), F.when(~is_lost, F.col("time_ns")).alias("start_ns"), F.lit(None).cast("long").alias("end_ns"), F.lit(False).alias("extent_known"), F.when(is_lost, REASONS["lost"]).otherwise(F.col("message")).alias("reason"), *([F.lit(None).cast("long").alias("event")] if counted else []))
    gaps = found.filter("row = 'gap'").select("thread", "kind", "start_ns", "end_ns", "extent_known", "reason", *([F.col("start_event").alias("event")] if counted else []))
    return spans, gaps.unionByName(nowhere)


def retained_of(prepared: DataFrame) -> DataFrame:
    rows = prepared.filter("retained")
    return rows.select(F.col("event_id").alias("id"), "thread", F.col("seq").alias("sequence"), "time_ns", F.col("ip").alias("from_ip"), F.col("addr").alias("to_ip"), "kind", *BOUNDARIES)


def retained_events(records: DataFrame) -> DataFrame:
    """The samples worth keeping: all but plain jumps within a function (FLT9)."""
    return retained_of(prepare(records if "event_id" in records.columns else cut(with_event_ids(records), "numbered")))
