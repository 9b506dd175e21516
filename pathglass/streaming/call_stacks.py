"""Call spans and gaps from a stream of records, the stack of each task kept as state (STR1, STR6).

Rows of a micro-batch are fed by sequence. A record that comes late, behind a
newer one of its thread, counts as a time regression and interrupts the stack; none
is dropped. A task's exit closes its frames, removes them from the state and starts a
new generation of its thread. Frames are a map in the state, of which a batch reads and
writes what it reaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from pathglass.operators.reconstruct import NAMES, OUTPUT, CallStack
from pathglass.schemas import schema_of

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Columns that a stream must have: classified records with functions, and ``cpu_first_ns``,
#: the first time known of the record's cpu. In the order of what the state machine reads.
READ = ["record_type", "seq", "time_ns", "cpu", "cpu_first_ns", "code", "message", "from_fn", "to_fn", "ip", "kind", "trace_begin", "trace_end", "async_event", "transaction", "interrupt", "syscall"]


#: Of these, the columns that a double may not hold exactly.
LARGE = ["time_ns", "cpu_first_ns", "ip"]


#: A task's state but for its frames: generation and whether it was seen in it, its last time, how many frames are
#: open, and the end of tracing that waits for what follows.
HEAD = schema_of("""
generation int
seen boolean
last long
depth int
waits boolean
function long
left long
cpu int
reason string
""")
FRAME = schema_of("""
key long
function long
parent long
start long
opened long
state string
site long
""")


class StoredFrames:
    """A stack of frames that are read from state as they are needed, the innermost first.

    Only frames that were reached are written back: a deep stack costs no more than
    what a batch does at its top.
    """

    def __init__(self, state, depth: int):
        self.state, self.before, self.below, self.top = state, depth, depth, []

    def _reach(self) -> None:
        if not self.top and self.below:
            self.below -= 1
            self.top.append(list(self.state.getValue((self.below,))))

    def __len__(self) -> int:
        return self.below + len(self.top)

    def __bool__(self) -> bool:
        return len(self) > 0

    def __getitem__(self, at: int):
        if at != -1:
            raise IndexError("only the innermost frame is at hand")
        self._reach()
        return self.top[-1]

    def append(self, frame) -> None:
        self.top.append(frame)

    def pop(self):
        self._reach()
        return self.top.pop()

    def store(self) -> int:
        """Write what was reached, remove what has gone; the depth."""
        depth = len(self)
        for k, frame in enumerate(self.top, self.below):
            self.state.updateValue((k,), tuple(x if x is None or isinstance(x, str) else int(x) for x in frame))
        for k in range(depth, self.before):
            self.state.removeKey((k,))
        self.before = depth
        return depth


def _values(column: pd.Series, order: np.ndarray, large: bool) -> list:
    """Plain values of a column in order, null as None."""
    values, missing = column.to_numpy(dtype=object)[order], column.isna().to_numpy()[order]
    values[missing] = None
    return [None if x is None else int(x) for x in values.tolist()] if large else values.tolist()


class StackProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", HEAD)
        self.frames = handle.getMapState("frames", schema_of("place int"), FRAME)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        generation, seen, last, depth, waits, *pending = self.head.get() if self.head.exists() else (0, False, None, 0, False, None, None, None, None)
        name = lambda: f"t_{key[1]}" + (f"_g{generation}" if generation else "")
        frames = StoredFrames(self.frames, depth)
        stack = CallStack(name(), frames, tuple(pending) if waits else None)
        parts = list(rows)
        batch = parts[0] if len(parts) == 1 else pd.concat(parts)
        order = np.argsort(batch["seq"].to_numpy(), kind="stable")
        for record_type, seq, now, cpu, cpu_first, *rest in zip(*(_values(batch[c], order, c in LARGE) for c in READ), strict=True):
            regressed = None
            if record_type == "sample":
                seen = True
                if now is not None:
                    if last is not None and now < last:
                        regressed = last
                    last = now
            elif record_type == "task" and not seen:
                continue
            code, message, *facts = rest
            stack.feed((record_type, now, cpu, cpu_first, code, message, regressed, seq, *facts))
            if record_type == "task":
                generation, seen, last = generation + 1, False, None
                stack.thread = name()
        plain = lambda x: None if x is None else int(x)
        function, left, cpu, reason = stack.pending or (None,) * 4
        # Of a task that has exited its generation stays, so that it is a new thread if it returns.
        self.head.update((int(generation), bool(seen), plain(last), frames.store(), stack.pending is not None, plain(function), plain(left), plain(cpu), reason))
        if stack.out:
            yield pd.DataFrame(stack.out, columns=NAMES, dtype=object)

    def close(self) -> None:
        pass


def stream_stacks(records: DataFrame) -> DataFrame:
    """The output rows of :data:`OUTPUT` for a stream with pid, tid and the columns of READ.

    Event numbers are sequence numbers here. Frames stay open until they return, are
    interrupted or their task exits.
    """
    # A column with nulls reaches pandas as doubles, too short for times and addresses: they go as text.
    rows = records.select("pid", "tid", *READ).withColumns({c: F.col(c).cast("string") for c in LARGE})
    return rows.groupBy("pid", "tid").transformWithStateInPandas(statefulProcessor=StackProcessor(), outputStructType=StructType.fromDDL(OUTPUT), outputMode="Append", timeMode="None")


@contextmanager
def stateful(spark: SparkSession):
    """State in RocksDB while a query starts; the session's own setting returns behind it."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def run_to_end(stream: DataFrame, path: str) -> DataFrame:
    """Process what the source holds now, exactly once, into a Parquet folder; read it back."""
    spark = stream.sparkSession
    with stateful(spark):
        query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
