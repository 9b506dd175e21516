"""The span forest: paths from the root, depths, and the stacks open at an instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathglass.functions.scalars import PATH_SEPARATOR, TRUNCATED, UNKNOWN
from pathglass.storage import BROADCAST_ROWS, cut

#: Names in a path; deeper spans show the innermost ones behind the mark.
MAX_FRAMES = 64
#: Levels that open spans climb between two writes.
CLIMB = 2
#: Between the names of a chain.
_SEP = "\x00"


def named(spans: DataFrame, functions: DataFrame) -> DataFrame:
    """``spans`` with their function's ``name``; null if unknown."""
    return spans.join(functions.select(F.col("id").alias("function"), "name"), "function", "left")


def _level(names: Column) -> Column:
    """A name of a chain as text in which the separators of chains cannot occur."""
    return F.replace(F.replace(names, F.lit("\x01"), F.lit("\x01.")), F.lit(_SEP), F.lit("\x01,"))


def _shown(chain: Column, separator: str) -> Column:
    """The names of a chain joined by ``separator``."""
    return F.replace(F.replace(F.replace(chain, F.lit(_SEP), F.lit(separator)), F.lit("\x01,"), F.lit(_SEP)), F.lit("\x01."), F.lit("\x01"))


def chains(rows: DataFrame, keep: int) -> DataFrame:
    """``rows`` (id, parent, name...) with ``chain``, the innermost ``keep`` names from the outermost on, and their number ``n``.

    Chains double in length each round: a span's chain continues with the chain of its
    furthest known ancestor, so 64 names take 6 joins on the id. A parent that is not
    in the table makes a root. Only chains that are not whole ask; the last round asks for
    the missing names alone. Written chains are far smaller than in memory, so what asks and
    what answers meet by a shuffle at every size.
    """
    own = [c for c in rows.columns if c != "parent"]
    state = rows.select(*own, F.col("parent").alias("next"), _level(F.coalesce("name", F.lit(UNKNOWN))).alias("chain"), F.lit(1).alias("n"))
    size, asks = 1, (F.col("n") < keep) & F.col("next").isNotNull()
    state = cut(state, "paths")
    while not state.filter(asks).isEmpty():
        # Whoever asks has as many names as rounds have doubled, or a parent that is not there.
        more = F.substring_index("chain", _SEP, -(keep - size)) if keep < 2 * size else F.col("chain")
        answers = state.select(F.col("id").alias("next"), F.col("next").alias("then"), more.alias("more"), F.least("n", F.lit(keep - size)).alias("more_n"))
        met = state.filter(asks).join(answers.hint("merge"), "next", "left")
        chain = F.when(F.col("more").isNotNull(), F.concat("more", F.lit(_SEP), "chain")).otherwise(F.col("chain"))
        met = met.select(*own, F.col("then").alias("next"), chain.alias("chain"), (F.col("n") + F.coalesce("more_n", F.lit(0))).alias("n"))
        state = cut(met.unionByName(state.filter(~F.coalesce(asks, F.lit(False)))), "paths")
        size = min(2 * size, keep)
    return state.drop("next")


def call_paths(spans: DataFrame, functions: DataFrame, max_frames: int = MAX_FRAMES) -> DataFrame:
    """``spans`` with name, path and depth (number of ancestors, counted to the limit)."""
    rows = named(spans, functions).withColumn("__parent", F.col("parent"))
    # One name more than shown is enough to know that some are missing.
    rows = chains(rows, max_frames + 1).withColumnRenamed("__parent", "parent")
    shown = _shown(F.substring_index("chain", _SEP, -max_frames), PATH_SEPARATOR)
    path = F.when(F.col("n") > max_frames, F.concat(F.lit(TRUNCATED + PATH_SEPARATOR), shown)).otherwise(shown)
    return rows.withColumns({"path": path, "depth": (F.col("n") - 1).cast("long")}).drop("chain", "n")


def at_instant(spans: DataFrame, functions: DataFrame, at_ns: int, max_frames: int = MAX_FRAMES, few: int = BROADCAST_ROWS) -> DataFrame:
    """(thread, span, function, depth, start_ns, end_ns, elapsed_ns, stack): the deepest open span of each thread.

    A span is open if it has started by then and has not ended, or its end is not
    known. Depth counts ancestors up to one more than ``max_frames``; spans deeper
    than that are equally deep. Of equally deep ones the one that started later is
    taken, then the smaller id. The stack lists the ancestors counted, open or not,
    outermost first. While the open spans are ``few``, they alone climb, a level a
    broadcast; else the chains of all spans double, which takes a shuffle a doubling
    instead of one a level.
    """
    is_open = "start_ns is not null and start_ns <= {0} and (end_ns is null or end_ns > {0})".format(int(at_ns))
    state = named(spans.filter(is_open), functions).select("id", "thread", "start_ns", "end_ns", F.col("parent").alias("next"), F.array(F.coalesce("name", F.lit(UNKNOWN))).alias("names"))
    state = cut(state, "open-spans")
    # Every open span looks up one parent a level, so what is broadcast never outgrows their number.
    if state.count() <= few:
        state = _climbed(state, named(spans, functions), max_frames).withColumn("n", F.size("names"))
        held, stack = "names", F.col("s.names")
    else:
        state = chains(named(spans, functions).select("id", "thread", "start_ns", "end_ns", "parent", "name"), max_frames + 2).filter(is_open)
        held, stack = "chain", F.transform(F.split("s.chain", _SEP), lambda name: _shown(name, _SEP))
    best = F.max_by(F.struct("id", "start_ns", "end_ns", "n", held), F.struct("n", "start_ns", -F.col("id")))
    top = state.groupBy("thread").agg(best.alias("s")).withColumn("stack", stack)
    return top.select(
        "thread",
        F.col("s.id").alias("span"),
        F.element_at("stack", -1).alias("function"),
        (F.col("s.n") - 1).cast("long").alias("depth"),
        F.col("s.start_ns").alias("start_ns"),
        F.col("s.end_ns").alias("end_ns"),
        (F.lit(int(at_ns)) - F.col("s.start_ns")).alias("elapsed_ns"),
        "stack",
    )


def _climbed(state: DataFrame, everyone: DataFrame, max_frames: int) -> DataFrame:
    """A few open spans with the names of their ancestors."""
    for levels in range(0, max_frames + 1, CLIMB):
        if state.filter("next is not null").isEmpty():
            break
        for _ in range(min(CLIMB, max_frames + 1 - levels)):
            up = everyone.select(F.col("id").alias("next"), F.col("parent").alias("then"), F.coalesce("name", F.lit(UNKNOWN)).alias("outer"))
            up = up.join(F.broadcast(state.filter("next is not null").select("next").distinct()), "next")
            joined = state.join(F.broadcast(up), "next", "left")
            names = F.when(F.col("outer").isNotNull(), F.concat(F.array("outer"), "names")).otherwise(F.col("names"))
            state = joined.select("id", "thread", "start_ns", "end_ns", F.col("then").alias("next"), names.alias("names"))
        state = cut(state, "open-spans")
    return state


def row_rank(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``ord``, its rank in the order, from 1; rows that tie are numbered as they come.

    Rows are written in sorted ranges, numbered within each, and the ranges' sizes
    tell where each begins: no task ranks everything.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = cut(ranged.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__k")), "ranked")
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    base = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    # One row for each range.
    return ranged.join(F.broadcast(base), "__part").withColumn("ord", (F.col("__base") + F.col("__k") + 1).cast("long")).drop("__part", "__k", "__base")
