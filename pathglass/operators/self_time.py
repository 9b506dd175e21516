"""Self time: a span's duration without what its direct children cover (INT1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathglass.storage import counted, cut

#: Children of a span that one window group may hold, on average; a span with more is
#: cut into as many equal ranges of time, whose covered lengths add up. A child counts
#: as a range of its own only where it begins and ends; in between it covers all.
GROUP = 50_000


def self_times(spans: DataFrame, group: int = GROUP) -> DataFrame:
    """(id, self_ns) of complete spans with known times."""
    sure = "completeness = 'complete' and start_ns is not null and end_ns is not null"
    return with_self_times(spans.filter(sure).select("id", "completeness", "start_ns", "end_ns"), spans, group).select("id", "self_ns")


def with_self_times(rows: DataFrame, spans: DataFrame, group: int = GROUP) -> DataFrame:
    """``rows`` (id, completeness, start_ns, end_ns...) of ``spans`` with ``self_ns``.

    Children are clipped to their parent, empty ones ignored, overlaps counted
    once. Null if the span or any child is not complete or has an unknown time: then
    the self time is not certain. Rows and children meet in one shuffle; only
    spans with more than ``group`` children are cut.
    """
    sure = F.col("completeness").eqNullSafe("complete") & F.col("start_ns").isNotNull() & F.col("end_ns").isNotNull()
    children = spans.filter("parent is not null").select(F.col("parent").alias("id"), F.col("start_ns").alias("cs"), F.col("end_ns").alias("ce"), sure.alias("sure"))
    known = children.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("sure").alias("certain"))
    large = cut(known.filter(F.col("n") > group), "large-spans")
    if large.isEmpty():
        return _swept(rows, children, sure)
    # One for each ``group`` children at most.
    few = counted(large)
    rest = _swept(rows.join(few, "id", "left_anti"), children.join(few, "id", "left_anti"), sure)
    there = rows.join(few.withColumnsRenamed({"n": "__n", "certain": "__certain"}), "id")
    parents = there.filter(sure).select("id", F.col("start_ns").alias("ps"), F.greatest("start_ns", "end_ns").alias("pe"), F.col("__n").alias("n"), F.col("__certain").alias("certain"))
    own = _by_ranges(parents, children.join(few, "id", "left_semi"), group)
    return rest.unionByName(rows.join(few, "id", "left_semi").join(own, "id", "left"))


def _swept(rows: DataFrame, children: DataFrame, sure: Column) -> DataFrame:
    """``rows`` with ``self_ns``: each span's children are passed in order of their starts, behind the span itself."""
    kept = [c for c in rows.columns if c not in ("id", "start_ns", "end_ns")]
    parents = rows.select("id", F.lit(0).alias("side"), F.col("start_ns").alias("s"), F.col("end_ns").alias("e"), sure.alias("sure"), F.struct(*kept).alias("row"))
    both = parents.unionByName(children.select("id", F.lit(1).alias("side"), F.col("cs").alias("s"), F.col("ce").alias("e"), "sure", F.lit(None).cast(parents.schema["row"].dataType).alias("row")))
    order = Window.partitionBy("id").orderBy("side", "s", "e")
    both = both.withColumns({"ps": F.first("s").over(order), "pe": F.first(F.greatest("s", "e")).over(order)})
    # A child that is empty once clipped ends where it begins or before, and so covers nothing.
    child, begin, end = F.col("side") == 1, F.greatest("s", "ps"), F.least("e", "pe")
    seen = F.max(F.when(child, end)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("fresh", F.when(child, F.greatest(F.lit(0), end - F.greatest(begin, F.coalesce(seen, begin)))))
    whole = Window.partitionBy("id")
    both = both.withColumns({"covered": F.sum("fresh").over(whole), "certain": F.bool_and("sure").over(whole)}).filter("side = 0")
    own = F.when(F.col("certain"), F.col("pe") - F.col("ps") - F.coalesce("covered", F.lit(0)))
    return both.select("id", F.col("s").alias("start_ns"), F.col("e").alias("end_ns"), "row.*", own.alias("self_ns"))


def _by_ranges(parents: DataFrame, children: DataFrame, group: int) -> DataFrame:
    """(id, self_ns) of spans with very many children, cut into ranges of time."""
    parents = parents.withColumn("ranges", F.ceil(F.col("n") / group))
    width = F.greatest(F.lit(1), F.ceil((F.col("pe") - F.col("ps")) / F.col("ranges")))
    busy = parents.filter("certain").withColumn("width", width)
    clipped = children.join(busy, "id").withColumn("s", F.greatest("cs", "ps")).withColumn("e", F.least("ce", "pe")).filter("e > s")
    place = lambda t: F.floor((t - F.col("ps")) / F.col("width"))
    clipped = clipped.select("id", "ps", "width", "s", "e", place(F.col("s")).alias("first"), place(F.col("e") - 1).alias("last"))
    border = lambda k: F.col("ps") + k * F.col("width")
    head = F.struct(F.col("first").alias("range"), F.col("s").alias("s"), F.least(F.col("e"), border(F.col("first") + 1)).alias("e"))
    tail = F.struct(F.col("last").alias("range"), border(F.col("last")).alias("s"), F.col("e").alias("e"))
    pieces = clipped.select("id", F.explode(F.when(F.col("last") > F.col("first"), F.array(head, tail)).otherwise(F.array(head))).alias("p")).select("id", "p.*")
    before = Window.partitionBy("id", "range").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce(F.max("e").over(before), F.col("s"))))
    zero = F.lit(0).cast("long")
    parts = pieces.select("id", "range", fresh.alias("fresh")).groupBy("id", "range").agg(F.sum("fresh").alias("part")).withColumn("step", zero)
    # Where whole ranges begin and cease to be covered, by how many children.
    steps = clipped.filter("last > first + 1").select("id", F.explode(F.array(F.struct((F.col("first") + 1).alias("range"), F.lit(1).cast("long").alias("step")), F.struct(F.col("last").alias("range"), F.lit(-1).cast("long").alias("step")))).alias("p"))
    steps = steps.select("id", "p.*").groupBy("id", "range").agg(F.sum("step").alias("step")).withColumn("part", zero)
    along = Window.partitionBy("id").orderBy("range")
    points = parts.unionByName(steps).groupBy("id", "range").agg(F.sum("part").alias("part"), F.sum("step").alias("step"))
    points = points.withColumn("deep", F.sum("step").over(along)).withColumn("until", F.lead("range").over(along)).join(busy.select("id", "width"), "id")
    covered = points.groupBy("id").agg(F.sum(F.when(F.col("deep") > 0, (F.col("until") - F.col("range")) * F.col("width")).otherwise(F.col("part"))).alias("covered"))
    rows = parents.join(covered, "id", "left")
    own = F.col("pe") - F.col("ps") - F.coalesce("covered", F.lit(0))
    return rows.select("id", F.when(F.col("certain"), own).alias("self_ns"))
