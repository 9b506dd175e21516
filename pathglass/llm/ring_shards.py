"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (operator 2).

Rows and virtual nodes hash onto a ring of fixed cells. A row belongs to the first
virtual node clockwise; that node's shard takes rows up to its bound, and rows
beyond it continue clockwise to the next shards with room. The bounds add up to
the number of rows, so shard sizes differ by one row at most and only the excess
moves. Everything is DataFrame functions: the walk around the ring runs over one
row that holds a count for each virtual node, whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathglass.llm.common import materialise

#: Cells of the ring; each is ranked on its own, so rows spread over this many groups.
CELLS = 1 << 16
#: Virtual nodes of a shard.
REPLICAS = 64


def ring(spark: SparkSession, shards: int, replicas: int = REPLICAS, cells: int = CELLS) -> DataFrame:
    """(cell, arc, shard): the first virtual node at or clockwise after each cell; ``arc`` is its place."""
    nodes = spark.range(shards * replicas).select((F.col("id") % shards).cast("int").alias("shard"), F.pmod(F.xxhash64(F.lit("node"), "id"), F.lit(cells)).cast("int").alias("arc"))
    nodes = nodes.groupBy("arc").agg(F.min("shard").alias("shard"))
    clockwise = Window.orderBy("arc")  # a constant number of rows
    owned = nodes.withColumn("first", F.lag("arc", 1, -1).over(clockwise) + 1).withColumn("place", F.row_number().over(clockwise)).withColumn("last", F.max("arc").over(Window.partitionBy()))
    own = F.sequence("first", "arc")
    # The cells behind the last node wrap around to the first one.
    wraps = (F.col("place") == 1) & (F.col("last") < cells - 1)
    own = F.when(wraps, F.concat(own, F.sequence(F.col("last") + 1, F.lit(cells - 1)))).otherwise(own)
    return owned.select(F.explode(own).alias("cell"), "arc", "shard")


def _allot(arcs: DataFrame, shards: int) -> DataFrame:
    """(arc, base, kept, moved) from (arc, shard, n).

    Of an arc's rows, the first ``kept`` stay at its shard, from slot ``base``;
    ``moved`` holds (off, len, shard, slot) for the others, ``off`` counted from
    the first moved row of the arc.
    """
    one = arcs.agg(F.array_sort(F.collect_list(F.struct("arc", "shard", "n"))).alias("arcs"))
    one = one.withColumn("total", F.expr("aggregate(arcs, 0L, (s, a) -> s + a.n)"))
    one = one.withColumn("bounds", F.expr(f"transform(sequence(0, {shards - 1}), i -> total div {shards} + if(i < total % {shards}, 1L, 0L))"))
    home = f"""aggregate(arcs,
        named_struct('loads', array_repeat(0L, {shards}), 'out', cast(array() as array<struct<arc: int, shard: int, n: bigint, base: bigint, kept: bigint>>)),
        (s, a) -> named_struct(
            'loads', transform(s.loads, (l, i) -> if(i = a.shard, least(bounds[i], l + a.n), l)),
            'out', concat(s.out, array(named_struct('arc', a.arc, 'shard', a.shard, 'n', a.n, 'base', s.loads[a.shard], 'kept', least(a.n, bounds[a.shard] - s.loads[a.shard]))))))"""
    one = one.withColumn("home", F.expr(home))
    walk = f"""aggregate(
        array_distinct(slice(concat(shards, shards), x.i + 2, size(shards))),
        named_struct('rest', x.a.n - x.a.kept, 'loads', s.loads, 'out', cast(array() as array<struct<off: bigint, len: bigint, shard: int, slot: bigint>>)),
        (w, k) -> if(w.rest = 0 or w.loads[k] = bounds[k], w, named_struct(
            'rest', w.rest - least(w.rest, bounds[k] - w.loads[k]),
            'loads', transform(w.loads, (l, i) -> if(i = k, least(bounds[k], l + w.rest), l)),
            'out', concat(w.out, array(named_struct('off', x.a.n - x.a.kept - w.rest, 'len', least(w.rest, bounds[k] - w.loads[k]), 'shard', k, 'slot', w.loads[k]))))))"""
    moved = f"""aggregate(
        transform(home.out, (a, i) -> named_struct('a', a, 'i', i)),
        named_struct('loads', home.loads, 'out', cast(array() as array<struct<arc: int, base: bigint, kept: bigint, moved: array<struct<off: bigint, len: bigint, shard: int, slot: bigint>>>>)),
        (s, x) -> element_at(transform(array({walk}), w -> named_struct(
            'loads', w.loads,
            'out', concat(s.out, array(named_struct('arc', x.a.arc, 'base', x.a.base, 'kept', x.a.kept, 'moved', w.out))))), 1)).out"""
    one = one.withColumn("shards", F.expr("transform(arcs, a -> a.shard)"))
    return one.select(F.explode(F.expr(moved)).alias("m")).select("m.*")


def _size(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def assign_shards(docs: DataFrame, shards: int = 24, replicas: int = REPLICAS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) for every row; the law is ``rows``.

    A row's place on the ring comes from its id and text, so null or repeated ids
    do not pile up unless whole rows repeat; repeated rows stand next to each other
    and still count one by one. A null text has size 8 and the checksum of no
    bytes. An empty table gives no rows. Other columns are not read.
    ``grown_shard`` is null: under this law a new shard takes rows from all.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("__id"),
        _size(text_col).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(id_col, text_col).alias("__h"),
    ).withColumn("__cell", F.pmod("__h", F.lit(CELLS)).cast("int"))
    rows = materialise(rows, "ring")  # read twice: a few bytes for each row instead of its text

    cells = rows.groupBy("__cell").agg(F.count(F.lit(1)).alias("n")).join(ring(spark, shards, replicas).withColumnRenamed("cell", "__cell"), "__cell")
    cells = cells.withColumn("before", F.sum("n").over(Window.partitionBy("arc").orderBy("__cell")) - F.col("n"))
    allotted = _allot(cells.groupBy("arc", "shard").agg(F.sum("n").alias("n")), shards)
    cells = cells.join(allotted, "arc").select("__cell", "before", F.col("shard").alias("home"), "base", "kept", "moved")

    in_cell = Window.partitionBy("__cell").orderBy("__h", "__id", "text_crc32")
    placed = rows.withColumn("k", F.row_number().over(in_cell) - 1).join(cells, "__cell").withColumn("k", F.col("before") + F.col("k"))
    placed = placed.withColumn("m", F.expr("get(filter(moved, s -> k - kept >= s.off and k - kept < s.off + s.len), 0)"))
    stays = F.col("k") < F.col("kept")
    return placed.select(
        F.col("__id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.when(stays, F.col("home")).otherwise(F.col("m.shard")).cast("int").alias("shard"),
        F.when(stays, F.col("base") + F.col("k")).otherwise(F.col("m.slot") + F.col("k") - F.col("kept") - F.col("m.off")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
