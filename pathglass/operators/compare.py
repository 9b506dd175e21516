"""Run-to-run comparison of hot paths (CMP): rows paired by explicit ids, else by linkage stem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathglass.functions.scalars import linkage_stem, path_leaf, relative_delta
from pathglass.operators.call_paths import row_rank
from pathglass.storage import cut

UNIT = "ns_decoder_estimate"


def comparable(baseline: dict, candidate: dict) -> dict[str, bool]:
    """The checks a performance comparison needs, from the two sides' manifests."""
    same = lambda *keys: all(baseline.get(k) == candidate.get(k) for k in keys)
    return {
        "workload": bool(baseline.get("workload_fingerprint")) and same("workload_fingerprint"),
        "cpu": same("cpu_vendor", "cpu_model"),
        "events": same("event_spec", "timing_profile"),
        "decoder": bool(baseline.get("dialect")) and same("dialect", "decoder_version", "decode_mode", "ir_version", "schema_version"),
    }


def _explicit(rows: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """(pair, row number) of the first row, in hot-path order, that each pair's id names (JN10)."""
    ids = pairs.select("pair", F.col(side).alias("ending"))
    # A path ends with an id if its ending of that length is the id. A request names a few pairs, so a few lengths.
    lengths = sorted(r["n"] for r in ids.select(F.length("ending").alias("n")).distinct().collect())
    if not lengths:
        return rows.select(F.lit(0).alias("pair"), "place").limit(0)
    ended = rows.select("path", "place", F.explode(F.array(*map(F.lit, lengths))).alias("n")).withColumn("ending", F.expr("right(path, n)"))
    hits = ended.join(F.broadcast(ids), "ending")
    return hits.groupBy("pair").agg(F.min("place").alias("place"))


def compare_hotpaths(baseline: DataFrame, candidate: DataFrame, pairs: list[tuple[str, str]] = (), allow_performance: bool = True) -> DataFrame:
    """A row for each pair and each row without partner; ``ord`` is their order.

    Explicit pairs come first. Then every other baseline row: ``ambiguous`` if its
    stem (the path's last name without linkage hash) stands for several rows on
    either side, ``path`` or ``demangled_path`` if one candidate is left with it,
    else ``unmatched``. Left candidates are ``ambiguous`` if several share their
    stem, else ``unmatched``. Deltas need permission, a match and both sums.
    """
    spark = baseline.sparkSession

    def numbered(df: DataFrame) -> DataFrame:
        df = df.select("path", "inclusive_sum_ns", "complete_calls", "excluded_incomplete").withColumn("stem", linkage_stem(path_leaf(F.col("path"))))
        # Paths are distinct, and so are the numbers: hot-path order.
        place = F.struct((-F.coalesce("inclusive_sum_ns", F.lit(-1))).alias("a"), "path")
        counts = df.groupBy("stem").agg(F.count(F.lit(1)).alias("n"))
        return df.join(counts, "stem").withColumn("place", place)

    b, c = cut(numbered(baseline), "baseline-rows"), cut(numbered(candidate), "candidate-rows")
    wanted = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(pairs)], "pair int, b string, c string")
    named = wanted.join(_explicit(b, wanted, "b").withColumnRenamed("place", "bp"), "pair", "left").join(_explicit(c, wanted, "c").withColumnRenamed("place", "cp"), "pair", "left").filter("bp is not null or cp is not null").select("pair", "bp", "cp")
    b_rows = b.select(F.col("place").alias("bp"), F.struct("path", "inclusive_sum_ns", "complete_calls", "excluded_incomplete").alias("b"))
    c_rows = c.select(F.col("place").alias("cp"), F.struct("path", "inclusive_sum_ns", "complete_calls", "excluded_incomplete").alias("c"))
    first = named.join(b_rows, "bp", "left").join(c_rows, "cp", "left")
    first = first.select(F.lit(0).alias("phase"), F.struct(F.col("pair").cast("long").alias("a"), F.lit("").alias("path")).alias("at"), "b", "c", F.when(F.col("b").isNotNull() & F.col("c").isNotNull(), "explicit_pair").otherwise("unmatched").alias("match_kind"))

    free_b = b.join(named.select(F.col("bp").alias("place")), "place", "left_anti")
    free_c = c.join(named.select(F.col("cp").alias("place")), "place", "left_anti")
    side_c = free_c.select(F.col("stem").alias("c_stem"), F.struct("path", "inclusive_sum_ns", "complete_calls", "excluded_incomplete").alias("c"))
    counts_c = c.groupBy("stem").agg(F.count(F.lit(1)).alias("c_n"))
    rows = free_b.join(counts_c, "stem", "left").withColumn("c_n", F.coalesce("c_n", F.lit(0)))
    vague = (F.col("n") > 1) | (F.col("c_n") > 1)
    # Where neither side is vague a stem has one row a side at most.
    rows = rows.withColumn("vague", vague).join(side_c, ~F.col("vague") & (F.col("stem") == F.col("c_stem")), "left")
    kind = F.when(F.col("vague"), "ambiguous").when(F.col("c").isNull(), "unmatched").when(F.col("c.path") == F.col("path"), "path").otherwise("demangled_path")
    second = rows.select(F.lit(1).alias("phase"), F.col("place").alias("at"), F.struct("path", "inclusive_sum_ns", "complete_calls", "excluded_incomplete").alias("b"), "c", kind.alias("match_kind"))
    matched = rows.filter("c is not null").select(F.col("c.path").alias("path"))
    rest = free_c.join(matched, "path", "left_anti")
    third = rest.select(F.lit(2).alias("phase"), F.col("place").alias("at"), F.lit(None).cast(second.schema["b"].dataType).alias("b"), F.struct("path", "inclusive_sum_ns", "complete_calls", "excluded_incomplete").alias("c"), F.when(F.col("n") > 1, "ambiguous").otherwise("unmatched").alias("match_kind"))

    paired = F.col("match_kind").isin("explicit_pair", "path", "demangled_path")
    allowed = paired & F.lit(allow_performance)
    delta = F.when(allowed, F.col("c.inclusive_sum_ns") - F.col("b.inclusive_sum_ns"))
    out = first.unionByName(second).unionByName(third)
    out = row_rank(out, F.col("phase"), F.col("at"))
    side = lambda s: (
        F.when(F.col(s).isNotNull(), F.coalesce(F.col(f"{s}.inclusive_sum_ns"), F.lit(0))),
        F.col(f"{s}.complete_calls"),
        F.col(f"{s}.excluded_incomplete"),
    )
    (bv, bn, be), (cv, cn, ce) = side("b"), side("c")
    return out.select(
        "ord",
        F.coalesce("b.path", "c.path").alias("path"),
        bv.alias("baseline_value"),
        bn.alias("baseline_n"),
        be.alias("baseline_exclusions"),
        cv.alias("candidate_value"),
        cn.alias("candidate_n"),
        ce.alias("candidate_exclusions"),
        delta.alias("absolute_delta"),
        F.when(delta.isNotNull(), relative_delta(delta, F.col("b.inclusive_sum_ns"))).alias("relative_delta"),
        F.lit(UNIT).alias("unit"),
        F.when(allowed, "per_matched_path").otherwise("raw_selected_region").alias("normalization"),
        "match_kind",
    )
