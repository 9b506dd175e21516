"""Addresses of a process to image, function and inline frames (JN4 to JN8)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathglass.operators import symbols
from pathglass.storage import counted, cut


class Images(NamedTuple):
    """What is known of the images: ``images`` (path, image_id), ``segments`` (image_id, file_off, file_size,
    vaddr), ``functions`` (image_id, id, name, start, end), ``inline`` (image_id, lo, hi, frames) and, where
    contents are kept, ``code`` (image_id, page, bytes)."""

    images: DataFrame
    segments: DataFrame
    functions: DataFrame
    inline: DataFrame
    code: DataFrame | None = None


def mappings_of(records: DataFrame) -> DataFrame:
    """(pid, start, end, pgoff, prot, path, seq, generation, valid_from): executable mappings, numbered by their record."""
    rows = records.filter("record_type = 'mmap' and len > 0")
    return rows.select("pid", "start", (F.col("start") + F.col("len")).alias("end"), F.coalesce("pgoff", F.lit(0).cast("long")).alias("pgoff"), "prot", "path", "seq", F.col("seq").alias("generation"), F.col("time_ns").alias("valid_from"))


def locate(probes: DataFrame, mappings: DataFrame, images: Images, keys: tuple[str, ...] = ("pid",)) -> DataFrame:
    """``probes`` (id, keys, ip, seq) with path, image_id, file_offset, image_offset, function, symbol, frames and inlined.

    The newest mapping before the probe that holds the address (JN4) names the image
    (JN7; an unknown image leaves the rest null). The image's segment turns the offset
    in the file into an address of the image; without one the offset itself stands
    (JN6, PRJ11). There the nearest function (JN5) and the inline frames (JN8) are.
    Distinct places of images are looked up, however often they ran.
    """
    hits = symbols.map_addresses(probes.select("id", *keys, "ip", "seq"), mappings.select(*keys, "start", "end", "seq", "generation", "pgoff", "path"), keys)
    known = counted(cut(images.images.groupBy("path").agg(F.min("image_id").alias("image_id")), "images"))
    hits = hits.join(known, "path", "left").withColumn("file_offset", F.col("ip") - F.col("map_start") + F.col("pgoff"))
    hits = cut(hits.select("id", "path", "image_id", "file_offset"), "mapped")
    places = cut(hits.filter("image_id is not null").select("image_id", "file_offset").distinct(), "places")
    found = symbols.file_offset_address(places.withColumn("id", F.struct("image_id", "file_offset")), images.segments).withColumn("address", F.coalesce("address", "file_offset"))
    named = symbols.symbolize(cut(found, "offsets"), images.functions)
    rows = symbols.inline_frames(cut(named, "named"), images.inline)
    facts = rows.select("image_id", "file_offset", F.col("address").alias("image_offset"), "function", "symbol", "frames", "inlined")
    out = hits.join(counted(cut(facts, "located")), ["image_id", "file_offset"], "left")
    return out.select(*hits.columns, "image_offset", "function", "symbol", "frames", "inlined")
