"""GPX files as DataFrames, by Spark's own XML reader: any number of files, namespaces ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINT = "array<struct<_lat:string,_lon:string,ele:string,time:string>>"
SCHEMA = f"name string, trkseg array<struct<trkpt:{POINT}>>, trkpt {POINT}"
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def tracks(spark: SparkSession, path: str) -> DataFrame:
    """(walk_id, name, trkseg, trkpt): a row a track; walk_id is the file's name."""
    rows = spark.read.format("xml").option("rowTag", "trk").option("ignoreNamespace", "true").option("mode", "PERMISSIVE").schema(SCHEMA).load(path)
    # the name comes percent-encoded
    return rows.withColumn("walk_id", F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))))


def read_fixes(spark: SparkSession, path: str) -> DataFrame:
    """FIXES of all files of path: points with unreadable coordinates are skipped, unreadable times are null.

    Points outside any segment make a segment of their own, as in files without segments.
    """
    none = F.array().cast(f"array<{POINT}>")
    segments = F.concat(F.coalesce(F.transform("trkseg", lambda s: s["trkpt"]), none), F.when(F.col("trkpt").isNotNull(), F.array("trkpt")).otherwise(none))
    rows = tracks(spark, path).select("walk_id", F.monotonically_increasing_id().alias("_trk"), F.posexplode(segments).alias("_seg", "pts"))
    pts = rows.select("walk_id", "_trk", "_seg", F.posexplode("pts").alias("fix_ord", "p"))
    number = lambda c: F.col(c).try_cast("double")
    made = pts.select(
        "walk_id", "_trk", "_seg", "fix_ord", number("p._lat").alias("lat"), number("p._lon").alias("lon"), (F.unix_micros(F.col("p.time").try_cast("timestamp")) / 1e6).alias("ts")
    ).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    order = Window.partitionBy("walk_id").orderBy("_trk", "_seg")
    return made.withColumn("seg_ord", F.dense_rank().over(order) - 1).select("walk_id", "seg_ord", "fix_ord", "lat", "lon", "ts")


def track_names(spark: SparkSession, path: str) -> DataFrame:
    """(walk_id, name): the first track's name that isn't blank."""
    rows = tracks(spark, path).select("walk_id", "name", F.monotonically_increasing_id().alias("_ord")).where(F.trim("name") != "")
    return rows.groupBy("walk_id").agg(F.min_by(F.trim("name"), "_ord").alias("name"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(walk_id, digest): sha256 of each file, by which imports are recognised."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("walk_id"), F.sha2("content", 256).alias("digest"))


def date_in_name(name: Column) -> Column:
    """The date of '<note> - Mon D, YYYY (n).gpx', as ISO text; null if there is none."""
    pattern = rf"- ({'|'.join(MONTHS)}) (\d{{1,2}}), (\d{{4}})(?: \(\d+\))?\.[^.]+$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    month = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)])
    day = F.try_to_date(F.concat_ws("-", part(3), F.lpad(F.try_element_at(month, part(1)).cast("string"), 2, "0"), F.lpad(part(2), 2, "0")))
    return F.when(part(1) != "", F.date_format(day, "yyyy-MM-dd"))


def dated_name(note: Column, date: Column, ext: str = "gpx", taken: Column | None = None) -> Column:
    """'<note> - Mon D, YYYY.ext', with ' (n)' from the second of one name on (taken: how many there are before)."""
    base = F.concat(note, F.lit(" - "), F.date_format(date.cast("date"), "MMM d, yyyy"))
    n = F.lit(0) if taken is None else taken
    return F.concat(base, F.when(n > 0, F.concat(F.lit(" ("), (n + 1).cast("string"), F.lit(")"))).otherwise(F.lit("")), F.lit(f".{ext}"))
