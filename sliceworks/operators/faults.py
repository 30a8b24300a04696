"""Slice faults: coalescing, triage, repair eligibility and volume health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .namespace import materialise

DEGRADE_AFTER = 10
RETRY_SECONDS = 3600
TERMINAL = ("unrecoverable", "reconstruction-mismatch")


def coalesce_faults(observations: DataFrame) -> DataFrame:
    """One row a fault: first and last time, count, the last code and message that were given, the first source."""
    keyed = observations.withColumn("key", S.fault_key(F.col("volume_id"), F.col("object_id"), F.col("slice_index"))).withColumn("_at", F.struct("ts", "event_id"))
    return keyed.groupBy("key").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"), F.max_by("code", F.when(F.col("code").isNotNull(), F.col("_at"))).alias("code"),
        F.max_by("message", F.when(F.col("message").isNotNull(), F.col("_at"))).alias("message"), F.min_by("source", "_at").alias("source"), F.min_by("is_checksum", "_at").alias("is_checksum"),
    )


def degraded_volumes(faults: DataFrame, volumes: DataFrame, threshold: int = DEGRADE_AFTER) -> DataFrame:
    """Volumes to mark unhealthy: enough faults or bad SMART flags, unless deleted, read-only or unhealthy already."""
    counts = faults.groupBy("volume_id").agg(F.count(F.lit(1)).alias("faults"))
    judged = volumes.join(counts, "volume_id", "left").filter(~F.col("deleted") & ~F.col("read_only") & F.col("healthy"))
    n = F.coalesce("faults", F.lit(0))
    return judged.filter((n >= threshold) | S.smart_unhealthy(F.col("smart_exit"))).select("volume_id", n.alias("faults"), S.smart_unhealthy(F.col("smart_exit")).alias("smart_bad"))


def verify_errors(slices: DataFrame) -> DataFrame:
    """Errors by volume, without those that only mean a shutdown."""
    bad = slices.filter(F.col("error_code").isNotNull() & (F.col("error_code") != "IOABORT"))
    return bad.groupBy("volume_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("error_code").isin("ECHECKSUM", "EHDRSUM")).alias("checksum"))


def triaged(slices: DataFrame) -> DataFrame:
    """Each object's slices by verdict, its bucket, and whether a slice must be rebuilt."""
    category = F.when(F.col("error_code").isNotNull() & (F.col("error_code") != "IOABORT"), S.error_category(F.col("error_code")))
    counted = slices.withColumn("category", category).groupBy("object_id").agg(
        F.count_if(F.col("slice_type") == "data").alias("data_n"), F.count_if(F.col("category").isNull()).alias("good"), F.count_if(F.col("category") == "volume-unavailable").alias("unavailable"),
        F.count_if(F.col("category") == "header-mismatch").alias("restamp"), F.count_if(F.col("category").isNotNull() & ~F.col("category").isin("volume-unavailable", "header-mismatch")).alias("corrupt"),
    )
    bucket = S.triage(F.col("good"), F.col("unavailable"), F.col("restamp"), F.col("data_n"))
    return counted.withColumn("bucket", bucket).withColumn("needs_rebuild", (F.col("corrupt") > 0) & (F.col("bucket") != "lost"))


def flagged_diagnosis(slices: DataFrame, volumes: DataFrame, objects: DataFrame, headers: DataFrame) -> DataFrame:
    """Each flagged slice with what is behind its flag: its volume is unavailable, its file is missing, its disk fails, its data are bad, or
    only its header needs to be written again; then also whether the header names an object that exists.

    headers: object_id, slice_index, header_id.
    """
    up = volumes.filter(S.readable()).select("volume_id", F.lit(True).alias("_up"))
    named = headers.join(objects.select(F.col("object_id").alias("header_id"), F.lit(True).alias("_real")), "header_id", "left").select("object_id", "slice_index", "_real").dropDuplicates(["object_id", "slice_index"])
    category = S.error_category(F.col("error_code"))
    found = F.when(F.col("_up").isNull(), "volume-unavailable").when(category == "missing", "file-missing").when(category.isin("io", "timeout", "volume-unavailable"), "io-error").when(category.isin("checksum", "parity-mismatch"), "data-bad").otherwise("restampable")
    flagged = slices.filter(F.col("error_code").isNotNull()).join(up, "volume_id", "left").join(named, ["object_id", "slice_index"], "left")
    return flagged.withColumn("diagnosis", found).withColumn("names_real", (F.col("diagnosis") == "restampable") & F.coalesce("_real", F.lit(False))).drop("_up", "_real")


def diagnosed_objects(diagnosed: DataFrame) -> DataFrame:
    """object_id and class: has-data-bad, volume-unavailable (and nothing to restamp), mixed (both), or all-restampable."""
    has = lambda d: F.bool_or(F.col("diagnosis") == d)
    down, again = has("volume-unavailable"), has("restampable")
    kind = F.when(has("data-bad"), "has-data-bad").when(down & ~again, "volume-unavailable").when(down & again, "mixed").otherwise("all-restampable")
    return diagnosed.groupBy("object_id").agg(kind.alias("class"))


def repair_passes(faults: DataFrame, verdicts: DataFrame, batch: int = 25) -> DataFrame:
    """The repair queue in passes of ``batch`` faults by key: key, pass, verdict, and whether it is the fault at which its object is verified in that pass (the others of the pass take what was found).

    faults: key, object_id, eligible. Keys are numbered in ranges, so no task sees them all.
    """
    waiting = faults.filter("eligible").select("key", "object_id")
    ranged = waiting.repartitionByRange("key").withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))  # a row a range
    place = F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy("key")) - 1
    numbered = ranged.join(starts, "_part").withColumn("pass", F.floor(place / batch).cast("int"))
    first = F.row_number().over(Window.partitionBy("pass", "object_id").orderBy("key")) == 1
    return numbered.join(verdicts.select("object_id", "verdict"), "object_id", "left").select("key", "pass", F.coalesce("verdict", F.lit("gone")).alias("verdict"), first.alias("verifies"))


def category_histogram(slices: DataFrame) -> DataFrame:
    return slices.filter(F.col("error_code").isNotNull()).groupBy(S.error_category(F.col("error_code")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def lost_by_container(triaged_objects: DataFrame, objects: DataFrame, top: int = 10) -> DataFrame:
    lost = triaged_objects.filter("bucket = 'lost'").join(objects.select("object_id", "container_id"), "object_id")
    return lost.groupBy("container_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "container_id").limit(top)


def repairable(faults: DataFrame, volumes: DataFrame) -> DataFrame:
    """Faults with ``eligible``: blocked ones wait for a writable target or for an hour, some reasons for ever.

    faults: key, volume_id, status, reason, last_attempt, blocked_at, last_seen, now.
    """
    targets = volumes.select(F.col("volume_id").alias("_v"), (S.writable() & ~F.col("deleted")).alias("_w"))
    since = F.coalesce("last_attempt", "blocked_at", "last_seen")
    waited = F.col("now").cast("timestamp").cast("long") - since.cast("timestamp").cast("long") >= RETRY_SECONDS
    verdict = (
        F.when(~F.col("status").eqNullSafe("blocked"), True)
        .when(F.col("reason").isin(*TERMINAL), False)
        .when(F.col("reason") == "target-unwritable", F.coalesce("_w", F.lit(False)))
        .otherwise(waited)
    )
    return faults.join(targets, faults["volume_id"] == F.col("_v"), "left").withColumn("eligible", verdict).drop("_v", "_w")


def fault_disposition(faults: DataFrame, objects: DataFrame, slices: DataFrame) -> DataFrame:
    """What becomes of each fault: its object is gone, its slice has left the volume, or it is repaired."""
    known = objects.select(F.col("object_id").alias("_o"))
    there = slices.select(F.col("object_id").alias("_so"), F.col("slice_index").alias("_si"), F.col("volume_id").alias("_sv")).distinct()
    joined = faults.join(known, faults["object_id"] == F.col("_o"), "left").join(
        there, (faults["object_id"] == F.col("_so")) & (faults["slice_index"] == F.col("_si")) & (faults["volume_id"] == F.col("_sv")), "left"
    )
    verdict = F.when(F.col("_o").isNull(), "clear-missing").when(F.col("_so").isNull(), "clear-stale").otherwise("repair")
    return joined.withColumn("disposition", verdict).drop("_o", "_so", "_si", "_sv")


def escalations(reads: DataFrame) -> DataFrame:
    """Within one read of an object (object_id, seq, slice_index, code): a slice is dead at a hard code, or at its second soft fault."""
    hard = F.col("code").isin("ECHECKSUM", "EHEADER", "ENOENT", "EUNAVAIL")
    so_far = Window.partitionBy("object_id", "slice_index").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    seen = reads.withColumn("_n", F.count(F.lit(1)).over(so_far)).withColumn("_h", F.max(hard.cast("int")).over(so_far))
    return seen.withColumn("is_dead", (F.col("_h") == 1) | (F.col("_n") >= 2)).drop("_n", "_h")
