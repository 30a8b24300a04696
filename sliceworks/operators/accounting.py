"""Capacity and usage accounting. Objects, slices and volumes are relations; sums combine before they shuffle.

Missing sizes count as 0, missing rows as zeros, and totals of no rows are zeros, never null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .namespace import materialise

COUNTERS = ("object_count", "logical_bytes", "data_slice_count", "parity_slice_count", "data_bytes", "parity_bytes", "physical_bytes")


def _size() -> Column:
    return F.coalesce(F.col("size"), F.lit(0)).cast("bigint")


def _stored() -> Column:
    return S.slice_size(F.col("size"), F.col("chunk_size"), F.col("data_n"))


def _total(value: Column, name: str) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias(name)


def system_usage(objects: DataFrame) -> DataFrame:
    """One row: the seven counters over all objects."""
    data, parity = _stored() * F.col("data_n"), _stored() * F.col("parity_n")
    return objects.agg(
        F.count(F.lit(1)).alias("object_count"), _total(_size(), "logical_bytes"), _total(F.col("data_n"), "data_slice_count"), _total(F.col("parity_n"), "parity_slice_count"),
        _total(data, "data_bytes"), _total(parity, "parity_bytes"), _total(data + parity, "physical_bytes"),
    )


def volume_usage(slices: DataFrame, objects: DataFrame) -> DataFrame:
    """Per volume: slices by type and their bytes, each slice counted; objects and their bytes, each object counted once.

    One shuffle by object joins sizes to slices and folds an object's slices on a volume into one row; one by volume sums.
    """
    sized = objects.select("object_id", _size().alias("logical"), _stored().alias("stored"))
    by_object = slices.groupBy("object_id", "volume_id").agg(F.count_if(F.col("slice_type") == "data").alias("d"), F.count_if(F.col("slice_type") == "parity").alias("p"))
    return (
        by_object.join(sized, "object_id")
        .groupBy("volume_id")
        .agg(
            F.count(F.lit(1)).alias("object_count"), _total(F.col("logical"), "logical_bytes"), _total(F.col("d"), "data_slice_count"), _total(F.col("p"), "parity_slice_count"),
            _total(F.col("d") * F.col("stored"), "data_bytes"), _total(F.col("p") * F.col("stored"), "parity_bytes"), _total((F.col("d") + F.col("p")) * F.col("stored"), "physical_bytes"),
        )
    )


def usage_snapshot(slices: DataFrame, objects: DataFrame) -> DataFrame:
    """The system's row (null volume) and those of all volumes."""
    system = system_usage(objects).withColumn("volume_id", F.lit(None).cast("bigint"))
    return system.unionByName(volume_usage(slices, objects).withColumn("volume_id", F.col("volume_id").cast("bigint")))


def unavailable_recomputed(objects: DataFrame, slices: DataFrame, volumes: DataFrame) -> DataFrame:
    """Objects whose distinct unreadable data volumes and distinct unreadable parity volumes together outnumber their parity slices."""
    down = volumes.filter(~S.readable()).select("volume_id")
    lost = slices.join(down, "volume_id").select("object_id", "slice_type", "volume_id").distinct().groupBy("object_id").agg(F.count(F.lit(1)).alias("lost"))
    return objects.join(lost, "object_id").filter(F.col("lost") > F.col("parity_n"))


def unavailable_incremental(objects: DataFrame, slices: DataFrame, volumes: DataFrame) -> DataFrame:
    """Objects with fewer slices on readable volumes, each counted, than data slices."""
    up = volumes.filter(S.readable()).select("volume_id")
    there = slices.join(up, "volume_id").groupBy("object_id").agg(F.count(F.lit(1)).alias("there"))
    return objects.join(there, "object_id", "left").filter(F.coalesce("there", F.lit(0)) < F.col("data_n"))


def refreshed_unavailable(stored: DataFrame, objects: DataFrame, slices: DataFrame, volumes: DataFrame) -> DataFrame:
    """The stored row of totals with its part on unavailable objects counted again; the other columns stay."""
    now = totals(unavailable_recomputed(objects, slices, volumes)).select(F.col("object_count").alias("_n"), F.col("logical_bytes").alias("_b"))
    kept = [c for c in stored.columns if c not in ("unavailable_object_count", "unavailable_logical_bytes")]
    return stored.select(*kept).join(F.broadcast(now)).select(*kept, F.col("_n").alias("unavailable_object_count"), F.col("_b").alias("unavailable_logical_bytes"))  # one row each


def reconciled(objects_now: Callable[[], DataFrame], passes: int = 3) -> tuple[DataFrame, int]:
    """System totals counted again until nothing has changed while they were counted, ``passes`` times at most, and how many passes it took.

    ``objects_now`` reads the table as it is; a digest of it before and after a pass tells whether it has changed.
    """
    def digest() -> tuple:
        return tuple(objects_now().agg(F.count(F.lit(1)), F.sum(F.xxhash64("object_id", "size", "data_n", "parity_n").cast("decimal(38,0)"))).first())

    before = digest()
    for n in range(1, passes + 1):
        found = materialise(system_usage(objects_now()))
        after = digest()
        if after == before:
            break
        before = after
    return found, n


def totals(objects: DataFrame) -> DataFrame:
    return objects.agg(F.count(F.lit(1)).alias("object_count"), _total(_size(), "logical_bytes"))


def bucket_usage(objects: DataFrame) -> DataFrame:
    return objects.filter(F.col("bucket_id").isNotNull()).groupBy("bucket_id").agg(F.count(F.lit(1)).alias("object_count"), _total(_size(), "logical_bytes"))


def object_deltas(objects: DataFrame, slices: DataFrame, sign: Column) -> DataFrame:
    """Signed counter changes that objects bring to the system (null volume) and to each of their volumes."""
    data, parity = _stored() * F.col("data_n"), _stored() * F.col("parity_n")
    signed = objects.withColumn("_sign", sign.cast("bigint"))
    system = signed.select(
        F.lit(None).cast("bigint").alias("volume_id"), "object_id", F.col("_sign").alias("object_count"), (F.col("_sign") * _size()).alias("logical_bytes"), (F.col("_sign") * F.col("data_n")).alias("data_slice_count"),
        (F.col("_sign") * F.col("parity_n")).alias("parity_slice_count"), (F.col("_sign") * data).alias("data_bytes"), (F.col("_sign") * parity).alias("parity_bytes"), (F.col("_sign") * (data + parity)).alias("physical_bytes"),
    )
    by_object = slices.groupBy("object_id", "volume_id").agg(F.count_if(F.col("slice_type") == "data").alias("d"), F.count_if(F.col("slice_type") == "parity").alias("p"))
    own = signed.join(by_object, "object_id").select(
        F.col("volume_id").cast("bigint").alias("volume_id"), "object_id", F.col("_sign").alias("object_count"), (F.col("_sign") * _size()).alias("logical_bytes"), (F.col("_sign") * F.col("d")).alias("data_slice_count"),
        (F.col("_sign") * F.col("p")).alias("parity_slice_count"), (F.col("_sign") * F.col("d") * _stored()).alias("data_bytes"), (F.col("_sign") * F.col("p") * _stored()).alias("parity_bytes"),
        (F.col("_sign") * (F.col("d") + F.col("p")) * _stored()).alias("physical_bytes"),
    )
    return system.unionByName(own)


def relocation_deltas(moves: DataFrame) -> DataFrame:
    """Changes of moves (object_id, slice_type, source, target, size, stored): the source loses what the target gains; the system is unchanged."""
    ends = moves.withColumn("_end", F.explode(F.array(F.struct(F.col("source").alias("volume_id"), F.lit(-1).alias("sign")), F.struct(F.col("target").alias("volume_id"), F.lit(1).alias("sign")))))
    sign, data = F.col("_end.sign").cast("bigint"), F.col("slice_type") == "data"
    return ends.select(
        F.col("_end.volume_id").cast("bigint").alias("volume_id"), "object_id", sign.alias("object_count"), (sign * _size()).alias("logical_bytes"), F.when(data, sign).otherwise(0).cast("bigint").alias("data_slice_count"),
        F.when(data, 0).otherwise(sign).cast("bigint").alias("parity_slice_count"), F.when(data, sign * F.col("stored")).otherwise(0).cast("bigint").alias("data_bytes"),
        F.when(data, 0).otherwise(sign * F.col("stored")).cast("bigint").alias("parity_bytes"), (sign * F.col("stored")).alias("physical_bytes"),
    )


def merge_deltas(deltas: DataFrame) -> DataFrame:
    """Net change by volume, without volumes whose counters all cancel."""
    merged = deltas.groupBy("volume_id").agg(*[_total(F.col(c), c) for c in COUNTERS])
    changed = F.col(COUNTERS[0]) != 0
    for c in COUNTERS[1:]:
        changed = changed | (F.col(c) != 0)
    return merged.filter(changed)


def apply_deltas(stats: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counters after the changes, and whether any fell below zero, so that all must be counted anew."""
    both = stats.select("volume_id", *COUNTERS).unionByName(deltas.select("volume_id", *COUNTERS))
    summed = both.groupBy("volume_id").agg(*[_total(F.col(c), c) for c in COUNTERS])
    negative = F.col(COUNTERS[0]) < 0
    for c in COUNTERS[1:]:
        negative = negative | (F.col(c) < 0)
    return summed.withColumn("negative", negative)


def pool_fill(volumes: DataFrame, deadband: float = 0.02) -> DataFrame:
    """One row: the pool's fill, and the bytes above it on volumes fuller than the fill and the deadband."""
    pool = volumes.filter(~F.col("deleted"))
    used = F.col("bytes_total") - (F.coalesce("bytes_free", F.lit(0)) - F.col("bytes_pending"))
    target = pool.agg((F.sum(used).cast("double") / F.sum("bytes_total").cast("double")).alias("target"))
    own = S.fill(F.col("bytes_total"), F.col("bytes_free"), F.col("bytes_pending"))
    over = pool.join(F.broadcast(target)).withColumn("fill", own)
    excess = F.when(F.col("fill") > F.col("target") + deadband, (F.col("fill") - F.col("target")) * F.col("bytes_total")).otherwise(0.0)
    return over.agg(F.round(F.first("target"), 9).alias("target"), F.round(F.sum(excess)).cast("bigint").alias("bytes_to_move"), F.count_if(excess > 0).alias("sources"))


def fleet_status(volumes: DataFrame) -> DataFrame:
    def listed(condition: Column, name: str) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(condition, F.col("volume_id")))), ",").alias(name)

    live = ~F.col("deleted")
    return volumes.agg(
        listed(live & F.col("enabled") & S.readable(), "available"), listed(live & F.col("enabled") & ~S.readable(), "unavailable"), listed(live & ~F.col("enabled"), "disabled"), listed(live & F.col("read_only"), "read_only_volumes"),
        F.round(F.sum(F.when(live, F.col("bytes_total"))) / float(1 << 30), 6).alias("total_gb"), F.round(F.sum(F.when(live, F.coalesce("bytes_free", F.lit(0)))) / float(1 << 30), 6).alias("free_gb"),
    )


def utilisation(volumes: DataFrame) -> DataFrame:
    live = volumes.filter(~F.col("deleted") & F.col("started"))
    free = F.coalesce("bytes_free", F.lit(0))
    return live.agg(
        _total(F.col("bytes_total"), "total"), _total(F.col("bytes_data"), "data"), _total(F.col("bytes_parity"), "parity"), _total(free, "free"),
        _total(F.col("bytes_total") - F.col("bytes_data") - F.col("bytes_parity") - free, "other"), F.count_distinct("device_group").alias("groups"),
    )


def domain_load(slices: DataFrame, volumes: DataFrame, moving: int | None = None) -> DataFrame:
    """Slices of each object by failure domain, without those on a volume that is being emptied."""
    domains = volumes.select("volume_id", S.failure_domain(F.col("device_group"), F.col("volume_id")).alias("domain"))
    kept = slices if moving is None else slices.filter(F.col("volume_id") != moving)
    return kept.join(domains, "volume_id", "left").groupBy("object_id", F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(F.count(F.lit(1)).alias("load"))
