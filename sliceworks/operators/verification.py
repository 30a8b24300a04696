"""Verification state: worklists, staleness, merged times and errors, verdicts of a read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .namespace import materialise


def needs_verification(objects: DataFrame, slices: DataFrame, boundary: Column, volumes: Sequence[int] | None) -> DataFrame:
    """Objects whose own time is stale and, if volumes are named, that have a stale slice on one of them. An empty list asks for nothing."""
    old = objects.filter(S.stale(F.col("last_verified_at"), boundary))
    if volumes is None:
        return old
    touched = slices.filter(F.col("volume_id").isin(*volumes) & S.stale(F.col("verified_at"), boundary)).select("object_id")
    return old.join(touched, "object_id", "left_semi")


def worklist(objects: DataFrame, slices: DataFrame, boundary: Column, volumes: Sequence[int] | None, after: int | None, limit: int) -> DataFrame:
    """The next page of objects to verify, by id."""
    found = needs_verification(objects, slices, boundary, volumes)
    if after is not None:
        found = found.filter(F.col("object_id") > after)
    return found.orderBy("object_id").limit(limit)


def verified_since(objects: DataFrame, slices: DataFrame, boundary: Column, volumes: Sequence[int]) -> DataFrame:
    """Objects on one of the volumes with no stale slice there."""
    there = slices.filter(F.col("volume_id").isin(*volumes))
    fresh = there.groupBy("object_id").agg(F.max(S.stale(F.col("verified_at"), boundary).cast("int")).alias("old")).filter("old = 0")
    return objects.join(fresh.select("object_id"), "object_id", "left_semi")


def last_verified(slices: DataFrame) -> DataFrame:
    """The earliest time of each object's slices, null if a slice has none."""
    least = F.when(F.count("verified_at") == F.count(F.lit(1)), F.min("verified_at"))
    return slices.groupBy("object_id").agg(least.alias("last_verified"))


def verifiable(slices: DataFrame, volumes: DataFrame, wanted: Sequence[int] | None = None) -> DataFrame:
    """Slices on volumes that can be read and are healthy; ``skipped`` marks those that are being emptied."""
    good = volumes.filter(S.readable() & F.col("healthy") & ~F.col("deleted"))
    if wanted is not None:
        good = good.filter(F.col("volume_id").isin(*wanted))
    return slices.join(good.select("volume_id", F.col("draining").alias("skipped")), "volume_id")


def object_verdicts(headers: DataFrame, data_n: int = 4) -> DataFrame:
    """One verdict an object, the first that holds: an unreadable slice defers it, too few good ones, a corrupt one, a missing one, all well."""
    counts = headers.groupBy("object_id").agg(
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "unreadable").alias("unreadable"), F.count_if(F.col("status") == "corrupt").alias("corrupt"), F.count_if(F.col("status") == "absent").alias("absent")
    )
    verdict = (
        F.when(F.col("unreadable") > 0, "deferred").when(F.col("ok") < data_n, "below-quorum").when(F.col("corrupt") > 0, "corrupt").when(F.col("absent") > 0, "degraded").otherwise("healthy")
    )
    return counts.withColumn("verdict", verdict)


def verdict_rollup(verdicts: DataFrame, samples: int = 25) -> DataFrame:
    """Objects by verdict with the smallest ids as samples. The ids are ranked in partial groups, so none is gathered whole."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("verdict").orderBy("object_id"))
    few = verdicts.withColumn("_r", rank).filter(F.col("_r") <= samples).groupBy("verdict").agg(F.array_join(F.array_sort(F.collect_list("object_id")), ",").alias("sample"))
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).join(few, "verdict")


def covers(active: Sequence[int] | None, requested: Sequence[int] | None) -> bool:
    """Whether a running check of ``active`` volumes (None: all) also checks the requested ones."""
    if active is None:
        return True
    return requested is not None and set(requested) <= set(active)


def chunk_health(chunks: DataFrame) -> DataFrame:
    """Per object: chunks, how many of either parity slice are fine, how many can be recovered (data fine, and one parity), how often both fail and how often one, the share of recoverable ones and its bin.

    chunks: object_id, k, data_ok, a_ok, b_ok; an object's data count as fine only if all of its chunks' are.
    """
    whole = F.bool_and("data_ok").over(Window.partitionBy("object_id"))
    judged = chunks.withColumn("_good", whole & (F.col("a_ok") | F.col("b_ok")))
    per = judged.groupBy("object_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if("a_ok").alias("a_ok"), F.count_if("b_ok").alias("b_ok"), F.count_if("_good").alias("recoverable"), F.count_if(~F.col("a_ok") & ~F.col("b_ok")).alias("same"), F.count_if(F.col("a_ok") != F.col("b_ok")).alias("different")
    )
    share = F.col("recoverable") / F.col("chunks")
    bins = F.when(share == 0, "0%").when(share < 0.25, "1-25%").when(share < 0.75, "25-75%").when(share < 0.99, "75-99%").otherwise("100%")
    return per.withColumn("share", share).withColumn("bin", bins)


def audit_rollup(probes: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: how many volumes opened, were refused, could not be read, could not be identified, were not checked or did not show up, and whether all is well: none of the last five.

    probes: volume_id, outcome. expected: volume_id.
    """
    absent = expected.select("volume_id").distinct().join(probes.select("volume_id"), "volume_id", "left_anti").agg(F.count(F.lit(1)).alias("absent"))
    kinds = ("opened", "refused", "unreadable", "unidentified", "not_checked")
    counts = probes.agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in kinds])
    bad = sum((F.col(k) for k in kinds[2:]), F.col("refused")) + F.col("absent")
    return counts.join(F.broadcast(absent)).select(*kinds, "absent", (bad == 0).alias("healthy"))  # one row each


def audit_due(last_audit: Column, now: Column, token: Column, last_token: Column, days: int = 90) -> Column:
    """Why an audit is due, the first that holds: never, old, token-missing, token-changed; null if it isn't."""
    return F.when(last_audit.isNull(), "never").when(F.datediff(now, last_audit) >= days, "old").when(token.isNull(), "token-missing").when(~token.eqNullSafe(last_token), "token-changed")


def verify_run(objects: DataFrame, slices: DataFrame, before: Column, volumes: list[int] | None, cursor_path: str, size: int, batches: int) -> DataFrame:
    """Up to ``batches`` batches of a run's worklist: object_id and batch. The cursor, written after each batch, is where the next call goes on; ``before`` is the run's boundary.

    A run that ends within a batch takes that batch again.
    """
    spark = objects.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(cursor_path)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    saved = spark.read.parquet(cursor_path).agg(F.max(F.struct("batch", "after")).alias("c")).first()["c"] if there else None
    batch, after = (saved["batch"], saved["after"]) if saved else (0, None)
    found = None
    for _ in range(batches):
        page = materialise(worklist(objects, slices, before, volumes, after, size).select("object_id"))
        last = page.agg(F.max("object_id").alias("m")).first()["m"]
        if last is None:
            break
        batch, after = batch + 1, last
        spark.range(1).select(F.lit(batch).alias("batch"), F.lit(after).cast("bigint").alias("after")).write.mode("append").parquet(cursor_path)
        page = page.withColumn("batch", F.lit(batch))
        found = page if found is None else found.unionByName(page)
    return found if found is not None else objects.select("object_id", F.lit(0).alias("batch")).limit(0)
