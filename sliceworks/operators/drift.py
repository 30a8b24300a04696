"""Where names and disks disagree: phantoms, orphans, geometry votes, quorum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHAPE = ("h_size", "h_data_n", "h_parity_n", "h_chunk")


def phantoms(objects: DataFrame, slices: DataFrame) -> DataFrame:
    """Named objects without any slice."""
    return objects.join(slices.select("object_id"), "object_id", "left_anti")


def orphans(objects: DataFrame, slices: DataFrame) -> DataFrame:
    """Objects that only slices know."""
    return slices.select("object_id").distinct().join(objects.select("object_id"), "object_id", "left_anti")


def geometry_votes(headers: DataFrame) -> DataFrame:
    """Each object's winning shape by readable headers: most volumes, then most slices; two equal best shapes give no answer."""
    n = lambda c: F.size(F.collect_set(c)).cast("bigint").alias(f"{c}s")  # noqa: E731  of an object's slices
    shapes = headers.filter("status = 'ok'").groupBy("object_id", *SHAPE).agg(n("volume_id"), n("slice_index"))
    ranked = shapes.groupBy("object_id").agg(F.max(F.struct("volume_ids", "slice_indexs")).alias("top"), F.collect_list(F.struct(F.struct("volume_ids", "slice_indexs").alias("votes"), *SHAPE)).alias("all"))
    won = F.filter("all", lambda x: x["votes"] == F.col("top"))
    single = ranked.select("object_id", F.col("top.volume_ids").alias("volumes"), F.col("top.slice_indexs").alias("slices"), F.size(won).cast("bigint").alias("winners"), F.get(won, 0).alias("won"))
    answer = single.select("object_id", *[F.when(F.col("winners") == 1, F.col(f"won.{c}")).alias(c) for c in SHAPE], "volumes", "slices", "winners")
    return answer.withColumn("corroborated", (F.col("winners") == 1) & (F.col("volumes") > 1))


def quorum(headers: DataFrame) -> DataFrame:
    """ok, below-quorum, uncorroborated or indeterminate of every object that has slices on disk.

    Unreadable slices are unknown, not missing: an object that could reach quorum with them is indeterminate.
    """
    voted = geometry_votes(headers)
    slots = headers.groupBy("object_id", "slice_index").agg(F.max(F.when(F.col("status") == "unreadable", 1).otherwise(0)).alias("unknown"))
    unknown = slots.groupBy("object_id").agg(F.sum("unknown").alias("unknown"))
    both = unknown.join(voted, "object_id", "left")
    verdict = (
        F.when(F.col("winners").isNull(), F.when(F.col("unknown") > 0, "indeterminate").otherwise("below-quorum"))
        .when(F.col("winners") > 1, F.lit("indeterminate"))
        .when(F.col("slices") >= F.col("h_data_n"), F.when(F.col("corroborated"), "ok").otherwise("uncorroborated"))
        .when(F.col("slices") + F.col("unknown") >= F.col("h_data_n"), "indeterminate")
        .otherwise("below-quorum")
    )
    return both.select("object_id", verdict.alias("verdict"), F.coalesce("slices", F.lit(0)).alias("agreeing"), "unknown")


def drift_report(objects: DataFrame, headers: DataFrame) -> DataFrame:
    """One row a class: phantom, orphan, or the quorum verdict of named objects, with exact counts and the smallest ids."""
    named = objects.select("object_id", F.lit(True).alias("named"))
    both = quorum(headers).join(named, "object_id", "full_outer")
    kind = F.when(F.col("verdict").isNull(), "phantom").when(F.col("named").isNull(), F.concat(F.lit("orphan-"), F.col("verdict"))).otherwise(F.col("verdict"))
    return both.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.min("object_id").alias("first_id"), F.max("object_id").alias("last_id"))


def synthesise(headers: DataFrame) -> DataFrame:
    """Records from disk alone: for each slot of the winning shape the volume to read it from, null if none has it. Of several copies, one of the winning shape, then the smallest volume."""
    voted = geometry_votes(headers).filter("winners = 1")
    agree = F.lit(True)
    for c in SHAPE:
        agree = agree & (F.col(f"h.{c}") == F.col(f"w.{c}"))
    copies = headers.filter("status = 'ok'").alias("h").join(voted.alias("w"), F.col("h.object_id") == F.col("w.object_id")).select(F.col("h.object_id").alias("object_id"), F.col("h.slice_index").alias("slice_index"), F.col("h.volume_id").alias("volume_id"), agree.cast("int").alias("agrees"))
    best = F.row_number().over(Window.partitionBy("object_id", "slice_index").orderBy(F.desc("agrees"), "volume_id"))
    chosen = copies.withColumn("_r", best).filter("_r = 1").select("object_id", "slice_index", "volume_id")
    slots = voted.select("object_id", F.explode(F.sequence(F.lit(0), F.col("h_data_n") + F.col("h_parity_n") - 1)).alias("slice_index"))
    return slots.join(chosen, ["object_id", "slice_index"], "left")


def header_mismatches(headers: DataFrame, objects: DataFrame) -> DataFrame:
    """Readable headers against the named objects: how many differ in each field."""
    both = headers.filter("status = 'ok'").join(objects.select("object_id", "data_n", "parity_n", "chunk_size"), "object_id")
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("h_data_n") != F.col("data_n")).alias("data_n_differs"), F.count_if(F.col("h_parity_n") != F.col("parity_n")).alias("parity_n_differs"), F.count_if(F.col("h_chunk") != F.col("chunk_size")).alias("chunk_differs")
    )


def stale_references(on_disk: DataFrame, objects: DataFrame, slices: DataFrame, volume: int) -> DataFrame:
    """Objects found on a volume's disk: still referenced there, stale (named, but elsewhere now), or orphan."""
    named = objects.select("object_id", F.lit(True).alias("_n"))
    here = slices.filter(F.col("volume_id") == volume).select("object_id").distinct().withColumn("_h", F.lit(True))
    verdict = F.when(F.col("_n").isNull(), "orphan").when(F.col("_h").isNotNull(), "referenced").otherwise("stale")
    return on_disk.join(named, "object_id", "left").join(here, "object_id", "left").select("object_id", verdict.alias("verdict"))


def quarantine_guard(objects: DataFrame, slices: DataFrame, floor: int, share: float) -> DataFrame:
    """One row: named, orphaned, and whether removing the orphans is allowed: enough names, few enough orphans."""
    counts = orphans(objects, slices).agg(F.count(F.lit(1)).alias("orphaned"))
    named = objects.agg(F.count(F.lit(1)).alias("named"))
    return named.join(F.broadcast(counts)).select("named", "orphaned", ((F.col("named") >= floor) & (F.col("orphaned") <= F.col("named") * share)).alias("allowed"))
