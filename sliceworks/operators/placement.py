"""Where new and moved slices go: ranking of volumes, plans, sources and targets of moves, size tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .namespace import materialise

TIERS = (256 << 20, 16 << 20, 1 << 20, 0)
DEADBAND = 0.02


def _free() -> Column:
    return F.coalesce(F.col("bytes_free"), F.lit(0)) - F.coalesce(F.col("bytes_pending"), F.lit(0))


def candidates(volumes: DataFrame) -> DataFrame:
    """Volumes that take new slices."""
    return volumes.filter(S.writable() & ~F.col("deleted"))


def round_robin(volumes: DataFrame) -> DataFrame:
    """Volumes in the order of a round-robin over groups, each group from the emptiest on; groups ascending, those without one last, as one group."""
    own = Window.partitionBy("device_group").orderBy(F.desc("free"), "volume_id")
    turns = candidates(volumes).withColumn("free", _free()).withColumn("turn", F.row_number().over(own))
    place = F.row_number().over(Window.orderBy("turn", F.col("device_group").asc_nulls_last(), "volume_id"))
    return turns.select("volume_id", "device_group", "free", "turn", place.alias("place"))


def by_free(volumes: DataFrame) -> DataFrame:
    return candidates(volumes).select("volume_id", _free().alias("free")).orderBy(F.desc("free"), "volume_id")


def plan(volumes: DataFrame, data_n: int, parity_n: int, seed: str) -> DataFrame:
    """volume_id, slice_index and slice_type of a new object's slices: the first volumes of the round-robin, in an order that the seed decides.

    Raises when there are fewer volumes than slices.
    """
    chosen = round_robin(volumes).filter(F.col("place") <= data_n + parity_n)
    shuffled = F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("volume_id").cast("string")).cast("binary")), "volume_id")) - 1
    enough = F.count(F.lit(1)).over(Window.partitionBy()) >= data_n + parity_n
    guarded = F.when(enough, shuffled).otherwise(F.raise_error(F.lit("fewer writable volumes than slices")).cast("int"))
    return chosen.select("volume_id", guarded.alias("slice_index")).withColumn("slice_type", F.when(F.col("slice_index") < data_n, "data").otherwise("parity"))


def drain_targets(slices: DataFrame, volumes: DataFrame, objects: DataFrame, source: int) -> DataFrame:
    """For each slice on ``source`` the volume it should move to: none of its object's, with room, least loaded domain, then most free space.

    A slice is not paired with every volume. Within a domain the emptiest volume that its object doesn't hold is the best, if there is room
    at all; an object with m slices on a domain's volumes rules out m of them at most, so the domain's m + 1 emptiest are enough. Domains in which an
    object has nothing all have load 0: of those the one with the emptiest volume is best, so the emptiest volumes of as many domains as
    the object has slices, and one more, are enough.
    """
    moving = slices.filter(F.col("volume_id") == source).join(objects.select("object_id", S.slice_estimate(F.col("size"), F.col("data_n")).alias("need")), "object_id")
    domain = S.failure_domain(F.col("device_group"), F.col("volume_id"))
    of_object = slices.join(moving.select("object_id").distinct(), "object_id", "left_semi").join(volumes.select("volume_id", domain.alias("domain")), "volume_id", "left")
    held = of_object.groupBy("object_id").agg(F.collect_set("volume_id").alias("held"), F.collect_set("domain").alias("domains"))  # an object's slices
    loads = of_object.filter(F.col("volume_id") != source).groupBy("object_id", "domain").agg(F.count(F.lit(1)).alias("load"))
    own = Window.partitionBy("domain").orderBy(F.desc("free"), "target")
    ranked = candidates(volumes).filter(F.col("volume_id") != source).select(F.col("volume_id").alias("target"), _free().alias("free"), domain.alias("domain")).withColumn("nth", F.row_number().over(own))
    heads = ranked.filter("nth = 1").withColumn("place", F.row_number().over(Window.orderBy(F.desc("free"), "target")))
    slots = moving.join(held, "object_id")
    inside = slots.select("object_id", "slice_index", "need", "held", F.explode("domains").alias("domain")).join(ranked, "domain").filter(F.col("nth") <= F.size("held") + 1)
    spread = slots.select("object_id", "slice_index", "need", "held", F.explode(F.sequence(F.lit(1), F.size("held") + 1)).alias("place")).join(heads, "place").drop("place")
    pairs = inside.unionByName(spread.select(*inside.columns)).filter(~F.array_contains("held", F.col("target")) & (F.col("free") >= F.col("need")))
    judged = pairs.join(loads, ["object_id", "domain"], "left").withColumn("load", F.coalesce("load", F.lit(0)))
    best = judged.groupBy("object_id", "slice_index").agg(F.min(F.struct("load", (-F.col("free")).alias("full"), "target", "need")).alias("b"))
    return best.select("object_id", "slice_index", "b.target", "b.load", "b.need")


def drained(slices: DataFrame, volumes: DataFrame, objects: DataFrame, source: int, most: int = 20) -> tuple[DataFrame, list[int]]:
    """The slices after passes that each move what fits off ``source``, and how many were left after each pass.

    A pass gives each slice its best target, admits by target as many as its free space holds, smallest first, and takes their bytes off it. Passes end
    when nothing is left, or when a pass moves nothing.
    """
    left = [slices.filter(F.col("volume_id") == source).count()]
    while left[-1] and len(left) <= most:
        taken = F.sum("need").over(Window.partitionBy("target").orderBy("need", "object_id", "slice_index"))
        fits = drain_targets(slices, volumes, objects, source).withColumn("taken", taken).join(volumes.select(F.col("volume_id").alias("target"), _free().alias("free")), "target").filter(F.col("taken") <= F.col("free"))
        moves = materialise(fits.select("object_id", "slice_index", "target", "need"))
        to = moves.select("object_id", "slice_index", F.lit(source).cast("bigint").alias("_from"), F.col("target").alias("_to"))
        same = [F.col("s.object_id") == F.col("m.object_id"), F.col("s.slice_index") == F.col("m.slice_index"), F.col("s.volume_id") == F.col("m._from")]
        slices = materialise(slices.alias("s").join(to.alias("m"), same, "left").select(*[F.coalesce("m._to", "s.volume_id").alias(c) if c == "volume_id" else F.col(f"s.{c}") for c in slices.columns]))
        gone = moves.groupBy(F.col("target").alias("_t")).agg(F.sum("need").alias("_moved"))
        lower = F.coalesce("bytes_free", F.lit(0)) - F.coalesce("_moved", F.lit(0))
        volumes = materialise(volumes.join(gone, F.col("volume_id") == F.col("_t"), "left").withColumn("bytes_free", F.when(F.col("_moved").isNotNull(), lower).otherwise(F.col("bytes_free"))).select(*volumes.columns))
        left.append(slices.filter(F.col("volume_id") == source).count())
        if left[-1] >= left[-2]:
            break
    return slices, left


def rebalance_sources(volumes: DataFrame, deadband: float = DEADBAND) -> DataFrame:
    """Volumes fuller than the pool's fill and the deadband, fullest first, with the bytes above the fill."""
    live = volumes.filter(~F.col("deleted")).withColumn("fill", S.fill(F.col("bytes_total"), F.col("bytes_free"), F.col("bytes_pending")))
    used = F.col("bytes_total") - _free()
    target = live.agg((F.sum(used).cast("double") / F.sum("bytes_total").cast("double")).alias("target"))
    over = live.join(F.broadcast(target)).filter(F.col("fill") > F.col("target") + deadband)
    return over.select("volume_id", F.round("fill", 9).alias("fill"), ((F.col("fill") - F.col("target")) * F.col("bytes_total")).cast("bigint").alias("excess"))


def rebalance_targets(volumes: DataFrame, deadband: float = DEADBAND) -> DataFrame:
    """Volumes that may take moved slices: writable, no verify errors, emptier than the pool's fill less the deadband; emptiest first."""
    live = volumes.filter(~F.col("deleted")).withColumn("fill", S.fill(F.col("bytes_total"), F.col("bytes_free"), F.col("bytes_pending")))
    target = live.agg((F.sum(F.col("bytes_total") - _free()).cast("double") / F.sum("bytes_total").cast("double")).alias("target"))
    fit = candidates(live).filter("verify_errors = 0").join(F.broadcast(target)).filter(F.col("fill") < F.col("target") - deadband)
    return fit.select("volume_id", F.round("fill", 9).alias("fill"), F.row_number().over(Window.orderBy("fill", "volume_id")).alias("place"))


def shed(slices: DataFrame, objects: DataFrame, sources: DataFrame, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Which slices leave each source: larger tiers first, by object within a tier, until the source's excess is shed.

    A running sum by source decides, so no state is shared between sources. Whole tiers are summed first; only the tier in which a source's
    excess ends is put in order.
    """
    tier = F.lit(len(tiers))
    for i in range(len(tiers) - 1, -1, -1):
        tier = F.when(F.coalesce("size", F.lit(0)) >= tiers[i], i).otherwise(tier)
    sized = objects.select("object_id", tier.alias("tier"), S.slice_estimate(F.col("size"), F.col("data_n")).alias("bytes"))
    there = slices.join(sources.select("volume_id", "excess"), "volume_id").join(sized, "object_id")
    tiers_of = there.groupBy("volume_id", "tier").agg(F.sum("bytes").alias("whole"))
    larger = F.coalesce(F.sum("whole").over(Window.partitionBy("volume_id").orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    there = there.join(tiers_of.select("volume_id", "tier", larger.alias("larger")), ["volume_id", "tier"]).filter(F.col("larger") < F.col("excess"))
    before = F.sum("bytes").over(Window.partitionBy("volume_id", "tier").orderBy("object_id", "slice_index").rowsBetween(Window.unboundedPreceding, -1))
    return there.withColumn("shed_before", F.col("larger") + F.coalesce(before, F.lit(0))).filter(F.col("shed_before") < F.col("excess")).select("volume_id", "object_id", "slice_index", "tier", "bytes", "shed_before")


def replica_election(volumes: DataFrame, existing: list[int], copies: int) -> DataFrame:
    """Volumes for the journal's copies: existing ones of distinct groups, then other groups, then any."""
    fit = candidates(volumes).withColumn("domain", S.failure_domain(F.col("device_group"), F.col("volume_id"))).withColumn("new", (~F.col("volume_id").isin(*existing)).cast("int") if existing else F.lit(1))
    first = F.row_number().over(Window.partitionBy("domain").orderBy("new", "volume_id"))
    place = F.row_number().over(Window.orderBy((F.col("_g") > 1).cast("int"), "new", "volume_id"))
    return fit.withColumn("_g", first).withColumn("place", place).filter(F.col("place") <= copies).select("volume_id", "domain", "place")


def keep_recent(entries: DataFrame, key: str, time: str, keep: int) -> DataFrame:
    """The ``keep`` latest entries, each key's own latest."""
    latest = entries.groupBy(key).agg(F.max(time).alias(time))
    return latest.orderBy(F.desc(time), key).limit(keep)
