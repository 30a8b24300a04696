"""Sharding over fixed virtual slots.

A record's hash puts it into one of ``SLOTS`` virtual slots, for ever. Bytes and rows are summed by slot; a map deals
the slots, largest first, each to the shard with the fewest bytes so far. The map is a small table with a version,
which rebalancing edits: records never change their slot, only some slots change their shard. The map is stored; placing
records reads the stored version. Where a map is stored already, ``shard`` appends a next version, in which only as many
slots move as the new loads ask for.

The map has ``SLOTS`` rows whatever the input, so it is dealt out within one row and broadcast. Nothing else gathers:
sums by slot are combined before the shuffle, and positions are counted within a slot and offset by the map.

Cases: a null text has no bytes and the checksum 0; a null id hashes with its text's checksum; repeated rows share a
slot and get positions of their own; an empty table gives an empty result, and the map still covers every slot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import exists, shared_dir, stash

SLOTS = 4096
SHARDS = 40
OVERHEAD = 16


def hashed(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every row."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"))
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """virtual_slot, bytes and n_rows for every slot, also those without rows."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def _deal(slots: DataFrame, loads: DataFrame) -> DataFrame:
    """virtual_slot and shard: each slot, largest first, goes to the least loaded shard. loads: one row, array ``loads`` by shard."""
    ordered = slots.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "virtual_slot"))).alias("s"))
    dealt = ordered.join(F.broadcast(loads)).select(
        "s",
        F.expr(
            """aggregate(s, named_struct('loads', loads, 'plan', slice(array(0), 1, 0)), (a, x) -> named_struct(
                 'loads', transform(a.loads, (l, i) -> if(i = array_position(a.loads, array_min(a.loads)) - 1, l - x.minus, l)),
                 'plan', concat(a.plan, array(cast(array_position(a.loads, array_min(a.loads)) - 1 AS int)))), a -> a.plan)"""
        ).alias("p"),
    )
    pairs = dealt.select(F.explode(F.arrays_zip(F.col("s.virtual_slot").alias("virtual_slot"), F.col("p").alias("shard"))).alias("x"))
    return pairs.select("x.virtual_slot", "x.shard")


def first_map(loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1 of the map: version, virtual_slot, shard, bytes, n_rows."""
    empty = loads.sparkSession.range(1).select(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"))
    return loads.join(_deal(loads, empty), "virtual_slot").select(F.lit(1).alias("version"), "virtual_slot", "shard", "bytes", "n_rows")


def rebalance(old: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of the map for new loads and as many shards: the largest slots, as far as they lie beyond a shard's fair share, and those of shards that are gone move; the others stay."""
    now = old.select("version", "virtual_slot", "shard").join(loads, "virtual_slot")
    fair = now.agg((F.sum("bytes") / shards).alias("fair"))
    running = F.sum("bytes").over(Window.partitionBy("shard").orderBy("bytes", "virtual_slot"))
    marked = now.withColumn("until", running).join(F.broadcast(fair)).withColumn("stays", (F.col("shard") < shards) & (F.col("until") <= F.col("fair")))
    held = marked.filter("stays").groupBy("shard").agg(F.sum("bytes").alias("held"))
    every = old.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(held, "shard", "left")
    start = every.agg(F.array_sort(F.collect_list(F.struct("shard", F.coalesce("held", F.lit(0).cast("long")).alias("held")))).alias("h")).select(F.col("h.held").alias("loads"))
    moved = _deal(marked.filter(~F.col("stays")), start).withColumnRenamed("shard", "to")
    return marked.join(moved, "virtual_slot", "left").select((F.col("version") + 1).alias("version"), "virtual_slot", F.coalesce("to", "shard").alias("shard"), "bytes", "n_rows")


def save_map(slot_map: DataFrame, path: str) -> None:
    """Append one version to the stored map."""
    slot_map.write.partitionBy("version").mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One stored version of the map, by default the latest."""
    stored = spark.read.parquet(path)
    wanted = version if version is not None else stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == wanted)


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """The rows with their shard and their position in it, without gaps from 0."""
    starts = F.sum("n_rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    ranges = slot_map.select("virtual_slot", "shard", "version", F.coalesce(starts, F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    placed = rows.withColumn("_within", within).join(F.broadcast(ranges), "virtual_slot")
    return placed.withColumn("slot", (F.col("_start") + F.col("_within") - 1).cast("long")).drop("_start", "_within")


def next_version(loads: DataFrame, shards: int, path: str) -> DataFrame:
    """Store the first map, or the next version of the stored one for these loads, and read it back."""
    spark = loads.sparkSession
    save_map(rebalance(load_map(spark, path), loads, shards) if exists(spark, path) else first_map(loads, shards), path)
    return load_map(spark, path)


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every row of ``docs`` placed by the stored map: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot and map_version. ``map_path``: where the map is stored; by default a new one in the shared folder."""
    rows = stash(hashed(docs, slots), "slot-rows")
    path = map_path or f"{shared_dir(docs.sparkSession)}/slot-map-{uuid.uuid4().hex}"
    placed = place(rows, next_version(slot_loads(rows, slots), shards, path))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))
