"""Queries: the rest of the inventory, mostly one expression each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import erasure
from ..functions import scalars as S
from ..operators import accounting as A
from ..operators import drift as D
from ..operators import namespace as N
from ..operators import placement as P
from ..sources import tables as T
from .fixtures import driver_table
from .fixtures import relation as R
from .registry import CATEGORY, ESTIMATE, FREE, SLICE_SIZE, WRITABLE, query


@query("src_01_02_04_scans", "select object_id from objects where object_id = 7 union all select volume_id from volumes")
def src_01(spark: SparkSession, sf: str) -> DataFrame:
    """A whole collection, one column of it, and a look-up by id."""
    return R(spark, sf, "objects").filter("object_id = 7").select("object_id").unionByName(R(spark, sf, "volumes").select(F.col("volume_id").alias("object_id")))


@query("src_07_first_copies", "select object_id, slice_index, min(volume_id) as volume_id from slices group by 1, 2")
def src_07(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "slices").groupBy("object_id", "slice_index").agg(F.min("volume_id").alias("volume_id"))


@query("src_11_safe_records", r"select doc_id, regexp_matches(text, '[\n\r]') as refused from {documents}")
def src_11(spark: SparkSession, sf: str) -> DataFrame:
    return driver_table(spark, sf, "documents").select("doc_id", F.regexp_like("text", F.lit(r"[\n\r]")).alias("refused"))


@query("src_16_18_manifest_json", "select event_id, cast(json_extract_string(props, '$.k') as int) as k, false as broken from {events} where event_id % 9 <> 0 union all select event_id, null, true from {events} where event_id % 9 = 0")
def src_16(spark: SparkSession, sf: str) -> DataFrame:
    """JSON with a place for what doesn't parse: absent and unreadable stay apart."""
    raw = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    parsed = driver_table(spark, sf, "events").select("event_id", F.from_json(raw, "k int, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.select("event_id", "r.k", F.col("r._bad").isNotNull().alias("broken"))


@query("fil_12_column_comparison", "select object_id from objects where parity_n < data_n and created_at <= coalesce(last_verified_at, created_at)")
def fil_12(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "objects").filter("parity_n < data_n AND created_at <= coalesce(last_verified_at, created_at)").select("object_id")


@query("joi_08_both_directions", "select case when o.object_id is null then 'orphan' when s.object_id is null then 'phantom' else 'both' end as side, count(*) as n from (select object_id from objects where status <> 'P') o full outer join (select distinct object_id from slices) s on o.object_id = s.object_id group by 1")
def joi_08(spark: SparkSession, sf: str) -> DataFrame:
    named = R(spark, sf, "objects").filter("status <> 'P'").select("object_id", F.lit(True).alias("n"))
    there = R(spark, sf, "slices").select("object_id").distinct().withColumn("s", F.lit(True))
    side = F.when(F.col("n").isNull(), "orphan").when(F.col("s").isNull(), "phantom").otherwise("both")
    return named.join(there, "object_id", "full_outer").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "joi_18_target_counts",
    f"""select m.object_id, m.slice_index, count(*) as targets from (select s.object_id, s.slice_index, {ESTIMATE} as need from slices s join objects o on s.object_id = o.object_id where s.volume_id = 21) m
      join (select volume_id, {FREE} as free from volumes where {WRITABLE} and not deleted) t on t.free >= m.need where not exists (select 1 from slices h where h.object_id = m.object_id and h.volume_id = t.volume_id) group by 1, 2""",
)
def joi_18(spark: SparkSession, sf: str) -> DataFrame:
    slices = R(spark, sf, "slices")
    moving = slices.filter("volume_id = 21").join(R(spark, sf, "objects").select("object_id", S.slice_estimate(F.col("size"), F.col("data_n")).alias("need")), "object_id")
    held = slices.join(moving.select("object_id").distinct(), "object_id", "left_semi").groupBy("object_id").agg(F.collect_set("volume_id").alias("held"))
    free = F.coalesce("bytes_free", F.lit(0)) - F.col("bytes_pending")
    targets = P.candidates(R(spark, sf, "volumes")).select(F.col("volume_id").alias("target"), free.alias("free"))
    return moving.join(held, "object_id").join(targets, ~F.array_contains("held", F.col("target")) & (F.col("free") >= F.col("need"))).groupBy("object_id", "slice_index").agg(F.count(F.lit(1)).alias("targets"))


@query("win_12_longest_segments", "select conv_id, arg_max(turn, length(text) * 1000 - turn) as turn from {conversations} group by conv_id")
def win_12(spark: SparkSession, sf: str) -> DataFrame:
    return driver_table(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by("turn", F.struct(F.length("text"), -F.col("turn"))).alias("turn"))


@query("srt_01_batch", "select object_id from objects order by object_id limit 25")
def srt_01(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "objects").orderBy("object_id").limit(25).select("object_id")


@query("srt_04_composite_order", "select volume_id, cast(row_number() over (order by case when deleted then 2 when not started then 1 else 0 end, device_group nulls last, volume_id) as int) as place from volumes")
def srt_04(spark: SparkSession, sf: str) -> DataFrame:
    tier = F.when(F.col("deleted"), 2).when(~F.col("started"), 1).otherwise(0)
    return R(spark, sf, "volumes").select("volume_id", F.row_number().over(Window.orderBy(tier, F.col("device_group").asc_nulls_last(), "volume_id")).alias("place"))


@query("srt_08_shuffle", "select volume_id, cast(row_number() over (order by md5('s:' || cast(volume_id as string)), volume_id) as int) as place from volumes")
def srt_08(spark: SparkSession, sf: str) -> DataFrame:
    key = F.md5(F.concat(F.lit("s:"), F.col("volume_id").cast("string")).cast("binary"))
    return R(spark, sf, "volumes").select("volume_id", F.row_number().over(Window.orderBy(key, "volume_id")).alias("place"))


@query("set_02_03_ordered_sets", "select object_id, string_agg(distinct cast(volume_id as string), ',' order by cast(volume_id as string)) as volumes, count(*) = count(distinct volume_id) as unique_volumes from slices group by object_id")
def set_02(spark: SparkSession, sf: str) -> DataFrame:
    held = R(spark, sf, "slices").groupBy("object_id").agg(F.collect_list(F.col("volume_id").cast("string")).alias("v"))
    distinct = F.array_sort(F.array_distinct("v"))
    return held.select("object_id", F.array_join(distinct, ",").alias("volumes"), F.array_sort("v").eqNullSafe(distinct).alias("unique_volumes"))


@query("set_05_06_unions", "select volume_id from (select volume_id from volumes where healthy union select volume_id from volumes where started) u intersect select volume_id from volumes where enabled except select volume_id from volumes where draining")
def set_05(spark: SparkSession, sf: str) -> DataFrame:
    v = R(spark, sf, "volumes")
    pick = lambda condition: v.filter(condition).select("volume_id")
    return pick("healthy").unionByName(pick("started")).distinct().intersect(pick("enabled")).exceptAll(pick("draining"))


@query("sca_01_slice_sizes", f"select object_id, {SLICE_SIZE} as bytes, case when object_id % 2 = 0 then 77 else {SLICE_SIZE} end as declared from objects")
def sca_01(spark: SparkSession, sf: str) -> DataFrame:
    args = F.col("size"), F.col("chunk_size"), F.col("data_n")
    return R(spark, sf, "objects").select("object_id", S.slice_size(*args).alias("bytes"), S.slice_size(*args, F.when(F.col("object_id") % 2 == 0, F.lit(77).cast("bigint"))).alias("declared"))


@query(
    "sca_10_legacy_categories",
    f"select object_id, slice_index, coalesce(case when verified_at is null then slice_type end, case when volume_id % 7 = 0 then 'checksum' end, {CATEGORY}) as category from slices where error_code is not null",
)
def sca_10(spark: SparkSession, sf: str) -> DataFrame:
    """A category that is stored (here: of slices never verified, their type) goes before the flag, and the flag before the code."""
    flagged = R(spark, sf, "slices").filter("error_code IS NOT NULL")
    category = S.legacy_category(F.when(F.col("verified_at").isNull(), F.col("slice_type")), F.col("volume_id") % 7 == 0, F.col("error_code"), F.lit(None).cast("string"))
    return flagged.select("object_id", "slice_index", category.alias("category"))


@query("sca_14_made_ids", "select event_id, substr(md5(cast(event_id as string) || '|' || event_type), 1, 24) as id from {events}")
def sca_14(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that their parts decide, in place of random ones, so that reruns agree."""
    return driver_table(spark, sf, "events").select("event_id", S.make_id(F.col("event_id"), F.col("event_type")).alias("id"))


_WRITTEN_DATE = "cast(1990 + event_id % 40 as string) || '-' || lpad(cast(1 + event_id % 14 as string), 2, '0') || '-' || lpad(cast(1 + event_id % 33 as string), 2, '0')"


@query("sca_43_dates", f"select event_id, try_cast({_WRITTEN_DATE} as timestamp) as at_time from {{events}}")
def sca_43(spark: SparkSession, sf: str) -> DataFrame:
    """Written dates, some in months or on days that there are not: those are null."""
    return driver_table(spark, sf, "events").select("event_id", F.try_to_timestamp(F.expr(_WRITTEN_DATE)).cast("timestamp_ntz").alias("at_time"))


@query(
    "sca_44_bus_groups",
    """with d as (select volume_id, '/devices/pci' || cast(volume_id % 3 as string) || case when volume_id % 5 = 0 then '/own' || cast(volume_id as string) else '/usb' || cast(volume_id % 4 as string) || '/dev' || cast(volume_id as string) end as path from volumes),
      p as (select volume_id, string_split(ltrim(path, '/'), '/') as parts from d), x as (select volume_id, i, array_to_string(parts[1:i], '/') as prefix from (select *, unnest(range(1, len(parts) + 1)) as i from p) e),
      n as (select prefix from x group by prefix having count(*) > 1) select volume_id, '/' || arg_max(x.prefix, i) as bus from x join n on x.prefix = n.prefix group by volume_id""",
)
def sca_44(spark: SparkSession, sf: str) -> DataFrame:
    """Each device's longest path prefix that another device shares: prefixes are exploded, counted and joined back, deepest first."""
    v = F.col("volume_id")
    tail = F.when(v % 5 == 0, F.concat(F.lit("/own"), v.cast("string"))).otherwise(F.concat(F.lit("/usb"), (v % 4).cast("string"), F.lit("/dev"), v.cast("string")))
    devices = R(spark, sf, "volumes").select("volume_id", F.concat(F.lit("/devices/pci"), (v % 3).cast("string"), tail).alias("path"))
    prefixes = devices.select("volume_id", F.posexplode(S.path_prefixes(F.col("path"))).alias("depth", "prefix"))
    shared = prefixes.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return prefixes.join(shared, "prefix").groupBy("volume_id").agg(F.concat(F.lit("/"), F.max_by("prefix", "depth")).alias("bus"))


@query("sca_48_subset_search")
def sca_48(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as six slices of which one, by a hash of its id, is damaged: every choice of four is decoded, and one whose whole sum matches is found."""
    raw = F.col("text").cast("binary")
    width = F.greatest(F.lit(1), F.ceil(F.length(raw) / 4)).cast("int")
    parts = F.array(*[F.rpad(F.substring(raw, F.lit(1) + width * i, width), width, F.lit(b"\x00")) for i in range(4)])
    some = driver_table(spark, sf, "documents").select(F.col("doc_id").alias("object_id"), parts.alias("data"))
    coded = erasure.with_parity(some, 2)
    joined = reduce(lambda a, b: F.concat(a, b), [F.col("data")[i] for i in range(4)])
    victim = F.pmod(F.xxhash64("object_id"), F.lit(6)).cast("int")

    def damage(x: Column) -> Column:
        return F.when(F.substring(x, 1, 1) == F.unhex(F.lit("FF")), F.unhex(F.lit("FE"))).otherwise(F.unhex(F.lit("FF")))

    hurt = coded.select("object_id", F.md5(joined).alias("sum"), F.transform(F.concat("data", "parity"), lambda x, i: F.when(i == victim, damage(x)).otherwise(x)).alias("all"))
    found = erasure.subsets_found(hurt, 4, 2).filter("choices > 0")
    return found.groupBy(F.col("object_id").alias("doc_id")).agg(F.sum("choices").alias("choices"))


@query(
    "sca_49_resync",
    """with b as (select doc_id, regexp_replace(text, '[^ -~]', '', 'g') as body from {documents}), f as (select doc_id, body, md5(substr(body, cast((doc_id * 7919) % (length(body) - 63) as int) + 1, 64)) as sum from b where length(body) >= 64)
      select doc_id, cast(min(o) as int) as offset from (select doc_id, body, sum, unnest(range(0, length(body) - 63)) as o from f) x where md5(substr(body, cast(o as int) + 1, 64)) = sum group by doc_id""",
)
def sca_49(spark: SparkSession, sf: str) -> DataFrame:
    """A frame of 64 bytes somewhere in a body, known by its sum: the first offset of all whose sum matches. Each body is searched in its row, no further than that."""
    body = driver_table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[^ -~]", "").cast("binary").alias("body")).filter(F.length("body") >= 64)
    place = (F.col("doc_id") * 7919 % (F.length("body") - 63)).cast("int")
    framed = body.select("doc_id", "body", F.md5(F.substring(F.col("body"), place + 1, F.lit(64))).alias("sum"))
    return T.first_frames(framed, 64).select(F.col("doc_id"), "offset")


@query("ns_11_listing", "select id, name, case when is_container then 'directory' else 'file' end as kind, size from (select id, name, true as is_container, cast(null as bigint) as size from containers where parent_id = 1007 union all select object_id, name, false, size from objects where container_id = 1007) x")
def ns_11(spark: SparkSession, sf: str) -> DataFrame:
    objects = R(spark, sf, "objects")
    entries = N.children(R(spark, sf, "containers"), objects, 1007)
    sizes = objects.filter("container_id = 1007").select(F.col("object_id").alias("id"), "size", F.lit(False).alias("is_container"))
    return entries.join(sizes, ["id", "is_container"], "left").select("id", "name", F.when(F.col("is_container"), "directory").otherwise("file").alias("kind"), "size")


@query("evt_11_negative_counters", "select volume_id, cast(count(*) as bigint) - 150 < 0 as recompute from slices group by volume_id")
def evt_11(spark: SparkSession, sf: str) -> DataFrame:
    """Counters that changes drive below zero ask for a recount."""
    zeros = [F.lit(0).cast("bigint").alias(c) for c in A.COUNTERS[1:]]
    counted = R(spark, sf, "slices").groupBy("volume_id").agg(F.count(F.lit(1)).alias("object_count")).select("volume_id", "object_count", *zeros)
    gone = counted.select("volume_id", F.lit(-150).cast("bigint").alias("object_count"), *zeros)
    return A.apply_deltas(counted, gone).select("volume_id", F.col("negative").alias("recompute"))


@query("joi_21_chains", "select c.id, p.name as parent, g.name as grandparent from containers c left join containers p on c.parent_id = p.id left join containers g on p.parent_id = g.id")
def joi_21(spark: SparkSession, sf: str) -> DataFrame:
    c = R(spark, sf, "containers").select("id", "parent_id", "name")
    p = c.select(F.col("id").alias("pid"), F.col("parent_id").alias("ppid"), F.col("name").alias("parent"))
    g = c.select(F.col("id").alias("gid"), F.col("name").alias("grandparent"))
    return c.join(p, F.col("parent_id") == F.col("pid"), "left").join(g, F.col("ppid") == F.col("gid"), "left").select("id", "parent", "grandparent")


@query("agg_26_orphan_quorum", "select count(*) as orphans from (select distinct object_id from slices where object_id not in (select object_id from objects where status = 'F')) x")
def agg_26_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return D.orphans(R(spark, sf, "objects").filter("status = 'F'"), R(spark, sf, "slices")).agg(F.count(F.lit(1)).alias("orphans"))
