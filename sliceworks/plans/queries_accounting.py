"""Queries: accounting (AGG), filters and projections (FIL, PRJ), sorts, sets and updates (SRT, SET, UPD)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import accounting as A
from ..operators import verification as V
from ..sources import tables as T
from .fixtures import relation as R
from .registry import CATEGORY, FILL, FREE, READABLE, SLICE_SIZE, WRITABLE, query

_COUNTERS = f"""count(*) as object_count, cast(coalesce(sum(coalesce(size, 0)), 0) as bigint) as logical_bytes, cast(coalesce(sum(data_n), 0) as bigint) as data_slice_count,
  cast(coalesce(sum(parity_n), 0) as bigint) as parity_slice_count, cast(coalesce(sum(data_n * {SLICE_SIZE}), 0) as bigint) as data_bytes,
  cast(coalesce(sum(parity_n * {SLICE_SIZE}), 0) as bigint) as parity_bytes, cast(coalesce(sum((data_n + parity_n) * {SLICE_SIZE}), 0) as bigint) as physical_bytes"""
_PER_VOLUME = f"""select sl.volume_id, count(distinct sl.object_id) as object_count,
    cast(sum(case when first then coalesce(size, 0) else 0 end) as bigint) as logical_bytes,
    cast(sum(case when slice_type = 'data' then 1 else 0 end) as bigint) as data_slice_count, cast(sum(case when slice_type = 'parity' then 1 else 0 end) as bigint) as parity_slice_count,
    cast(sum(case when slice_type = 'data' then {SLICE_SIZE} else 0 end) as bigint) as data_bytes, cast(sum(case when slice_type = 'parity' then {SLICE_SIZE} else 0 end) as bigint) as parity_bytes,
    cast(sum({SLICE_SIZE}) as bigint) as physical_bytes
  from (select *, row_number() over (partition by object_id, volume_id order by slice_index) = 1 as first from slices) sl join objects o on sl.object_id = o.object_id group by sl.volume_id"""


@query("agg_01_system_usage", f"select {_COUNTERS} from objects")
def agg_01(spark: SparkSession, sf: str) -> DataFrame:
    return A.system_usage(R(spark, sf, "objects"))


@query("agg_02_03_volume_usage", _PER_VOLUME)
def agg_02(spark: SparkSession, sf: str) -> DataFrame:
    return A.volume_usage(R(spark, sf, "slices"), R(spark, sf, "objects"))


@query(
    "agg_04_unavailable_recomputed",
    f"""select count(*) as object_count, cast(coalesce(sum(coalesce(size, 0)), 0) as bigint) as logical_bytes from objects o join (
      select object_id, count(*) as lost from (select distinct object_id, slice_type, s.volume_id from slices s join volumes v on s.volume_id = v.volume_id where not {READABLE}) d group by object_id) l
      on o.object_id = l.object_id where lost > parity_n""",
)
def agg_04(spark: SparkSession, sf: str) -> DataFrame:
    return A.totals(A.unavailable_recomputed(R(spark, sf, "objects"), R(spark, sf, "slices"), R(spark, sf, "volumes")))


@query(
    "agg_04_unavailable_incremental",
    f"""select count(*) as object_count, cast(coalesce(sum(coalesce(size, 0)), 0) as bigint) as logical_bytes from objects o left join (
      select object_id, count(*) as there from slices s join volumes v on s.volume_id = v.volume_id where {READABLE} group by object_id) l on o.object_id = l.object_id where coalesce(there, 0) < data_n""",
)
def agg_04b(spark: SparkSession, sf: str) -> DataFrame:
    return A.totals(A.unavailable_incremental(R(spark, sf, "objects"), R(spark, sf, "slices"), R(spark, sf, "volumes")))


@query("agg_05_bucket_usage", "select bucket_id, count(*) as object_count, cast(coalesce(sum(coalesce(size, 0)), 0) as bigint) as logical_bytes from objects where bucket_id is not null group by bucket_id")
def agg_05(spark: SparkSession, sf: str) -> DataFrame:
    return A.bucket_usage(R(spark, sf, "objects"))


@query("agg_06_usage_snapshot", f"select cast(null as bigint) as volume_id, {_COUNTERS} from objects union all select cast(volume_id as bigint), object_count, logical_bytes, data_slice_count, parity_slice_count, data_bytes, parity_bytes, physical_bytes from ({_PER_VOLUME}) p")
def agg_06(spark: SparkSession, sf: str) -> DataFrame:
    return A.usage_snapshot(R(spark, sf, "slices"), R(spark, sf, "objects"))


# objects of even ids are made, those of ids divisible by 6 are deleted again
_HALF = "(select * from objects where object_id % 2 = 0 and object_id % 6 <> 0)"


@query(
    "agg_07_09_net_deltas",
    f"select * from (select cast(null as bigint) as volume_id, {_COUNTERS} from {_HALF} h union all select cast(volume_id as bigint), object_count, logical_bytes, data_slice_count, parity_slice_count, data_bytes, parity_bytes, physical_bytes from ({_PER_VOLUME.replace('join objects o', f'join {_HALF} o')}) p) x where object_count <> 0",
)
def agg_07(spark: SparkSession, sf: str) -> DataFrame:
    objects, slices = R(spark, sf, "objects"), R(spark, sf, "slices")
    made = A.object_deltas(objects.filter("object_id % 2 = 0"), slices, F.lit(1))
    gone = A.object_deltas(objects.filter("object_id % 6 = 0"), slices, F.lit(-1))
    return A.merge_deltas(made.unionByName(gone))


@query(
    "agg_08_relocation_deltas",
    f"""select volume_id, cast(sum(n) as bigint) as object_count, cast(sum(n * coalesce(size, 0)) as bigint) as logical_bytes, cast(sum(n * {SLICE_SIZE}) as bigint) as physical_bytes from (
      select m.object_id, volume_id, n from (select object_id, cast(volume_id as bigint) as volume_id, cast(-1 as bigint) as n from slices where slice_index = 0 and volume_id % 5 = 0
        union all select object_id, cast(volume_id + 1 as bigint), cast(1 as bigint) from slices where slice_index = 0 and volume_id % 5 = 0) m) e join objects o on e.object_id = o.object_id
      group by volume_id""",
)
def agg_08(spark: SparkSession, sf: str) -> DataFrame:
    sized = R(spark, sf, "objects").select("object_id", "size", S.slice_size(F.col("size"), F.col("chunk_size"), F.col("data_n")).alias("stored"))
    moves = R(spark, sf, "slices").filter("slice_index = 0 AND volume_id % 5 = 0").select("object_id", "slice_type", F.col("volume_id").alias("source"), (F.col("volume_id") + 1).alias("target")).join(sized, "object_id")
    return A.merge_deltas(A.relocation_deltas(moves)).select("volume_id", "object_count", "logical_bytes", "physical_bytes")


@query("agg_10_counts", "select cast(sum(case when size >= 10000000 then 1 else 0 end) as bigint) as large, cast(sum(case when coalesce(length(recovery_comment), 0) > 0 then 1 else 0 end) as bigint) as dead, count(*) as n from objects")
def agg_10(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "objects").agg(F.count_if(F.col("size") >= 10000000).alias("large"), F.count_if(S.dead(F.col("recovery_comment"))).alias("dead"), F.count(F.lit(1)).alias("n"))


@query(
    "agg_13_pool_fill",
    f"""select round(t, 9) as target, cast(round(sum(case when {FILL} > t + 0.02 then ({FILL} - t) * bytes_total else 0 end)) as bigint) as bytes_to_move, cast(sum(case when {FILL} > t + 0.02 then 1 else 0 end) as bigint) as sources
      from volumes, (select cast(sum(bytes_total - {FREE}) as double) / cast(sum(bytes_total) as double) as t from volumes where not deleted) p where not deleted group by t""",
)
def agg_13(spark: SparkSession, sf: str) -> DataFrame:
    return A.pool_fill(R(spark, sf, "volumes"))


@query(
    "agg_14_fleet_status",
    f"""select coalesce(string_agg(cast(volume_id as string), ',' order by volume_id) filter (where not deleted and enabled and {READABLE}), '') as available,
      coalesce(string_agg(cast(volume_id as string), ',' order by volume_id) filter (where not deleted and enabled and not {READABLE}), '') as unavailable,
      coalesce(string_agg(cast(volume_id as string), ',' order by volume_id) filter (where not deleted and not enabled), '') as disabled,
      coalesce(string_agg(cast(volume_id as string), ',' order by volume_id) filter (where not deleted and read_only), '') as read_only_volumes,
      round(sum(case when not deleted then bytes_total end) / 1073741824.0::double, 6) as total_gb, round(sum(case when not deleted then coalesce(bytes_free, 0) end) / 1073741824.0::double, 6) as free_gb from volumes""",
)
def agg_14(spark: SparkSession, sf: str) -> DataFrame:
    return A.fleet_status(R(spark, sf, "volumes"))


@query(
    "agg_15_utilisation",
    """select cast(sum(bytes_total) as bigint) as total, cast(sum(bytes_data) as bigint) as data, cast(sum(bytes_parity) as bigint) as parity, cast(sum(coalesce(bytes_free, 0)) as bigint) as free,
      cast(sum(bytes_total - bytes_data - bytes_parity - coalesce(bytes_free, 0)) as bigint) as other, count(distinct device_group) as groups from volumes where not deleted and started""",
)
def agg_15(spark: SparkSession, sf: str) -> DataFrame:
    return A.utilisation(R(spark, sf, "volumes"))


@query(
    "agg_16_domain_load",
    "select object_id, case when device_group is null then 'ungrouped:' || cast(s.volume_id as string) else 'group:' || cast(device_group as string) end as domain, count(*) as load from slices s join volumes v on s.volume_id = v.volume_id where s.volume_id <> 3 group by 1, 2",
)
def agg_16(spark: SparkSession, sf: str) -> DataFrame:
    return A.domain_load(R(spark, sf, "slices"), R(spark, sf, "volumes"), moving=3)


@query("agg_28_last_verified", "select object_id, case when count(verified_at) = count(*) then min(verified_at) end as last_verified from slices group by object_id")
def agg_28(spark: SparkSession, sf: str) -> DataFrame:
    return V.last_verified(R(spark, sf, "slices"))


@query(
    "agg_31_error_ranking",
    "select volume_id, n, cast(row_number() over (order by n desc, volume_id) as int) as place from (select volume_id, count(*) as n from slices where error_code is not null and error_code <> 'IOABORT' group by volume_id) x",
)
def agg_31(spark: SparkSession, sf: str) -> DataFrame:
    errors = R(spark, sf, "slices").filter("error_code IS NOT NULL AND error_code <> 'IOABORT'").groupBy("volume_id").agg(F.count(F.lit(1)).alias("n"))
    return errors.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "volume_id")))


@query("agg_32_affected_objects", "select volume_id, count(distinct object_id) as affected from slices where error_code is not null group by volume_id")
def agg_32(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "slices").filter("error_code IS NOT NULL").groupBy("volume_id").agg(F.count_distinct("object_id").alias("affected"))


@query(
    "agg_34_orphan_rate_by_month",
    "select date_trunc('month', created_at) as month, count(*) as ingested, count(*) filter (where data_n = 0) as without_slices, round(cast(count(*) filter (where data_n = 0) as double) / count(*), 9) as rate from objects group by 1",
)
def agg_34(spark: SparkSession, sf: str) -> DataFrame:
    none = F.count_if(F.col("data_n") == 0)
    monthly = R(spark, sf, "objects").groupBy(F.date_trunc("month", "created_at").cast("timestamp_ntz").alias("month"))
    return monthly.agg(F.count(F.lit(1)).alias("ingested"), none.alias("without_slices"), F.round(none.cast("double") / F.count(F.lit(1)), 9).alias("rate"))


# Filters


@query("fil_02_03_on_volumes", "select distinct o.object_id, size from objects o join slices s on o.object_id = s.object_id where volume_id in (3, 5, 8) and size >= 5000000")
def fil_02(spark: SparkSession, sf: str) -> DataFrame:
    touched = R(spark, sf, "slices").filter(F.col("volume_id").isin(3, 5, 8)).select("object_id")
    return R(spark, sf, "objects").filter("size >= 5000000").join(touched, "object_id", "left_semi").select("object_id", "size")


_BOUNDARY = "timestamp '1996-06-01 00:00:00'"


def _boundary() -> F.Column:
    return F.lit("1996-06-01 00:00:00").cast("timestamp_ntz")


@query("fil_04_stale_objects", f"select object_id from objects where last_verified_at is null or last_verified_at < {_BOUNDARY}")
def fil_04(spark: SparkSession, sf: str) -> DataFrame:
    return V.needs_verification(R(spark, sf, "objects"), R(spark, sf, "slices"), _boundary(), None).select("object_id")


@query(
    "fil_05_06_worklist",
    f"""select object_id from objects o where (last_verified_at is null or last_verified_at < {_BOUNDARY}) and object_id > 100
      and exists (select 1 from slices s where s.object_id = o.object_id and volume_id in (1, 2, 4, 7) and (verified_at is null or verified_at < {_BOUNDARY})) order by object_id limit 25""",
)
def fil_05(spark: SparkSession, sf: str) -> DataFrame:
    return V.worklist(R(spark, sf, "objects"), R(spark, sf, "slices"), _boundary(), [1, 2, 4, 7], 100, 25).select("object_id")


@query("fil_07_stale_positions", f"select object_id, slice_index, slice_type from slices where volume_id in (2, 9) and (verified_at is null or verified_at < {_BOUNDARY})")
def fil_07(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "slices").filter(F.col("volume_id").isin(2, 9) & S.stale(F.col("verified_at"), _boundary())).select("object_id", "slice_index", "slice_type")


@query(
    "fil_08_verified_since",
    f"""select object_id from objects o where exists (select 1 from slices s where s.object_id = o.object_id and volume_id in (1, 2, 3))
      and not exists (select 1 from slices s where s.object_id = o.object_id and volume_id in (1, 2, 3) and (verified_at is null or verified_at < {_BOUNDARY}))""",
)
def fil_08(spark: SparkSession, sf: str) -> DataFrame:
    return V.verified_since(R(spark, sf, "objects"), R(spark, sf, "slices"), _boundary(), [1, 2, 3]).select("object_id")


@query("fil_09_live_objects", "select count(*) as live from objects where recovery_comment is null or length(recovery_comment) = 0")
def fil_09(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "objects").filter(~S.dead(F.col("recovery_comment"))).agg(F.count(F.lit(1)).alias("live"))


@query("fil_10_keyset_page", "select object_id, name from objects where object_id > 500 order by object_id limit 50")
def fil_10(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "objects").filter("object_id > 500").orderBy("object_id").limit(50).select("object_id", "name")


@query("fil_13_with_errors", "select object_id, count(*) as errors from slices where error_code is not null group by object_id")
def fil_13(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "slices").filter("error_code IS NOT NULL").groupBy("object_id").agg(F.count(F.lit(1)).alias("errors"))


@query("fil_15_volume_states", f"select volume_id, {READABLE} as readable, {WRITABLE} and not deleted as writable, enabled and not deleted and not present as missing from volumes")
def fil_15(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "volumes").select("volume_id", S.readable().alias("readable"), (S.writable() & ~F.col("deleted")).alias("writable"), S.missing().alias("missing"))


@query("fil_16_17_verifiable", f"select object_id, slice_index, s.volume_id, draining as skipped from slices s join volumes v on s.volume_id = v.volume_id where {READABLE} and healthy and not deleted")
def fil_16(spark: SparkSession, sf: str) -> DataFrame:
    return V.verifiable(R(spark, sf, "slices"), R(spark, sf, "volumes")).select("object_id", "slice_index", "volume_id", "skipped")


@query(
    "fil_21_authorisation",
    """select status, count(*) as n from (select case
        when split_part(ltrim(split_part(url, '?', 1), '/'), '/', 1) = '' or url like '/$%' then case when has_credential then 403 else 401 end
        when not has_credential then case when case when method in ('GET', 'HEAD') then b % 2 = 0 else b % 3 = 0 end then 200 else 401 end
        when b % 4 = credential_id % 4 and (method in ('GET', 'HEAD') or credential_id % 2 = 0) then 200 else 403 end as status
      from (select *, cast(nullif(regexp_extract(url, '^/bucket([0-9]+)/', 1), '') as bigint) as b from requests) r) s group by status""",
)
def fil_21(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets n are publicly readable if n % 2 = 0 and writable if n % 3 = 0; a credential c has grants on buckets with n % 4 = c % 4, writing if c is even."""
    ref = S.bucket_ref(F.col("url"))
    r = R(spark, sf, "requests").withColumn("bucket", ref["bucket"]).withColumn("b", F.regexp_extract("bucket", "^bucket([0-9]+)$", 1).try_cast("bigint"))
    is_read = F.col("method").isin("GET", "HEAD", "OPTIONS")
    grants = F.array(F.struct((F.col("credential_id") % 4).alias("rest"), F.lit(True).alias("read"), (F.col("credential_id") % 2 == 0).alias("write")))
    granted = F.exists(grants, lambda g: (F.col("b") % 4 == g["rest"]) & F.when(is_read, g["read"]).otherwise(g["write"]))
    public = F.when(is_read, F.col("b") % 2 == 0).otherwise(F.col("b") % 3 == 0)
    status = F.when(F.col("b").isNull(), F.when(F.col("has_credential"), 403).otherwise(401)).when(~F.col("has_credential"), F.when(public, 200).otherwise(401)).when(granted, 200).otherwise(403)
    return r.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


# Projections


@query(
    "prj_03_computed",
    f"select object_id, {SLICE_SIZE} as slice_size, data_n + parity_n as slices from objects",
)
def prj_03(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "objects").select("object_id", S.slice_size(F.col("size"), F.col("chunk_size"), F.col("data_n")).alias("slice_size"), (F.col("data_n") + F.col("parity_n")).alias("slices"))


@query("prj_07_file_paths", "select object_id, slice_index, label || '/' || substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || substr(h, 5, 2) || '/' || h || '.' || cast(slice_index as string) as path from (select object_id, slice_index, label, substr(md5(cast(object_id as string)), 1, 24) as h from slices s join volumes v on s.volume_id = v.volume_id) x")
def prj_07(spark: SparkSession, sf: str) -> DataFrame:
    joined = R(spark, sf, "slices").join(R(spark, sf, "volumes").select("volume_id", "label"), "volume_id")
    return joined.select("object_id", "slice_index", F.concat_ws("/", "label", S.shard_path(S.make_id(F.col("object_id")), F.col("slice_index"))).alias("path"))


@query("prj_08_descriptors", "select object_id, cast(slice_index as string) as key, case when slice_index < 4 then 'data' else 'parity' end as kind, volume_id from slices")
def prj_08(spark: SparkSession, sf: str) -> DataFrame:
    arrays = R(spark, sf, "slices").groupBy("object_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slice_index", "volume_id"))), lambda s: s["volume_id"]).alias("v"))  # six at most
    return arrays.select("object_id", F.posexplode("v").alias("i", "volume_id")).select("object_id", F.col("i").cast("string").alias("key"), F.when(F.col("i") < 4, "data").otherwise("parity").alias("kind"), "volume_id")


# Sorts, samples, sets


@query("srt_02_name_page", "select name, object_id as id from objects where container_id = 7 and name > 'obj-1' order by name limit 5")
def srt_02(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.namespace import page

    entries = R(spark, sf, "objects").filter("container_id = 7").select("name", F.col("object_id").alias("id"))
    return page(entries, "obj-1", 5).select("name", "id")


@query("srt_03_device_order", "select volume_id, cast(row_number() over (order by coalesce(device_group, 0), label, volume_id) as int) as place from volumes")
def srt_03(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "volumes").select("volume_id", F.row_number().over(Window.orderBy(F.coalesce("device_group", F.lit(0)), "label", "volume_id")).alias("place"))


@query("srt_06_seeded_sample", "select object_id from objects order by md5('7:' || cast(object_id as string)), object_id limit 100")
def srt_06(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "objects").orderBy(F.md5(F.concat(F.lit("7:"), F.col("object_id").cast("string")).cast("binary")), "object_id").limit(100).select("object_id")


@query("set_01_volume_sets", "select object_id, cast(count(distinct volume_id) as int) as distinct_volumes, cast(count(*) as int) as slices from slices group by object_id")
def set_01(spark: SparkSession, sf: str) -> DataFrame:
    """Union of an object's data and parity volumes as arrays of at most six."""
    split = R(spark, sf, "slices").groupBy("object_id").agg(*[F.collect_list(F.when(F.col("slice_type") == t, F.col("volume_id"))).alias(t) for t in ("data", "parity")])
    return split.select("object_id", F.size(F.array_union("data", "parity")).alias("distinct_volumes"), (F.size("data") + F.size("parity")).alias("slices"))


@query("set_04_absent_volumes", "select volume_id from volumes except select volume_id from slices")
def set_04(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "volumes").select("volume_id").join(R(spark, sf, "slices").select("volume_id"), "volume_id", "left_anti")


# Updates


@query("upd_01_backfill_sizes", f"select object_id, case when object_id % 3 = 0 then cast(object_id as bigint) else {SLICE_SIZE} end as slice_size, object_id % 3 <> 0 as filled from objects")
def upd_01(spark: SparkSession, sf: str) -> DataFrame:
    declared = F.when(F.col("object_id") % 3 == 0, F.col("object_id").cast("bigint"))
    return R(spark, sf, "objects").select("object_id", S.slice_size(F.col("size"), F.col("chunk_size"), F.col("data_n"), declared).alias("slice_size"), declared.isNull().alias("filled"))


@query("upd_03_reference_flip", "select object_id, slice_index, case when has_source and not has_target and volume_id = 5 then 6 else volume_id end as volume_id from (select *, bool_or(volume_id = 5) over w as has_source, bool_or(volume_id = 6) over w as has_target from slices window w as (partition by object_id)) x")
def upd_03(spark: SparkSession, sf: str) -> DataFrame:
    held = R(spark, sf, "slices").groupBy("object_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slice_index", "volume_id"))), lambda s: s["volume_id"]).alias("v"))
    flips = F.array_contains("v", 5) & ~F.array_contains("v", 6)
    moved = F.when(flips, S.replace_value(F.col("v"), F.lit(5), F.lit(6))).otherwise(F.col("v"))
    return held.select("object_id", F.posexplode(moved).alias("slice_index", "volume_id"))


@query("src_21_insert_if_absent", "select volume_id, label from volumes union all select volume_id + 1000000, 'new' from volumes where volume_id % 4 = 0")
def src_21(spark: SparkSession, sf: str) -> DataFrame:
    old = R(spark, sf, "volumes").select("volume_id", "label")
    new = old.filter("volume_id % 4 = 0").select((F.col("volume_id") + 1000000).alias("volume_id"), F.lit("new").alias("label")).unionByName(old.limit(1))
    return T.insert_if_absent(old, new, "volume_id")


@query("src_22_counters", f"select volume_id, object_count * 2 as object_count, physical_bytes * 2 as physical_bytes, false as negative from ({_PER_VOLUME}) p")
def src_22(spark: SparkSession, sf: str) -> DataFrame:
    usage = A.volume_usage(R(spark, sf, "slices"), R(spark, sf, "objects"))
    return A.apply_deltas(usage, usage).select("volume_id", "object_count", "physical_bytes", "negative")


@query("agg_18_category_histogram", f"select {CATEGORY} as category, count(*) as n from slices where error_code is not null group by 1")
def agg_18_categories(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.faults import category_histogram

    return category_histogram(R(spark, sf, "slices"))
