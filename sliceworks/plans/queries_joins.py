"""Queries: the joins of the inventory (JOI), namespace (NS)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import namespace as N
from .fixtures import relation as R
from .registry import CATEGORY, query


@query("joi_01_slices_volumes", "select s.volume_id, label, count(*) as slices, count(*) filter (where error_code is not null) as faulty from slices s join volumes v on s.volume_id = v.volume_id group by 1, 2")
def joi_01(spark: SparkSession, sf: str) -> DataFrame:
    """Counts before the join: the dimension meets one row a volume."""
    counts = R(spark, sf, "slices").groupBy("volume_id").agg(F.count(F.lit(1)).alias("slices"), F.count("error_code").alias("faulty"))
    return counts.join(R(spark, sf, "volumes").select("volume_id", "label"), "volume_id").select("volume_id", "label", "slices", "faulty")


@query("joi_02_smart_summary", "select v.volume_id, label, case when v.volume_id % 2 = 0 then temperature end as temperature, case when v.volume_id % 2 = 0 then (smart_exit & 172) <> 0 end as bad from volumes v")
def joi_02(spark: SparkSession, sf: str) -> DataFrame:
    volumes = R(spark, sf, "volumes")
    smart = volumes.filter("volume_id % 2 = 0").select("volume_id", "temperature", S.smart_unhealthy(F.col("smart_exit")).alias("bad"))
    return volumes.select("volume_id", "label").join(smart, "volume_id", "left").select("volume_id", "label", "temperature", "bad")


@query(
    "joi_03_bucket_activity",
    "select b.name, coalesce(anon, 0) as anonymous, coalesce(auth, 0) as authenticated from (select 'bucket' || cast(i as string) as name from (select unnest(generate_series(0, 39)) as i) g) b left join (select regexp_extract(url, '^/(bucket[0-9]+)/', 1) as name, count(*) filter (where not has_credential) as anon, count(*) filter (where has_credential) as auth from requests group by 1) r on b.name = r.name",
)
def joi_03(spark: SparkSession, sf: str) -> DataFrame:
    buckets = spark.range(40).select(F.concat(F.lit("bucket"), F.col("id").cast("string")).alias("name"))
    counts = R(spark, sf, "requests").groupBy(S.bucket_ref(F.col("url"))["bucket"].alias("name")).agg(F.count_if(~F.col("has_credential")).alias("a"), F.count_if("has_credential").alias("b"))
    return buckets.join(counts, "name", "left").select("name", F.coalesce("a", F.lit(0)).alias("anonymous"), F.coalesce("b", F.lit(0)).alias("authenticated"))


@query("joi_04_bucket_stats", "select c.id, c.name, coalesce(n, 0) as object_count from containers c left join (select bucket_id, count(*) as n from objects group by bucket_id) o on c.id = o.bucket_id where c.parent_id is null")
def joi_04(spark: SparkSession, sf: str) -> DataFrame:
    buckets = R(spark, sf, "containers").filter("parent_id IS NULL").select("id", "name")
    stats = R(spark, sf, "objects").groupBy("bucket_id").agg(F.count(F.lit(1)).alias("n"))
    return buckets.join(stats, F.col("id") == F.col("bucket_id"), "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("object_count"))


@query("joi_09_named_with_slices", "select container_id, count(*) as kept from objects o where exists (select 1 from slices s where s.object_id = o.object_id and slice_index = 1) group by 1")
def joi_09(spark: SparkSession, sf: str) -> DataFrame:
    kept = R(spark, sf, "objects").join(R(spark, sf, "slices").filter("slice_index = 1").select("object_id"), "object_id", "left_semi")
    return kept.groupBy("container_id").agg(F.count(F.lit(1)).alias("kept"))


@query("joi_10_11_prune", "select object_id from objects where object_id not in (select object_id from slices where slice_type = 'parity')")
def joi_10(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "objects").join(R(spark, sf, "slices").filter("slice_type = 'parity'").select("object_id"), "object_id", "left_anti").select("object_id")


@query("joi_12_expected_volumes", "select volume_id from (select distinct volume_id from slices) s where volume_id not in (select volume_id from volumes where enabled)")
def joi_12(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "slices").select("volume_id").distinct().join(R(spark, sf, "volumes").filter("enabled").select("volume_id"), "volume_id", "left_anti")


BLOCK = 4096  # differences of bays and LUNs whose rows are put in order together

_DEVICES = "select 'sd' || chr(cast(97 + volume_id % 26 as int)) || cast(volume_id as string) as device, case when volume_id % 4 = 0 then null else partition_uuid end as uuid, volume_id % 10 as bridge, cast(volume_id as int) as lun, case when volume_id % 3 = 0 then null else cast(volume_id % 10 as string) || '.' || cast(100 + volume_id as string) end as label from volumes"


def _devices(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("volume_id")
    return R(spark, sf, "volumes").select(
        F.concat(F.lit("sd"), F.chr((97 + v % 26).cast("int")), v.cast("string")).alias("device"), F.when(v % 4 != 0, F.col("partition_uuid")).alias("uuid"), (v % 10).alias("bridge"), v.cast("int").alias("lun"),
        F.when(v % 3 != 0, F.concat_ws(".", (v % 10).cast("string"), (100 + v).cast("string"))).alias("label"),
    )


@query("joi_13_device_volumes", f"select device, volume_id from ({_DEVICES}) d left join volumes v on d.uuid = v.partition_uuid")
def joi_13(spark: SparkSession, sf: str) -> DataFrame:
    v = R(spark, sf, "volumes").select("volume_id", F.col("partition_uuid").alias("uuid"))
    return _devices(spark, sf).join(v, "uuid", "left").select("device", "volume_id")


@query(
    "joi_14_signal_volumes",
    """select s.device, case when e.volume_id is not null then e.volume_id when n = 1 then p.volume_id end as volume_id
      from (select distinct 'sd' || substr('abcdef', cast(1 + user_id % 6 as int), 1) || case when event_id % 2 = 0 then cast(1 + user_id % 3 as string) else '' end as device from {events}) s
      left join (select 'sd' || substr('abcdef', cast(1 + volume_id % 6 as int), 1) || cast(1 + volume_id % 3 as string) as name, min(volume_id) as volume_id from volumes where healthy group by 1) e on s.device = e.name
      left join (select 'sd' || substr('abcdef', cast(1 + volume_id % 6 as int), 1) as disk, min(volume_id) as volume_id, count(distinct volume_id) as n from volumes where started group by 1) p on coalesce(nullif(regexp_extract(s.device, '^([a-zA-Z]+)[0-9]+$', 1), ''), s.device) = p.disk""",
)
def joi_14(spark: SparkSession, sf: str) -> DataFrame:
    """A signal's volume by its exact partition, else by its disk if that holds one volume only."""
    letter = lambda c: F.substring(F.lit("abcdef"), (1 + c % 6).cast("int"), F.lit(1))
    events = spark.read.parquet(f"{sf}/events.parquet")
    number = F.when(F.col("event_id") % 2 == 0, (1 + F.col("user_id") % 3).cast("string")).otherwise("")
    signals = events.select(F.concat(F.lit("sd"), letter(F.col("user_id")), number).alias("device")).distinct()
    v = R(spark, sf, "volumes")
    exact = v.filter("healthy").groupBy(F.concat(F.lit("sd"), letter(F.col("volume_id")), (1 + F.col("volume_id") % 3).cast("string")).alias("device")).agg(F.min("volume_id").alias("e"))
    disks = v.filter("started").groupBy(F.concat(F.lit("sd"), letter(F.col("volume_id"))).alias("disk")).agg(F.min("volume_id").alias("p"), F.count_distinct("volume_id").alias("n"))
    joined = signals.withColumn("disk", F.coalesce(S.parent_disk(F.col("device")), F.col("device"))).join(exact, "device", "left").join(disks, "disk", "left")
    return joined.select("device", F.coalesce("e", F.when(F.col("n") == 1, F.col("p"))).alias("volume_id"))


@query(
    "joi_15_sibling_bays",
    f"""select device, grp, bay from (select a.device, cast(split_part(b.label, '.', 1) as int) as grp, cast(split_part(b.label, '.', 2) as int) + a.lun - b.lun as bay, row_number() over (partition by a.device order by b.device) as r
      from ({_DEVICES}) a join ({_DEVICES}) b on a.bridge = b.bridge and a.lun <> b.lun where a.label is null and b.label is not null and cast(split_part(b.label, '.', 2) as int) + a.lun - b.lun >= 1) x where r = 1""",
)
def joi_15(spark: SparkSession, sf: str) -> DataFrame:
    """An unlabelled device's bay by its bridge's first labelled one for which it comes out as 1 or more.

    The bay is the sibling's, less its LUN, plus the device's own: so of the siblings only this difference counts, and what is wanted is the first sibling
    whose difference is at least 1 less the LUN. That is a running minimum over differences and not a pair for each two devices; it is taken within blocks of
    ``BLOCK`` differences, over one row a block for what lies above. LUNs are the volumes' numbers, so no sibling has the device's own.
    """
    d = _devices(spark, sf)
    bay = S.label_bay(F.col("label"))
    sibling = F.struct(F.col("device").alias("sibling"), bay["group"].alias("grp"), (bay["bay"] - F.col("lun")).cast("bigint").alias("at"))
    known = d.filter("label IS NOT NULL").select("bridge", sibling.alias("s")).filter("s.at IS NOT NULL").groupBy("bridge", F.col("s.at").alias("at")).agg(F.min("s").alias("s"))
    asked = d.filter("label IS NULL").select("bridge", (1 - F.col("lun").cast("bigint")).alias("at"), "device").distinct()
    block = F.floor(F.col("at") / BLOCK)
    above = Window.partitionBy("bridge").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = known.withColumn("block", block).groupBy("bridge", "block").agg(F.min("s").alias("s"))
    wanted = asked.select("bridge", block.alias("block"), F.lit(None).cast(known.schema["s"].dataType).alias("s")).distinct()
    higher = blocks.unionByName(wanted).groupBy("bridge", "block").agg(F.min("s").alias("s")).select("bridge", "block", F.min("s").over(above).alias("higher"))
    rows = known.withColumn("device", F.lit(None).cast("string")).unionByName(asked.withColumn("s", F.lit(None).cast(known.schema["s"].dataType))).withColumn("block", block)
    inside = rows.withColumn("own", F.min("s").over(Window.partitionBy("bridge", "block").orderBy(F.desc("at"))))  # rows of one difference see each other
    found = inside.filter("device IS NOT NULL").join(higher, ["bridge", "block"]).select("device", F.col("at").alias("least"), F.least("own", "higher").alias("f")).filter("f IS NOT NULL")
    return found.select("device", "f.grp", (F.col("f.at") - F.col("least") + 1).cast("int").alias("bay"))


@query(
    "joi_16_all_volumes",
    "select coalesce(v.volume_id, s.volume_id) as volume_id, v.volume_id is not null as configured, coalesce(n, 0) as slices from (select volume_id from volumes where enabled) v full outer join (select volume_id, count(*) as n from slices where error_code is not null group by volume_id) s on v.volume_id = s.volume_id",
)
def joi_16(spark: SparkSession, sf: str) -> DataFrame:
    v = R(spark, sf, "volumes").filter("enabled").select("volume_id", F.lit(True).alias("c"))
    s = R(spark, sf, "slices").filter("error_code IS NOT NULL").groupBy("volume_id").agg(F.count(F.lit(1)).alias("n"))
    return v.join(s, "volume_id", "full_outer").select("volume_id", F.coalesce("c", F.lit(False)).alias("configured"), F.coalesce("n", F.lit(0)).alias("slices"))


@query("joi_17_bus_labels", f"select d.device, l.label as bus_label from ({_DEVICES}) d left join (select bridge, arg_min(label, device) as label from ({_DEVICES}) x where label is not null group by bridge) l on d.bridge = l.bridge")
def joi_17(spark: SparkSession, sf: str) -> DataFrame:
    d = _devices(spark, sf)
    labels = d.filter("label IS NOT NULL").groupBy("bridge").agg(F.min_by("label", "device").alias("bus_label"))
    return d.join(labels, "bridge", "left").select("device", "bus_label")


@query("joi_19_on_both", "select object_id from slices where volume_id in (4, 9) group by object_id having count(distinct volume_id) = 2")
def joi_19(spark: SparkSession, sf: str) -> DataFrame:
    both = R(spark, sf, "slices").filter(F.col("volume_id").isin(4, 9)).groupBy("object_id").agg(F.bit_or(F.when(F.col("volume_id") == 4, 1).otherwise(2)).alias("m"))
    return both.filter("m = 3").select("object_id")


@query("joi_22_grants", "select credential_id, count(*) as requests, count(*) filter (where b % 4 = credential_id % 4) as granted from (select *, cast(nullif(regexp_extract(url, '^/bucket([0-9]+)/', 1), '') as bigint) as b from requests) r where b is not null group by 1")
def joi_22(spark: SparkSession, sf: str) -> DataFrame:
    requests = R(spark, sf, "requests").withColumn("b", F.regexp_extract("url", "^/bucket([0-9]+)/", 1).try_cast("bigint")).filter("b IS NOT NULL")
    grants = spark.range(20).select(F.col("id").alias("credential_id"), F.array((F.col("id") % 4)).alias("rests"))
    joined = requests.join(grants, "credential_id")
    return joined.groupBy("credential_id").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.exists("rests", lambda r: r == F.col("b") % 4)).alias("granted"))


# Namespace

_PATHS = """paths as (select id, '/' || name as path, 1 as depth, id as bucket_id from containers where parent_id is null
  union all select c.id, p.path || '/' || c.name, p.depth + 1, p.bucket_id from paths p join containers c on c.parent_id = p.id)"""


@query("ns_01_paths", f"with recursive {_PATHS} select id, path, cast(depth as int) as depth, bucket_id from paths")
def ns_01(spark: SparkSession, sf: str) -> DataFrame:
    return N.paths(R(spark, sf, "containers"))


@query(
    "ns_01_02_resolve",
    f"""with recursive {_PATHS} select w.path, id, bucket_id, case when w.clean = '/' then 'root' when id is not null then 'found' when f.p is not null then 'file' else 'missing' end as outcome
      from (select path as path, path as clean from paths where id % 3 = 0 union all select path || '/nothing', path || '/nothing' from paths where id % 50 = 0 union all select '/', '/') w
      left join paths p on w.clean = p.path left join (select path || '/nothing' as p from paths where id = 1000050) f on w.clean = f.p""",
)
def ns_02(spark: SparkSession, sf: str) -> DataFrame:
    containers = R(spark, sf, "containers")
    known = N.paths(containers)
    wanted = known.filter("id % 3 = 0").select("path").unionByName(known.filter("id % 50 = 0").select(F.concat("path", F.lit("/nothing")).alias("path"))).unionByName(spark.range(1).select(F.lit("/").alias("path")))
    files = spark.range(1).select(F.lit(1000050).cast("bigint").alias("container_id"), F.lit("nothing").alias("name"))
    return N.resolve(wanted, containers, files).select("path", "id", "bucket_id", "outcome")


@query(
    "ns_03_objects_by_path",
    f"with recursive {_PATHS} select path || '/' || o.name as path, object_id, container_id from objects o join paths p on p.id = 1000000 + o.container_id",
)
def ns_03(spark: SparkSession, sf: str) -> DataFrame:
    containers = R(spark, sf, "containers")
    objects = R(spark, sf, "objects").withColumn("container_id", 1000000 + F.col("container_id"))
    wanted = N.paths(containers).join(objects, F.col("id") == F.col("container_id")).select(F.concat_ws("/", "path", "name").alias("path")).distinct()
    return N.objects_by_path(wanted, containers, objects).withColumn("container_id", F.col("container_id") - 1000000)


@query("ns_04_children", "select id, name, true as is_container from containers where parent_id = 1007 union all select object_id, name, false from objects where container_id = 1007")
def ns_04(spark: SparkSession, sf: str) -> DataFrame:
    return N.children(R(spark, sf, "containers"), R(spark, sf, "objects"), 1007)


@query("ns_05_child_page", "select id, name, (select count(*) from containers where parent_id = 1007 and name > 'Customer#000000100') > 10 as has_more from containers where parent_id = 1007 and name > 'Customer#000000100' order by name, id limit 10")
def ns_05(spark: SparkSession, sf: str) -> DataFrame:
    entries = R(spark, sf, "containers").filter("parent_id = 1007").select("id", "name")
    return N.page(entries, "Customer#000000100", 10).select("id", "name", "has_more")


@query(
    "ns_06_08_roots",
    """with recursive up as (select id, id as anc, parent_id, 0 as n from containers union all select u.id, c.id, c.parent_id, u.n + 1 from up u join containers c on u.parent_id = c.id where u.n < 10)
      select c.id, r.anc as root_id, t.anc as top_id from containers c left join (select id, anc from up where parent_id is null) r on c.id = r.id
      left join (select id, anc from up where parent_id is null or parent_id not in (select id from containers)) t on c.id = t.id""",
)
def ns_06(spark: SparkSession, sf: str) -> DataFrame:
    return N.roots(R(spark, sf, "containers"))


@query(
    "ns_07_bucket_backfill",
    """with recursive up as (select id, id as anc, parent_id, 0 as n from containers union all select u.id, c.id, c.parent_id, u.n + 1 from up u join containers c on u.parent_id = c.id where u.n < 10)
      select c.id, coalesce(known_bucket, r.anc) as bucket_id, known_bucket is null and r.anc is not null as filled from containers c left join (select id, anc from up where parent_id is null) r on c.id = r.id""",
)
def ns_07(spark: SparkSession, sf: str) -> DataFrame:
    return N.backfill_buckets(R(spark, sf, "containers"))


@query(
    "ns_09_missing_containers",
    r"""with parts as (select string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '\?.*$', ''), '/') as p from {pages}),
      pre as (select distinct '/' || array_to_string(p[1:i], '/') as path, i as depth from (select list_filter(p, lambda x: x <> '') as p from parts) q, (select unnest(generate_series(1, 12)) as i) g where i < len(p)) select path, cast(depth as int) as depth from pre""",
)
def ns_09(spark: SparkSession, sf: str) -> DataFrame:
    files = spark.read.parquet(f"{sf}/pages.parquet").select(F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"\?.*$", "")).alias("path"))
    return N.missing_containers(files, R(spark, sf, "containers"))


@query("ns_10_buckets", "select id, name, public_read, public_write, delete_protected from containers where parent_id is null")
def ns_10(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "containers").filter("parent_id IS NULL").select("id", "name", "public_read", "public_write", "delete_protected")


@query("srt_05_parents_first", f"with recursive {_PATHS} select c.id, c.parent_id, coalesce(cast(p.depth as int), 0) as depth from containers c left join paths p on c.id = p.id")
def srt_05(spark: SparkSession, sf: str) -> DataFrame:
    return N.parents_first(R(spark, sf, "containers"))


@query("src_05_root_policies", "select id, case when parent_id is null then public_read end as public_read, case when parent_id is null then delete_protected end as delete_protected from containers")
def src_05(spark: SparkSession, sf: str) -> DataFrame:
    root = F.col("parent_id").isNull()
    return R(spark, sf, "containers").select("id", *[F.when(root, F.col(c)).alias(c) for c in ("public_read", "delete_protected")])
