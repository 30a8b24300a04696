"""Queries: streams (EVT), stored tables (SRC), and what is left of the inventory."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import placement as P
from ..operators import replay as L
from ..operators import verification as V
from ..session import shared_folder
from ..sources import tables as T
from ..streaming import events as E
from .fixtures import driver_table
from .fixtures import relation as R
from .registry import READABLE, query


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    stream = E.read_events(spark, f"{sf}/events.parquet")
    return stream.withColumn("seconds", F.unix_seconds(F.col("ts").cast("timestamp")))


@query("evt_01_counter_stream", "select cast(user_id % 40 as bigint) as volume_id, cast(sum(case when event_type = 'error' then -1 else 1 end) as bigint) as total from {events} group by 1")
def evt_01(spark: SparkSession, sf: str) -> DataFrame:
    changes = _stream(spark, sf).select((F.col("user_id") % 40).alias("volume_id"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("change"))
    return E.latest(E.run_to_table(E.counters(changes, "volume_id", "change"), "update"), "volume_id")


@query("evt_02_fault_stream", "select cast(user_id % 50 as string) || ':' || cast(event_id % 6 as string) as key, min(ts) as first_seen, max(ts) as last_seen, count(*) as n from {events} group by 1")
def evt_02(spark: SparkSession, sf: str) -> DataFrame:
    keyed = _stream(spark, sf).select(F.concat_ws(":", (F.col("user_id") % 50).cast("string"), (F.col("event_id") % 6).cast("string")).alias("key"), "ts")
    return E.latest(E.run_to_table(E.fault_stream(keyed), "update"), "key")


_ORDERED = "row_number() over (partition by key order by s, event_id) as k"


@query(
    "evt_03_notifications",
    f"""with recursive n as (select *, {_ORDERED} from (select event_id, cast(user_id % 50 as bigint) as key, cast(floor(epoch(ts)) as bigint) as s, event_id % 3 as rank from {{events}}) e),
      walk as (select key, k, event_id, s as at_s, rank as at_r, true as accepted from n where k = 1
        union all select n.key, n.k, n.event_id, case when n.s - w.at_s < 300 and n.rank <= w.at_r then w.at_s else n.s end, case when n.s - w.at_s < 300 and n.rank <= w.at_r then w.at_r else n.rank end,
          not (n.s - w.at_s < 300 and n.rank <= w.at_r) from walk w join n on n.key = w.key and n.k = w.k + 1) select event_id, accepted from walk""",
)
def evt_03(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stream(spark, sf).select((F.col("user_id") % 50).alias("key"), "event_id", "seconds", (F.col("event_id") % 3).alias("rank"))
    return E.run_to_table(E.notifications(rows)).select("event_id", "accepted")


@query(
    "evt_04_signals",
    f"""with recursive n as (select *, {_ORDERED} from (select event_id, cast(user_id % 40 as bigint) as key, cast(floor(epoch(ts)) as bigint) as s, event_id % 2 = 0 as pending, event_id % 90 as cnt, event_id % 5 <> 0 as taken from {{events}}) e),
      first as (select key, cast(0 as bigint) as k, cast(-1 as bigint) as event_id, cast(-1000000000000 as bigint) as at_s, cast(0 as bigint) as high, false as accepted from n where k = 1),
      walk as (select * from first union all select n.key, n.k, n.event_id,
          case when not (n.pending and n.cnt <= w.high) and n.s - w.at_s >= 21600 and n.taken then n.s else w.at_s end,
          case when not (n.pending and n.cnt <= w.high) and n.s - w.at_s >= 21600 and n.taken and n.pending then n.cnt else w.high end,
          not (n.pending and n.cnt <= w.high) and n.s - w.at_s >= 21600 and n.taken from walk w join n on n.key = w.key and n.k = w.k + 1) select event_id, accepted from walk where k > 0""",
)
def evt_04(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    rows = _stream(spark, sf).select((F.col("user_id") % 40).alias("volume_id"), "event_id", "seconds", (e % 2 == 0).alias("pending"), (e % 90).alias("count"), (e % 5 != 0).alias("taken"))
    return E.run_to_table(E.signals(rows)).select("event_id", "accepted")


@query(
    "evt_15_logins",
    f"""with recursive n as (select *, {_ORDERED} from (select event_id, cast(user_id % 30 as bigint) as key, cast(floor(epoch(ts)) as bigint) as s, event_id % 7 = 0 as good from {{events}}) e),
      walk as (select key, cast(0 as bigint) as k, cast(-1 as bigint) as event_id, 0 as f, cast(-1000000000000 as bigint) as until, false as accepted from n where k = 1
        union all select n.key, n.k, n.event_id, case when n.s < w.until then w.f when n.good or w.f + 1 >= 5 then 0 else w.f + 1 end,
          case when n.s < w.until then w.until when n.good then -1000000000000 when w.f + 1 >= 5 then n.s + 900 else w.until end, n.s >= w.until from walk w join n on n.key = w.key and n.k = w.k + 1) select event_id, accepted from walk where k > 0""",
)
def evt_15(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stream(spark, sf).select((F.col("user_id") % 30).alias("account"), "event_id", "seconds", (F.col("event_id") % 7 == 0).alias("good"))
    return E.run_to_table(E.logins(rows)).select("event_id", "accepted")


@query(
    "evt_12_volume_health",
    f"select volume_id, n from (select cast(user_id % 40 as bigint) as v, count(*) as n from {{events}} where event_type = 'error' group by 1) e join volumes on v = volume_id where {READABLE} and n >= 10",
)
def evt_12(spark: SparkSession, sf: str) -> DataFrame:
    """A stream against a table: faults by readable volume, those with enough."""
    good = R(spark, sf, "volumes").filter(S.readable()).select("volume_id")
    faults = _stream(spark, sf).filter("event_type = 'error'").select((F.col("user_id") % 40).alias("volume_id")).join(good, "volume_id")
    counted = faults.groupBy("volume_id").agg(F.count(F.lit(1)).alias("n"))
    return E.latest(E.run_to_table(counted, "update"), "volume_id").filter("n >= 10")


@query("evt_13_device_transitions", """select device, state, ts from (select *, lag(state) over (partition by device order by ts, event_id) as before from (select event_id, cast(user_id % 20 as bigint) as device, ts, case when event_type = 'error' then 'missing' else 'present' end as state from {events}) e) x where before is null or before <> state""")
def evt_13(spark: SparkSession, sf: str) -> DataFrame:
    e = driver_table(spark, sf, "events").select("event_id", (F.col("user_id") % 20).alias("device"), "ts", F.when(F.col("event_type") == "error", "missing").otherwise("present").alias("state"))
    before = F.lag("state").over(Window.partitionBy("device").orderBy("ts", "event_id"))
    return e.withColumn("b", before).filter("b IS NULL OR b <> state").select("device", "state", "ts")


@query("ext_windowed_faults", "select time_bucket(interval '1 hour', ts) as start, event_type as source, count(*) as n from {events} group by 1, 2")
def ext_windows(spark: SparkSession, sf: str) -> DataFrame:
    """An addition: tumbling windows over the same observations, here over all that has come."""
    e = driver_table(spark, sf, "events").withColumn("source", F.col("event_type"))
    return E.windowed_faults(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("agg_29_request_counters", "select case when url like '/$%' then '(by-id)' when url = '/' then '(root)' else split_part(ltrim(url, '/'), '/', 1) end as key, count(*) filter (where not has_credential) as anonymous, count(*) filter (where has_credential) as authenticated from requests group by 1")
def agg_29(spark: SparkSession, sf: str) -> DataFrame:
    """The reference holds its counters to 1,024 keys, since they live in one process; as a table they need no such cap."""
    ref = S.bucket_ref(F.col("url"))
    key = F.when(ref["form"] == "id", "(by-id)").when(ref["form"] == "none", "(root)").otherwise(ref["bucket"])
    return R(spark, sf, "requests").groupBy(key.alias("key")).agg(F.count_if(~F.col("has_credential")).alias("anonymous"), F.count_if("has_credential").alias("authenticated"))


@query("agg_33_priority_stats", "select volume_id, count(*) filter (where source = 'read') as high, count(*) filter (where source <> 'read') as waiting from observations where volume_id is not null group by volume_id having count(*) filter (where source = 'read') > 0")
def agg_33(spark: SparkSession, sf: str) -> DataFrame:
    o = R(spark, sf, "observations").filter("volume_id IS NOT NULL")
    return o.groupBy("volume_id").agg(F.count_if(F.col("source") == "read").alias("high"), F.count_if(F.col("source") != "read").alias("waiting")).filter("high > 0")


@query("agg_35_lineage_vote", "select prefix, n, n = max(n) over () and count(*) filter (where n = top) over () = 1 as wins from (select *, max(n) over () as top from (select substr(md5(cast(volume_id % 5 as string)), 1, 8) as prefix, count(*) as n from volumes group by 1) a) b")
def agg_35(spark: SparkSession, sf: str) -> DataFrame:
    """Replicas whose first segment starts alike are one lineage; the largest wins unless it ties."""
    head = F.substring(F.md5((F.col("volume_id") % 5).cast("string").cast("binary")), 1, 8)
    lines = R(spark, sf, "volumes").groupBy(head.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    best = F.rank().over(Window.orderBy(F.desc("n")))
    ranked = lines.withColumn("r", best)
    return ranked.select("prefix", "n", ((F.col("r") == 1) & (F.sum((F.col("r") == 1).cast("int")).over(Window.partitionBy()) == 1)).alias("wins"))


@query("fil_01_kinds", "select parent_id is null as bucket, count(*) as n from containers group by 1")
def fil_01(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "containers").groupBy(F.col("parent_id").isNull().alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("fil_11_14_missing_fields", "select count(*) filter (where size is null) as no_size, count(*) filter (where name > 'obj-5' and last_verified_at is null) as unverified from objects")
def fil_11(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "objects").agg(F.count_if(F.col("size").isNull()).alias("no_size"), F.count_if((F.col("name") > "obj-5") & F.col("last_verified_at").isNull()).alias("unverified"))


@query("fil_22_delete_protected", "select object_id, coalesce(delete_protected, false) as refused from objects o left join containers c on o.bucket_id = c.id")
def fil_22(spark: SparkSession, sf: str) -> DataFrame:
    buckets = R(spark, sf, "containers").filter("parent_id IS NULL").select(F.col("id").alias("bucket_id"), "delete_protected")
    return R(spark, sf, "objects").join(buckets, "bucket_id", "left").select("object_id", F.coalesce("delete_protected", F.lit(False)).alias("refused"))


@query("fil_23_severe", "select event_id from {events} where event_id % 3 >= 1")
def fil_23(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, S.SEVERITIES)), (F.col("event_id") % 3 + 1).cast("int"))
    return driver_table(spark, sf, "events").filter(S.severity_rank(name) >= S.severity_rank(F.lit("warning"))).select("event_id")


@query("fil_24_covered_requests", "select v.volume_id, v.volume_id in (1, 2, 3) as covered from volumes v")
def fil_24(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "volumes").select("volume_id", (F.size(F.array_except(F.array("volume_id"), F.array(*[F.lit(i).cast("bigint") for i in (1, 2, 3)]))) == 0).alias("covered"))


@query("fil_25_fleet_complete", "select count(*) > 0 and count(*) filter (where not deleted and not (started and present)) = 0 as complete, count(*) filter (where not deleted and not (started and present)) as absent from volumes")
def fil_25(spark: SparkSession, sf: str) -> DataFrame:
    absent = F.count_if(~F.col("deleted") & ~(F.col("started") & F.col("present")))
    return R(spark, sf, "volumes").agg(((F.count(F.lit(1)) > 0) & (absent == 0)).alias("complete"), absent.alias("absent"))


@query("prj_01_02_columns", "select volume_id, label from volumes")
def prj_01(spark: SparkSession, sf: str) -> DataFrame:
    v = R(spark, sf, "volumes")
    return v.drop(*[c for c in v.columns if c not in ("volume_id", "label")])


@query("prj_04_ids", "select lower(md5(cast(object_id as string))) as id, container_id from objects")
def prj_04(spark: SparkSession, sf: str) -> DataFrame:
    raw = R(spark, sf, "objects").select(F.unhex(F.md5(F.col("object_id").cast("string").cast("binary"))).alias("_id"), "container_id")
    return raw.select(F.lower(F.hex("_id")).alias("id"), "container_id")


@query("prj_05_volume_rows", f"select volume_id, {READABLE} as readable, bytes_total - coalesce(bytes_free, 0) as used, case when smart_exit & 172 <> 0 then 'bad' else 'ok' end as smart from volumes".replace("smart_exit & 172 <> 0", "(smart_exit & 172) <> 0"))
def prj_05(spark: SparkSession, sf: str) -> DataFrame:
    used = F.col("bytes_total") - F.coalesce("bytes_free", F.lit(0))
    return R(spark, sf, "volumes").select("volume_id", S.readable().alias("readable"), used.alias("used"), F.when(S.smart_unhealthy(F.col("smart_exit")), "bad").otherwise("ok").alias("smart"))


@query("prj_06_manifest_round_trip", "select volume_id, label, partition_uuid from volumes")
def prj_06(spark: SparkSession, sf: str) -> DataFrame:
    """Volumes as one manifest row a group, and back."""
    packed = R(spark, sf, "volumes").groupBy("device_group").agg(F.collect_list(F.struct("volume_id", "label", "partition_uuid")).alias("v"))  # a fleet's disks
    return packed.selectExpr("inline(v)")


@query("sca_22_header_verdicts", "select status, case when status = 'ok' and h_chunk <> 16384 then 'stale' when status = 'ok' then 'ok' when status = 'absent' then 'missing' when status = 'unreadable' then 'unavail' else 'corrupt' end as verdict, count(*) as n from headers group by 1, 2")
def sca_22(spark: SparkSession, sf: str) -> DataFrame:
    verdict = F.when((F.col("status") == "ok") & (F.col("h_chunk") != S.CHUNK), "stale").when(F.col("status") == "ok", "ok").when(F.col("status") == "absent", "missing").when(F.col("status") == "unreadable", "unavail").otherwise("corrupt")
    return R(spark, sf, "headers").groupBy("status", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("sca_30_smart_json", "select event_id, cast(json_extract_string(props, '$.k') as int) as temperature from {events}")
def sca_30(spark: SparkSession, sf: str) -> DataFrame:
    """A field with a fallback: temperature.current, else k."""
    value = F.coalesce(F.get_json_object("props", "$.temperature.current"), F.get_json_object("props", "$.k"))
    return driver_table(spark, sf, "events").select("event_id", value.try_cast("int").alias("temperature"))


@query("src_03_checked_objects", "select object_id, size, chunk_size from objects where size is not null")
def src_03(spark: SparkSession, sf: str) -> DataFrame:
    """Objects by id; a bad geometry fails the query."""
    fine = (F.col("size") >= 0) & (F.col("chunk_size") > 0)
    checked = F.when(fine, F.col("size")).otherwise(F.raise_error(F.lit("an object's geometry is not usable")).cast("bigint"))
    return R(spark, sf, "objects").filter("size IS NOT NULL").select("object_id", checked.alias("size"), "chunk_size")


@query("src_15_torn_tail", "select line from oplog where line < (select max(line) from oplog)")
def src_15(spark: SparkSession, sf: str) -> DataFrame:
    log = R(spark, sf, "oplog")
    last = log.agg(F.max("line").alias("m"))
    torn = log.join(F.broadcast(last)).withColumn("op", F.when(F.col("line") != F.col("m"), F.col("op"))).drop("m")
    return T.torn_tail(torn).select("line")


@query("src_19_delete", "select object_id from objects where object_id not in (select object_id from objects where object_id % 4 = 0)")
def src_19(spark: SparkSession, sf: str) -> DataFrame:
    objects = R(spark, sf, "objects")
    return T.delete_rows(objects, objects.filter("object_id % 4 = 0"), "object_id").select("object_id")


@query(
    "upd_02_verification_state",
    """select o.object_id, case when bad then null when not open then seen else last_verified_at end as verified from objects o
      left join (select object_id, bool_or(error_code is not null) as bad, bool_or(verified_at is null) as open, min(verified_at) as seen from slices group by object_id) s on o.object_id = s.object_id""",
)
def upd_02(spark: SparkSession, sf: str) -> DataFrame:
    """An object's time is unset if a slice of it has an error, set to its oldest slice's if all were verified, and else left."""
    seen = R(spark, sf, "slices").groupBy("object_id").agg(F.bool_or(F.col("error_code").isNotNull()).alias("bad"), F.bool_or(F.col("verified_at").isNull()).alias("open"), F.min("verified_at").alias("seen"))
    verified = F.when(F.col("bad"), None).when(~F.col("open"), F.col("seen")).otherwise(F.col("last_verified_at"))
    return R(spark, sf, "objects").join(seen, "object_id", "left").select("object_id", verified.alias("verified"))


@query("upd_04_volume_flags", "select volume_id, case when volume_id % 2 = 0 then false else healthy end as healthy, volume_id % 2 = 0 and healthy as stamped from volumes")
def upd_04(spark: SparkSession, sf: str) -> DataFrame:
    change = F.col("volume_id") % 2 == 0
    return R(spark, sf, "volumes").select("volume_id", F.when(change, False).otherwise(F.col("healthy")).alias("healthy"), (change & F.col("healthy")).alias("stamped"))


@query("win_10_recent_faults", "select event_id, ts from observations order by ts desc, event_id limit 30")
def win_10(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "observations").orderBy(F.desc("ts"), "event_id").limit(30).select("event_id", "ts")
