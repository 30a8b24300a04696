"""Queries: stored tables that are written, judged and rewritten; recovery, repair and verification runs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import accounting as A
from ..operators import faults as X
from ..operators import placement as P
from ..operators import replay as L
from ..operators import verification as V
from ..session import shared_folder
from ..sources import tables as T
from ..streaming import events as E
from .fixtures import driver_table
from .fixtures import relation as R
from .queries_accounting import _COUNTERS
from .queries_drift import _MANIFESTS, _STATE, _TRIAGED, _VERDICTS, _manifests
from .registry import CATEGORY, ESTIMATE, FREE, READABLE, WRITABLE, query


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _namespace(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Containers and objects as snapshots hold them."""
    c = R(spark, sf, "containers")
    containers = c.select(F.col("id").cast("string").alias("id"), F.col("parent_id").cast("string").alias("cid"), "name", F.col("public_read").alias("pr"), F.col("public_write").alias("pw"), F.col("delete_protected").alias("dp"))
    objects = R(spark, sf, "objects").select(F.col("object_id").cast("string").alias("id"), (1000000 + F.col("container_id")).cast("string").alias("cid"), "name", "size")
    return containers, objects


_WITHOUT_HOME = "(select count(*) from objects where container_id is not null and 1000000 + container_id not in (select id from containers)) + (select count(*) from containers where parent_id is not null and parent_id not in (select id from containers))"


@query("src_09_10_snapshot_round_trip", f"select true as complete, true as counts_hold, true as sum_holds, cast({_WITHOUT_HOME} as bigint) as dangling, cast(0 as bigint) as broken")
def src_09(spark: SparkSession, sf: str) -> DataFrame:
    """Write a snapshot, read it, judge it."""
    path = _new_path(spark, "snapshot")
    T.write_snapshot(*_namespace(spark, sf), path)
    return T.snapshot_verdict(T.read_records(spark, path))


@query(
    "rep_05_06_snapshot_choice",
    """select 1 as place, false as complete, false as counts_hold, false as sum_holds, false as used, cast(null as bigint) as objects union all select 2, true, true, false, false, null
      union all select 3, true, true, true, true, (select count(*) from objects where status <> 'F')""",
)
def rep_05(spark: SparkSession, sf: str) -> DataFrame:
    """Three snapshots, newest first: one that isn't there, one of which a record was altered in place, one that is whole. The last is used, and that is reported with what it holds."""
    containers, objects = _namespace(spark, sf)
    older, newer, altered = (_new_path(spark, "snapshot") for _ in range(3))
    T.write_snapshot(containers, objects.join(R(spark, sf, "objects").filter("status <> 'F'").select(F.col("object_id").cast("string").alias("id")), "id", "left_semi"), older)
    T.write_snapshot(containers, objects, newer)
    first = objects.agg(F.min("id").alias("i")).first()["i"]
    lines = spark.read.text(newer)
    changed = F.when((F.get_json_object("value", "$.id") == first) & F.contains("value", F.lit('"op":"put"')), F.regexp_replace("value", '"name":"', '"name":"x')).otherwise(F.col("value"))
    lines.select(changed.alias("value")).write.option("compression", "gzip").text(altered)
    used, report = T.usable_snapshot(spark, [_new_path(spark, "nothing"), altered, older])
    held = T.read_records(spark, used).filter("op = 'put'").agg(F.count(F.lit(1)).alias("n"))
    return report.join(F.broadcast(held)).select("place", "complete", "counts_hold", "sum_holds", "used", F.when(F.col("used"), F.col("n")).alias("objects"))


@query("upd_05_restored_containers", "select cast(id as string) as id, public_read, public_write, delete_protected from containers")
def upd_05(spark: SparkSession, sf: str) -> DataFrame:
    """Flags that a container's record lacks stay absent through a snapshot and back."""
    path = _new_path(spark, "snapshot")
    T.write_snapshot(*_namespace(spark, sf), path)
    return T.restored_containers(T.read_records(spark, path)).select("id", "public_read", "public_write", "delete_protected")


@query(
    "upd_06_refreshed_unavailable",
    f"""select object_count, logical_bytes, unavailable_object_count, unavailable_logical_bytes from (select {_COUNTERS} from objects) s,
      (select count(*) as unavailable_object_count, cast(coalesce(sum(coalesce(size, 0)), 0) as bigint) as unavailable_logical_bytes from objects o join (select object_id, count(*) as lost from (select distinct object_id, slice_type, s.volume_id from slices s
        join volumes v on s.volume_id = v.volume_id where not {READABLE}) d group by object_id) l on o.object_id = l.object_id where lost > parity_n) u""",
)
def upd_06(spark: SparkSession, sf: str) -> DataFrame:
    """Stored totals of which only the part on unavailable objects is counted again and replaced."""
    objects, slices, volumes = (R(spark, sf, n) for n in ("objects", "slices", "volumes"))
    path = _new_path(spark, "stats")
    A.system_usage(objects).select("*", F.lit(-1).cast("bigint").alias("unavailable_object_count"), F.lit(-1).cast("bigint").alias("unavailable_logical_bytes")).write.parquet(path)
    fresh = A.refreshed_unavailable(spark.read.parquet(path), objects, slices, volumes)
    return fresh.select("object_count", "logical_bytes", "unavailable_object_count", "unavailable_logical_bytes")


@query("upd_07_archive_dead", "select object_id, case when coalesce(length(recovery_comment), 0) > 0 then 'archive' else 'live' end as place from objects")
def upd_07(spark: SparkSession, sf: str) -> DataFrame:
    """Dead objects move to a table of their own, and leave theirs once the copy is verified."""
    path = _new_path(spark, "archive")
    objects = R(spark, sf, "objects")
    live = T.archived(objects, S.dead(F.col("recovery_comment")), path)
    return live.select("object_id", F.lit("live").alias("place")).unionByName(spark.read.schema(objects.schema).parquet(path).select("object_id", F.lit("archive").alias("place")))


@query(
    "src_20_upsert",
    """select volume_id, case when volume_id % 3 = 0 then 'new' else label end as label, case when volume_id % 3 = 0 then null else 'blocked' end as repair_status, volume_id as first_seen from volumes
      union all select volume_id + 1000000, 'new', null, cast(-1 as bigint) from volumes where volume_id % 3 = 0""",
)
def src_20(spark: SparkSession, sf: str) -> DataFrame:
    """Values are replaced, an unset status is cleared, and the first time of a row that is there already stays."""
    v = R(spark, sf, "volumes")
    old = v.select("volume_id", "label", F.lit("blocked").alias("repair_status"), F.col("volume_id").cast("bigint").alias("first_seen"))
    some = v.filter("volume_id % 3 = 0").select("volume_id", F.explode(F.array(F.lit(0), F.lit(1000000))).alias("by"))
    new = some.select((F.col("volume_id") + F.col("by")).alias("volume_id"), F.lit("new").alias("label"), F.lit(None).cast("string").alias("repair_status"), F.lit(-1).cast("bigint").alias("first_seen"))
    return T.upsert(old, new, "volume_id", unset=("repair_status",), on_insert=("first_seen",))


@query("sca_11_triaged_categories", f"select bucket, coalesce(category, 'good') as category, count(*) as n from (select object_id, bucket from ({_TRIAGED}) t) b join (select object_id, case when error_code is not null then {CATEGORY} end as category from slices) s on b.object_id = s.object_id group by 1, 2")
def sca_11(spark: SparkSession, sf: str) -> DataFrame:
    """Categories of the slices of objects in each triage bucket."""
    slices = R(spark, sf, "slices")
    category = F.coalesce(F.when(F.col("error_code").isNotNull(), S.error_category(F.col("error_code"))), F.lit("good"))
    return slices.select("object_id", category.alias("category")).join(X.triaged(slices).select("object_id", "bucket"), "object_id").groupBy("bucket", "category").agg(F.count(F.lit(1)).alias("n"))


_DIAGNOSED = f"""select s.object_id, s.slice_index, case when v.volume_id is null then 'volume-unavailable' when category = 'missing' then 'file-missing' when category in ('io', 'timeout', 'volume-unavailable') then 'io-error'
    when category in ('checksum', 'parity-mismatch') then 'data-bad' else 'restampable' end as diagnosis, (object_id + slice_index) % 3 <> 0 as real
  from (select *, {CATEGORY} as category from slices where error_code is not null) s left join (select volume_id from volumes where {READABLE}) v on s.volume_id = v.volume_id
  where object_id in (select object_id from (select distinct object_id from slices where error_code is not null) f order by md5('3:' || cast(object_id as string)), object_id limit 500)"""


@query(
    "agg_19_flagged_sample",
    f"""select 'slice' as what, diagnosis as state, count(*) as n, count(*) filter (where diagnosis = 'restampable' and real) as names_real from ({_DIAGNOSED}) d group by diagnosis
      union all select 'object', class, count(*), null from (select object_id, case when bool_or(diagnosis = 'data-bad') then 'has-data-bad' when bool_or(diagnosis = 'volume-unavailable') and not bool_or(diagnosis = 'restampable') then 'volume-unavailable'
        when bool_or(diagnosis = 'volume-unavailable') then 'mixed' else 'all-restampable' end as class from ({_DIAGNOSED}) d group by object_id) o group by class""",
)
def agg_19(spark: SparkSession, sf: str) -> DataFrame:
    """What is behind the flags of 500 objects at random (by a seeded hash): slices by diagnosis, objects by class."""
    slices, objects = R(spark, sf, "slices"), R(spark, sf, "objects")
    key = F.md5(F.concat(F.lit("3:"), F.col("object_id").cast("string")).cast("binary"))
    sample = slices.filter("error_code IS NOT NULL").select("object_id").distinct().orderBy(key, "object_id").limit(500)
    some = slices.join(sample, "object_id", "left_semi")
    headers = some.select("object_id", "slice_index", F.when((F.col("object_id") + F.col("slice_index")) % 3 == 0, -F.col("object_id")).otherwise(F.col("object_id")).alias("header_id"))
    found = X.flagged_diagnosis(some, R(spark, sf, "volumes"), objects, headers)
    by_slice = found.groupBy("diagnosis").agg(F.count(F.lit(1)).alias("n"), F.count_if("names_real").alias("names_real")).select(F.lit("slice").alias("what"), F.col("diagnosis").alias("state"), "n", "names_real")
    by_object = X.diagnosed_objects(found).groupBy("class").agg(F.count(F.lit(1)).alias("n")).select(F.lit("object").alias("what"), F.col("class").alias("state"), "n", F.lit(None).cast("bigint").alias("names_real"))
    return by_slice.unionByName(by_object)


@query(
    "agg_21_parity_health",
    """with d as (select doc_id, greatest(1, cast(ceil(length(regexp_replace(text, '[^ -~]', '', 'g')) / 256.0) as int)) as n from {documents} where length(regexp_replace(text, '[^ -~]', '', 'g')) > 0),
      c as (select doc_id, k, n, (doc_id * 31 + k) % 97 <> 0 as d_ok, (doc_id + k) % 5 <> 0 as a_ok, (doc_id * 7 + k * 3) % (2 + doc_id % 6) <> 0 as b_ok from (select doc_id, n, unnest(range(0, n)) as k from d) x),
      o as (select doc_id, count(*) as chunks, count(*) filter (where a_ok) as a_ok, count(*) filter (where b_ok) as b_ok, case when bool_and(d_ok) then count(*) filter (where a_ok or b_ok) else 0 end as recoverable,
        count(*) filter (where not a_ok and not b_ok) as same, count(*) filter (where a_ok <> b_ok) as different from c group by doc_id)
      select case when recoverable = 0 then '0%' when recoverable / chunks < 0.25 then '1-25%' when recoverable / chunks < 0.75 then '25-75%' when recoverable / chunks < 0.99 then '75-99%' else '100%' end as bin, count(*) as objects, cast(sum(chunks) as bigint) as chunks,
        cast(sum(a_ok) as bigint) as a_ok, cast(sum(b_ok) as bigint) as b_ok, cast(sum(recoverable) as bigint) as recoverable, count(*) filter (where same > different) as mostly_same, count(*) filter (where same <= different and different > 0) as differing from o group by 1""",
)
def agg_21(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of 256 bytes of each document and of two damaged copies, each checked by its sum, rolled up by the share that can be recovered."""
    body = driver_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", "[^ -~]", "").cast("binary").alias("body"))
    chunks = T.chunks(body, 256)
    i, k = F.col("id"), F.col("k")

    def fine(kept: Column) -> Column:
        stored = F.when(kept, F.col("data")).otherwise(F.concat(F.lit("!").cast("binary"), F.col("data")))
        return F.md5(stored) == F.col("md5")

    flags = chunks.select(i.alias("object_id"), "k", fine((i * 31 + k) % 97 != 0).alias("data_ok"), fine((i + k) % 5 != 0).alias("a_ok"), fine((i * 7 + k * 3) % (2 + i % 6) != 0).alias("b_ok"))
    health = V.chunk_health(flags)
    mostly = F.col("same") > F.col("different")
    return health.groupBy("bin").agg(
        F.count(F.lit(1)).alias("objects"), *[F.sum(c).alias(c) for c in ("chunks", "a_ok", "b_ok", "recoverable")], F.count_if(mostly).alias("mostly_same"), F.count_if(~mostly & (F.col("different") > 0)).alias("differing")
    )


_FOLD = """(select id, sum(refused) as refused from (select id, case when pr and (not fr or shut_r) then 1 else 0 end + case when pw and (not fw or shut_w) then 1 else 0 end + case when not dp and (fd or shut_d) then 1 else 0 end as refused
    from (select id, pr, pw, dp, id % 2 = 0 as fr, id % 3 = 0 as fw, id % 5 = 0 as fd, coalesce(bool_or(not pr) over w, false) as shut_r, coalesce(bool_or(not pw) over w, false) as shut_w, coalesce(bool_or(dp) over w, false) as shut_d
      from oplog where op = 'policy' window w as (partition by id order by line rows between unbounded preceding and 1 preceding)) p) q group by id)"""

_FATES = f"""(select x.id, parked, s.object_id is not null as there, x.id % 3 = 0 as named, verdict from ({_STATE}) x left join (select distinct object_id from slices) s on x.id = s.object_id left join ({_VERDICTS}) v on x.id = v.object_id where kind = 'put')"""


@query(
    "agg_30_replay_summary",
    f"""select (select count(*) from ({_STATE}) c where kind = 'container') as containers, count(*) filter (where not parked or there) as objects_in_namespace, count(*) filter (where there and verdict not in ('deferred', 'below-quorum')) as objects_restored,
      count(*) filter (where not there and not parked and named) as objects_missing, count(*) filter (where there and verdict = 'below-quorum') as objects_unrecoverable, count(*) filter (where there and verdict = 'deferred') as objects_indeterminate,
      count(*) filter (where there and parked) as dels_ignored, count(*) filter (where not there and not parked and not named) as puts_dropped,
      (select count(*) from objects where object_id not in (select id from {_FATES} k where there and verdict <> 'below-quorum' union all select id from ({_STATE}) c where kind = 'container')) as rows_pruned,
      cast(coalesce((select sum(refused) from {_FOLD} f), 0) as bigint) as policies_declined from {_FATES} f""",
)
def agg_30(spark: SparkSession, sf: str) -> DataFrame:
    """The counters of a restore."""
    log = R(spark, sf, "oplog")
    names = L.replay(log)
    initial = log.select("id").distinct().select("id", (F.col("id") % 2 == 0).alias("pr"), (F.col("id") % 3 == 0).alias("pw"), (F.col("id") % 5 == 0).alias("dp"))
    existing = R(spark, sf, "objects").select(F.col("object_id").alias("id"))
    verdicts = V.object_verdicts(R(spark, sf, "headers"))
    return L.restore_summary(names, R(spark, sf, "slices"), verdicts, names.filter("id % 3 = 0"), existing, L.fold_policy(log, initial))


@query(
    "rep_08_manifest_reconcile",
    f"""with m as ({_MANIFESTS}), g as (select identity, count(*) as n from m where identity is not null group by identity), b as (select identity from g order by n desc, identity desc limit 1)
      select (select identity from b) as identity, (select count(*) from m where identity = (select identity from b)) as agreeing, (select count(*) from m where identity <> (select identity from b)) as foreign,
        (select count(*) from m where identity is null) as silent, 2 * (select count(*) from m where identity = (select identity from b)) > (select count(*) from m) as complete,
        (select device from m where identity = (select identity from b) order by updated_at desc, device desc limit 1) as newest_table, (select device from m where identity = (select identity from b) and completed_at is not null order by completed_at desc, device desc limit 1) as newest_snapshot""",
)
def rep_08(spark: SparkSession, sf: str) -> DataFrame:
    return L.reconciled_manifest(_manifests(spark, sf))


@query("rep_10_reconciled", f"select {_COUNTERS}, 2 as passes from objects")
def rep_10(spark: SparkSession, sf: str) -> DataFrame:
    """Totals counted while the table changes once: the second pass holds."""
    objects = R(spark, sf, "objects")
    reads = iter([objects.filter("status <> 'P'")])  # the first look; whole from then on
    found, passes = A.reconciled(lambda: next(reads, objects))
    return found.withColumn("passes", F.lit(passes))


@query("rep_10_idempotent_replay", f"select id, kind, name, cid, size, parked from ({_STATE}) x")
def rep_10_twice(spark: SparkSession, sf: str) -> DataFrame:
    """Replaying a log twice leaves what replaying it once leaves."""
    log = R(spark, sf, "oplog")
    last = log.agg(F.max("line").alias("m"))
    again = log.join(F.broadcast(last)).withColumn("line", F.col("line") + F.col("m") + 1).drop("m")
    return L.replay(log.unionByName(again)).select("id", "kind", "name", "cid", "size", "parked")


@query(
    "rep_12_drain_left",
    f"""select count(*) filter (where has) as moved, count(*) filter (where not has) as stuck from (select s.object_id, s.slice_index, exists (select 1 from volumes t where {WRITABLE} and not deleted and t.volume_id <> 11 and {FREE} >= need
      and not exists (select 1 from slices h where h.object_id = s.object_id and h.volume_id = t.volume_id)) as has from (select s.object_id, s.slice_index, {ESTIMATE} as need from slices s join objects o on s.object_id = o.object_id where s.volume_id = 11) s) x""",
)
def rep_12(spark: SparkSession, sf: str) -> DataFrame:
    """Passes of a drain until nothing more moves: how many slices left the volume, and how many could not."""
    _, left = P.drained(R(spark, sf, "slices"), R(spark, sf, "volumes"), R(spark, sf, "objects"), 11)
    return spark.range(1).select(F.lit(left[0] - left[-1]).cast("bigint").alias("moved"), F.lit(left[-1]).cast("bigint").alias("stuck"))


@query(
    "agg_37_audit_rollup",
    f"""with p as (select volume_id, case when not started then 'unreadable' when not healthy then 'refused' when device_group is null then 'unidentified' when draining then 'not_checked' else 'opened' end as outcome from volumes where not deleted)
      select {", ".join(f"count(*) filter (where outcome = '{k}') as {k}" for k in ("opened", "refused", "unreadable", "unidentified", "not_checked"))}, (select count(*) from volumes where deleted) as absent,
        count(*) filter (where outcome <> 'opened') + (select count(*) from volumes where deleted) = 0 as healthy from p""",
)
def agg_37(spark: SparkSession, sf: str) -> DataFrame:
    v = R(spark, sf, "volumes")
    outcome = F.when(~F.col("started"), "unreadable").when(~F.col("healthy"), "refused").when(F.col("device_group").isNull(), "unidentified").when(F.col("draining"), "not_checked").otherwise("opened")
    return V.audit_rollup(v.filter("NOT deleted").select("volume_id", outcome.alias("outcome")), v.select("volume_id"))


@query(
    "agg_37_audit_due",
    """select volume_id, case when volume_id % 4 = 0 then 'never' when volume_id % 200 >= 90 then 'old' when volume_id % 5 = 0 then 'token-missing' when volume_id % 3 = 0 then 'token-changed' end as reason from volumes""",
)
def agg_37_due(spark: SparkSession, sf: str) -> DataFrame:
    v, now = F.col("volume_id"), F.lit("2024-12-01").cast("date")
    last = F.when(v % 4 != 0, F.date_sub(now, (v % 200).cast("int")))
    token = F.when(v % 5 != 0, F.concat(F.lit("t"), (v % 3).cast("string")))
    return R(spark, sf, "volumes").select("volume_id", V.audit_due(last, now, token, F.when(v % 3 == 0, "t9").otherwise(F.concat(F.lit("t"), (v % 3).cast("string")))).alias("reason"))


@query(
    "evt_05_poll_cursor",
    """select device, count(*) as n from (select case event_id % 8 when 6 then 'dm-7' else 'sd' || substr('abcdef', cast(1 + user_id % 6 as int), 1) || case when event_id % 8 in (1, 3, 5) then '1' else '' end end as device from {events} where event_id % 8 not in (4, 7)) x group by device""",
)
def evt_05(spark: SparkSession, sf: str) -> DataFrame:
    """Three polls of a growing log, of which the second fails: the third covers its window again, and each line counts once."""
    base, log = _new_path(spark, "poll"), _new_path(spark, "log")
    lines = R(spark, sf, "log_lines")
    signals = F.explode(S.log_signals(F.col("value")))
    lines.filter("event_id % 2 = 0").select("line").write.text(log)
    E.poll(spark, log, base, lambda rows: rows.select(signals.alias("s")).select("s.device"))
    lines.filter("event_id % 2 = 1").select("line").write.mode("append").text(log)

    def fails(rows: DataFrame) -> DataFrame:
        raise RuntimeError("the reader is away")

    try:
        E.poll(spark, log, base, fails)
    except Exception as e:
        if "the reader is away" not in str(e):
            raise
    return E.poll(spark, log, base, lambda rows: rows.select(signals.alias("s")).select("s.device")).groupBy("device").agg(F.count(F.lit(1)).alias("n"))


@query(
    "evt_07_repair_batch",
    f"""with k as (select distinct coalesce(cast(volume_id as string), 'unknown') || ':' || cast(object_id as string) || ':' || cast(slice_index as string) as key, object_id from observations where object_id % 7 <> 0),
      n as (select key, object_id, cast(floor((row_number() over (order by key) - 1) / 25) as int) as pass from k), v as ({_VERDICTS})
      select key, pass, coalesce(verdict, 'gone') as verdict, row_number() over (partition by pass, n.object_id order by key) = 1 as verifies from n left join v on n.object_id = v.object_id""",
)
def evt_07(spark: SparkSession, sf: str) -> DataFrame:
    """The repair queue in passes of 25, each object verified once a pass."""
    keys = R(spark, sf, "observations").select(S.fault_key(F.col("volume_id"), F.col("object_id"), F.col("slice_index")).alias("key"), "object_id").distinct()
    return X.repair_passes(keys.withColumn("eligible", F.col("object_id") % 7 != 0), V.object_verdicts(R(spark, sf, "headers")))


@query(
    "evt_08_resumed_worklist",
    "select object_id, cast(floor((r - 1) / 40) as int) + 1 as batch from (select object_id, row_number() over (order by object_id) as r from objects where last_verified_at is null or last_verified_at < timestamp '1997-01-01 00:00:00') x where r <= 160",
)
def evt_08(spark: SparkSession, sf: str) -> DataFrame:
    """A run of two batches, stopped, and gone on with from its stored cursor for two more."""
    cursor = _new_path(spark, "cursor")
    boundary = F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda: V.verify_run(R(spark, sf, "objects"), R(spark, sf, "slices"), boundary, None, cursor, 40, 2)
    return part().unionByName(part())
