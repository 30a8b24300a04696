"""Queries: faults and verification (AGG, FIL), placement (WIN), drift and replay (REP, AGG, SRT)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import drift as D
from ..operators import faults as X
from ..operators import placement as P
from ..operators import replay as L
from ..operators import verification as V
from .fixtures import relation as R
from .registry import CATEGORY, DOMAIN, ESTIMATE, FILL, FREE, WRITABLE, query

_KEY = "coalesce(cast(volume_id as string), 'unknown') || ':' || cast(object_id as string) || ':' || cast(slice_index as string)"
_COALESCED = f"""select {_KEY} as key, min(ts) as first_seen, max(ts) as last_seen, count(*) as n, arg_max(code, event_id) filter (where code is not null) as code,
  arg_max(message, event_id) filter (where message is not null) as message, arg_min(source, event_id) as source, arg_min(is_checksum, event_id) as is_checksum from observations group by 1"""


@query("agg_17_coalesced_faults", _COALESCED)
def agg_17(spark: SparkSession, sf: str) -> DataFrame:
    return X.coalesce_faults(R(spark, sf, "observations"))


@query(
    "agg_11_degraded_volumes",
    """select v.volume_id, coalesce(n, 0) as faults, (smart_exit & 172) <> 0 as smart_bad from volumes v left join (select volume_id, count(*) as n from observations group by volume_id) f on v.volume_id = f.volume_id
      where not deleted and not read_only and healthy and (coalesce(n, 0) >= 10 or (smart_exit & 172) <> 0)""",
)
def agg_11(spark: SparkSession, sf: str) -> DataFrame:
    return X.degraded_volumes(R(spark, sf, "observations"), R(spark, sf, "volumes"))


@query("agg_12_verify_errors", "select volume_id, count(*) as total, count(*) filter (where error_code in ('ECHECKSUM', 'EHDRSUM')) as checksum from slices where error_code is not null and error_code <> 'IOABORT' group by volume_id")
def agg_12(spark: SparkSession, sf: str) -> DataFrame:
    return X.verify_errors(R(spark, sf, "slices"))


_TRIAGED = f"""select object_id, case when good >= data_n then 'readable-now' when good + unavailable >= data_n then 'recoverable-remount' when good + unavailable + restamp >= data_n then 'recoverable-restamp' else 'lost' end as bucket, corrupt
  from (select object_id, count(*) filter (where slice_type = 'data') as data_n, count(*) filter (where c is null) as good, count(*) filter (where c = 'volume-unavailable') as unavailable,
    count(*) filter (where c = 'header-mismatch') as restamp, count(*) filter (where c not in ('volume-unavailable', 'header-mismatch')) as corrupt
    from (select *, case when error_code is not null and error_code <> 'IOABORT' then {CATEGORY} end as c from slices) s group by object_id) t"""


@query("agg_18_triage", f"select bucket, count(*) as objects, count(*) filter (where corrupt > 0 and bucket <> 'lost') as rebuilds from ({_TRIAGED}) t group by bucket")
def agg_18(spark: SparkSession, sf: str) -> DataFrame:
    return X.triaged(R(spark, sf, "slices")).groupBy("bucket").agg(F.count(F.lit(1)).alias("objects"), F.count_if("needs_rebuild").alias("rebuilds"))


@query("win_16_lost_by_container", f"select container_id, count(*) as n from ({_TRIAGED}) t join objects o on t.object_id = o.object_id where bucket = 'lost' group by container_id order by n desc, container_id limit 10")
def win_16(spark: SparkSession, sf: str) -> DataFrame:
    return X.lost_by_container(X.triaged(R(spark, sf, "slices")), R(spark, sf, "objects"))


@query(
    "agg_20_header_mismatches",
    "select count(*) as n, count(*) filter (where h_data_n <> data_n) as data_n_differs, count(*) filter (where h_parity_n <> parity_n) as parity_n_differs, count(*) filter (where h_chunk <> chunk_size) as chunk_differs from headers h join objects o on h.object_id = o.object_id where h.status = 'ok'",
)
def agg_20(spark: SparkSession, sf: str) -> DataFrame:
    return D.header_mismatches(R(spark, sf, "headers"), R(spark, sf, "objects").drop("status"))


_VERDICTS = """select object_id, case when unreadable > 0 then 'deferred' when ok < 4 then 'below-quorum' when corrupt > 0 then 'corrupt' when absent > 0 then 'degraded' else 'healthy' end as verdict
  from (select object_id, count(*) filter (where status = 'ok') as ok, count(*) filter (where status = 'unreadable') as unreadable, count(*) filter (where status = 'corrupt') as corrupt, count(*) filter (where status = 'absent') as absent from headers group by object_id) v"""


@query("rep_11_object_verdicts", _VERDICTS)
def rep_11(spark: SparkSession, sf: str) -> DataFrame:
    return V.object_verdicts(R(spark, sf, "headers")).select("object_id", "verdict")


@query("agg_22_verdict_rollup", f"select verdict, count(*) as n, string_agg(cast(object_id as string), ',' order by object_id) filter (where r <= 25) as sample from (select *, row_number() over (partition by verdict order by object_id) as r from ({_VERDICTS}) v) x group by verdict")
def agg_22(spark: SparkSession, sf: str) -> DataFrame:
    return V.verdict_rollup(V.object_verdicts(R(spark, sf, "headers")))


@query("agg_38_light_histogram", f"select coalesce(category, 'clean') as category, count(*) as slices, count(distinct object_id) as objects from (select object_id, case when error_code is not null then {CATEGORY} end as category from slices) s group by 1")
def agg_38(spark: SparkSession, sf: str) -> DataFrame:
    category = F.coalesce(F.when(F.col("error_code").isNotNull(), S.error_category(F.col("error_code"))), F.lit("clean"))
    return R(spark, sf, "slices").groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("slices"), F.count_distinct("object_id").alias("objects"))


@query(
    "agg_39_parity_states",
    """select state, count(*) as objects from (select object_id, case when bool_or(slice_type = 'parity' and error_code in ('EPARITY', 'ECHECKSUM')) then 'bad' when count(*) filter (where slice_type = 'data' and error_code is null) < 4 then 'data-incomplete'
        when count(*) filter (where slice_type = 'parity') < 2 then 'missing' else 'ok' end as state from slices group by object_id) x group by state""",
)
def agg_39(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.bool_or((F.col("slice_type") == "parity") & F.coalesce(F.col("error_code").isin("EPARITY", "ECHECKSUM"), F.lit(False)))
    state = F.when(bad, "bad").when(F.count_if((F.col("slice_type") == "data") & F.col("error_code").isNull()) < 4, "data-incomplete").when(F.count_if(F.col("slice_type") == "parity") < 2, "missing").otherwise("ok")
    return R(spark, sf, "slices").groupBy("object_id").agg(state.alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("objects"))


@query(
    "fil_18_repairable",
    f"""select key, case when status <> 'blocked' then true when reason in ('unrecoverable', 'reconstruction-mismatch') then false
        when reason = 'target-unwritable' then coalesce({WRITABLE} and not deleted, false) else epoch(now_at) - epoch(last_seen) >= 3600 end as eligible
      from (select key, last_seen, volume_id, max(last_seen) over () as now_at, case when n % 2 = 0 then 'blocked' else 'open' end as status, case n % 5 when 0 then 'unrecoverable' when 1 then 'target-unwritable' else 'busy' end as reason
        from (select {_KEY} as key, volume_id, max(ts) as last_seen, count(*) as n from observations group by 1, 2) f) g left join volumes v on g.volume_id = v.volume_id""",
)
def fil_18(spark: SparkSession, sf: str) -> DataFrame:
    o = R(spark, sf, "observations").withColumn("key", S.fault_key(F.col("volume_id"), F.col("object_id"), F.col("slice_index")))
    faults = o.groupBy("key", "volume_id").agg(F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"))
    now = faults.agg(F.max("last_seen").alias("now"))
    none = F.lit(None).cast("timestamp_ntz")
    states = faults.join(F.broadcast(now)).select(
        "key", "volume_id", "last_seen", "now", F.when(F.col("n") % 2 == 0, "blocked").otherwise("open").alias("status"), F.when(F.col("n") % 5 == 0, "unrecoverable").when(F.col("n") % 5 == 1, "target-unwritable").otherwise("busy").alias("reason"),
        none.alias("last_attempt"), none.alias("blocked_at"),
    )
    return X.repairable(states, R(spark, sf, "volumes")).select("key", "eligible")


@query(
    "joi_20_fault_disposition",
    f"""select disposition, count(*) as n from (select distinct {_KEY.replace('volume_id', 'f.volume_id').replace('object_id', 'f.object_id').replace('slice_index', 'f.slice_index')} as key,
        case when o.object_id is null then 'clear-missing' when s.object_id is null then 'clear-stale' else 'repair' end as disposition
      from (select distinct volume_id, object_id, slice_index from observations) f left join objects o on f.object_id = o.object_id
      left join (select distinct object_id, slice_index, volume_id from slices) s on f.object_id = s.object_id and f.slice_index = s.slice_index and f.volume_id = s.volume_id) x group by 1""",
)
def joi_20(spark: SparkSession, sf: str) -> DataFrame:
    faults = R(spark, sf, "observations").select("volume_id", "object_id", "slice_index").distinct()
    return X.fault_disposition(faults, R(spark, sf, "objects"), R(spark, sf, "slices")).groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


@query(
    "evt_06_escalations",
    """select event_id, coalesce(bool_or(code in ('ECHECKSUM', 'EHEADER', 'ENOENT', 'EUNAVAIL')) over w, false) or count(*) over w >= 2 as is_dead from observations
      window w as (partition by object_id, slice_index order by event_id rows between unbounded preceding and current row)""",
)
def evt_06(spark: SparkSession, sf: str) -> DataFrame:
    reads = R(spark, sf, "observations").select("event_id", "object_id", F.col("event_id").alias("seq"), "slice_index", F.coalesce("code", F.lit("")).alias("code"))
    return X.escalations(reads).select("event_id", "is_dead")


# Placement

_TURNS = f"select volume_id, device_group, {FREE} as free, row_number() over (partition by device_group order by {FREE} desc, volume_id) as turn from volumes where {WRITABLE} and not deleted"


@query("win_01_round_robin", f"select volume_id, device_group, free, cast(turn as int) as turn, cast(row_number() over (order by turn, device_group nulls last, volume_id) as int) as place from ({_TURNS}) t")
def win_01(spark: SparkSession, sf: str) -> DataFrame:
    return P.round_robin(R(spark, sf, "volumes"))


@query("win_02_by_free", f"select volume_id, {FREE} as free from volumes where {WRITABLE} and not deleted")
def win_02(spark: SparkSession, sf: str) -> DataFrame:
    return P.by_free(R(spark, sf, "volumes"))


@query(
    "win_03_plan",
    f"""select volume_id, cast(row_number() over (order by md5('plan:' || cast(volume_id as string)), volume_id) - 1 as int) as slice_index,
        case when row_number() over (order by md5('plan:' || cast(volume_id as string)), volume_id) <= 4 then 'data' else 'parity' end as slice_type
      from (select *, row_number() over (order by turn, device_group nulls last, volume_id) as place from ({_TURNS}) t) p where place <= 6""",
)
def win_03(spark: SparkSession, sf: str) -> DataFrame:
    return P.plan(R(spark, sf, "volumes"), 4, 2, "plan")


@query(
    "win_04_drain_targets",
    f"""select object_id, slice_index, target, load, need from (select *, row_number() over (partition by object_id, slice_index order by load, free desc, target) as r from (
        select m.object_id, m.slice_index, t.volume_id as target, t.free, m.need, (select count(*) from slices x join volumes xv on x.volume_id = xv.volume_id where x.object_id = m.object_id and x.volume_id <> 11 and {DOMAIN.replace('volume_id', 'xv.volume_id').replace('device_group', 'xv.device_group')} = t.domain) as load
        from (select s.object_id, s.slice_index, {ESTIMATE} as need from slices s join objects o on s.object_id = o.object_id where s.volume_id = 11) m
        join (select volume_id, {FREE} as free, {DOMAIN} as domain from volumes where {WRITABLE} and not deleted and volume_id <> 11) t on t.free >= m.need
        where not exists (select 1 from slices h where h.object_id = m.object_id and h.volume_id = t.volume_id)) c) r where r = 1""",
)
def win_04(spark: SparkSession, sf: str) -> DataFrame:
    return P.drain_targets(R(spark, sf, "slices"), R(spark, sf, "volumes"), R(spark, sf, "objects"), 11)


_TARGET = f"(select cast(sum(bytes_total - {FREE}) as double) / cast(sum(bytes_total) as double) as t from volumes where not deleted)"


@query("win_06_sources", f"select volume_id, round({FILL}, 9) as fill, cast(floor(({FILL} - t) * bytes_total) as bigint) as excess from volumes, {_TARGET} p where not deleted and {FILL} > t + 0.02")
def win_06(spark: SparkSession, sf: str) -> DataFrame:
    return P.rebalance_sources(R(spark, sf, "volumes"))


@query("win_05_targets", f"select volume_id, round({FILL}, 9) as fill, cast(row_number() over (order by {FILL}, volume_id) as int) as place from volumes, {_TARGET} p where {WRITABLE} and not deleted and verify_errors = 0 and {FILL} < t - 0.02")
def win_05(spark: SparkSession, sf: str) -> DataFrame:
    return P.rebalance_targets(R(spark, sf, "volumes"))


@query(
    "win_07_shed_by_tier",
    f"""select volume_id, object_id, slice_index, tier, bytes, cast(shed_before as bigint) as shed_before from (select s.volume_id, s.object_id, s.slice_index, tier, bytes, excess,
        coalesce(sum(bytes) over (partition by s.volume_id order by tier, s.object_id, s.slice_index rows between unbounded preceding and 1 preceding), 0) as shed_before
      from slices s join (select volume_id, cast(floor(({FILL} - t) * bytes_total / 100) as bigint) as excess from volumes, {_TARGET} p where not deleted and {FILL} > t + 0.02) v on s.volume_id = v.volume_id
      join (select object_id, case when coalesce(size, 0) >= 268435456 then 0 when coalesce(size, 0) >= 16777216 then 1 when coalesce(size, 0) >= 1048576 then 2 else 3 end as tier, {ESTIMATE} as bytes from objects) o on s.object_id = o.object_id) x
      where shed_before < excess""",
)
def win_07(spark: SparkSession, sf: str) -> DataFrame:
    live = P.rebalance_sources(R(spark, sf, "volumes")).drop("excess")
    volumes = R(spark, sf, "volumes").filter(~F.col("deleted"))
    target = volumes.agg((F.sum(F.col("bytes_total") - (F.coalesce("bytes_free", F.lit(0)) - F.col("bytes_pending"))).cast("double") / F.sum("bytes_total").cast("double")).alias("t"))
    own = S.fill(F.col("bytes_total"), F.col("bytes_free"), F.col("bytes_pending"))
    excess = volumes.join(F.broadcast(target)).select("volume_id", F.floor((own - F.col("t")) * F.col("bytes_total") / 100).cast("bigint").alias("excess")).join(live.select("volume_id"), "volume_id")
    return P.shed(R(spark, sf, "slices"), R(spark, sf, "objects"), excess)


@query(
    "win_08_replica_election",
    f"""select volume_id, domain, cast(place as int) as place from (select *, row_number() over (order by case when g > 1 then 1 else 0 end, fresh, volume_id) as place from (
        select *, row_number() over (partition by domain order by fresh, volume_id) as g from (select volume_id, {DOMAIN} as domain, case when volume_id in (2, 4, 9) then 0 else 1 end as fresh from volumes where {WRITABLE} and not deleted) a) b) c where place <= 5""",
)
def win_08(spark: SparkSession, sf: str) -> DataFrame:
    return P.replica_election(R(spark, sf, "volumes"), [2, 4, 9], 5)


@query("win_09_latest", "select event_id, ts from observations order by ts desc, event_id desc limit 50")
def win_09(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "observations").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "ts")


@query("win_13_keep_recent", "select user_id, max(ts) as ts from {events} group by user_id order by ts desc, user_id limit 20")
def win_13(spark: SparkSession, sf: str) -> DataFrame:
    return P.keep_recent(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "ts", 20)


@query("win_14_15_next_volume", f"select min(case when {WRITABLE} and volume_id not in (1, 2) then volume_id end) as next_to_drain, max(volume_id) + 1 as next_id from volumes")
def win_14(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "volumes").agg(F.min(F.when(S.writable() & ~F.col("volume_id").isin(1, 2), F.col("volume_id"))).alias("next_to_drain"), (F.max("volume_id") + 1).alias("next_id"))


# Drift


@query("joi_06_phantoms", "select object_id from objects o where not exists (select 1 from slices s where s.object_id = o.object_id)")
def joi_06(spark: SparkSession, sf: str) -> DataFrame:
    return D.phantoms(R(spark, sf, "objects"), R(spark, sf, "slices")).select("object_id")


@query("joi_07_orphans", "select distinct object_id from slices where object_id not in (select object_id from objects where status <> 'P')")
def joi_07(spark: SparkSession, sf: str) -> DataFrame:
    return D.orphans(R(spark, sf, "objects").filter("status <> 'P'"), R(spark, sf, "slices"))


_VOTES = """select object_id, h_size, h_data_n, h_parity_n, h_chunk, volumes, slices, winners from (select *, count(*) over (partition by object_id) as winners from (
    select *, rank() over (partition by object_id order by volumes desc, slices desc) as r from (select object_id, h_size, h_data_n, h_parity_n, h_chunk, count(distinct volume_id) as volumes, count(distinct slice_index) as slices
      from headers where status = 'ok' group by 1, 2, 3, 4, 5) a) b where r = 1) c"""


@query("agg_25_geometry_votes", f"select distinct object_id, case when winners = 1 then h_size end as h_size, case when winners = 1 then h_chunk end as h_chunk, volumes, slices, winners, winners = 1 and volumes > 1 as corroborated from ({_VOTES}) v")
def agg_25(spark: SparkSession, sf: str) -> DataFrame:
    return D.geometry_votes(R(spark, sf, "headers")).select("object_id", "h_size", "h_chunk", "volumes", "slices", "winners", "corroborated")


_QUORUM = f"""select u.object_id, case when winners is null then case when unknown > 0 then 'indeterminate' else 'below-quorum' end when winners > 1 then 'indeterminate'
    when slices >= h_data_n then case when volumes > 1 then 'ok' else 'uncorroborated' end when slices + unknown >= h_data_n then 'indeterminate' else 'below-quorum' end as verdict, coalesce(slices, 0) as agreeing, cast(unknown as bigint) as unknown
  from (select object_id, count(distinct case when status = 'unreadable' then slice_index end) as unknown from headers group by object_id) u
  left join (select object_id, max(winners) as winners, max(h_data_n) as h_data_n, max(volumes) as volumes, max(slices) as slices from ({_VOTES}) v group by object_id) w on u.object_id = w.object_id"""


@query("agg_26_quorum", _QUORUM)
def agg_26(spark: SparkSession, sf: str) -> DataFrame:
    return D.quorum(R(spark, sf, "headers"))


@query(
    "rep_09_drift_report",
    f"""select class, count(*) as n, min(id) as first_id, max(id) as last_id from (select coalesce(q.object_id, o.object_id) as id, case when q.object_id is null then 'phantom' when o.object_id is null then 'orphan-' || verdict else verdict end as class
      from ({_QUORUM}) q full outer join (select object_id from objects where status <> 'P') o on q.object_id = o.object_id) x group by class""",
)
def rep_09(spark: SparkSession, sf: str) -> DataFrame:
    return D.drift_report(R(spark, sf, "objects").filter("status <> 'P'"), R(spark, sf, "headers"))


@query(
    "rep_07_synthesis",
    f"""select w.object_id, cast(i as int) as slice_index, volume_id from (select * from ({_VOTES}) v where winners = 1) w cross join (select unnest(generate_series(0, 5)) as i) n
      left join (select h.object_id, h.slice_index, h.volume_id, row_number() over (partition by h.object_id, h.slice_index order by case when h.h_size = v.h_size and h.h_chunk = v.h_chunk then 0 else 1 end, h.volume_id) as r
        from headers h join (select * from ({_VOTES}) v where winners = 1) v on h.object_id = v.object_id where h.status = 'ok') c on w.object_id = c.object_id and n.i = c.slice_index and c.r = 1 where i < h_data_n + h_parity_n""",
)
def rep_07(spark: SparkSession, sf: str) -> DataFrame:
    return D.synthesise(R(spark, sf, "headers"))


@query(
    "joi_05_stale_references",
    "select d.object_id, case when o.object_id is null then 'orphan' when s.object_id is not null then 'referenced' else 'stale' end as verdict from (select object_id from slices group by object_id) d left join (select object_id from objects where status <> 'P') o on d.object_id = o.object_id left join (select distinct object_id from slices where volume_id = 17) s on d.object_id = s.object_id",
)
def joi_05(spark: SparkSession, sf: str) -> DataFrame:
    on_disk = R(spark, sf, "slices").select("object_id").distinct()
    return D.stale_references(on_disk, R(spark, sf, "objects").filter("status <> 'P'"), R(spark, sf, "slices"), 17)


@query(
    "upd_08_quarantine_guard",
    "select n as named, k as orphaned, n >= 1000 and k <= n * 0.01 as allowed from (select count(*) as n from objects where status <> 'P') a, (select count(distinct object_id) as k from slices where object_id not in (select object_id from objects where status <> 'P')) b",
)
def upd_08(spark: SparkSession, sf: str) -> DataFrame:
    return D.quarantine_guard(R(spark, sf, "objects").filter("status <> 'P'"), R(spark, sf, "slices"), 1000, 0.01)


@query("agg_36_removable_volumes", "select v.volume_id, count(s.object_id) as refs, count(s.object_id) = 0 as removable from volumes v left join slices s on v.volume_id = s.volume_id group by v.volume_id")
def agg_36(spark: SparkSession, sf: str) -> DataFrame:
    refs = R(spark, sf, "slices").groupBy("volume_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return R(spark, sf, "volumes").join(refs, "volume_id", "left").select("volume_id", n.alias("refs"), (n == 0).alias("removable"))


# Replay

_STATE = """select id, kind, name, cid, case when kind = 'put' then size end as size, last = 'del' as parked from (
    select id, arg_max(op, line) filter (where op <> 'policy') as last, arg_max(op, line) filter (where op in ('put', 'container')) as kind, arg_max(name, line) filter (where op in ('put', 'container')) as name,
      arg_max(cid, line) filter (where op in ('put', 'container')) as cid, arg_max(size, line) filter (where op in ('put', 'container')) as size from oplog group by id) s
  where kind is not null and not (last = 'del' and kind = 'container')"""


@query("rep_01_replay", _STATE)
def rep_01(spark: SparkSession, sf: str) -> DataFrame:
    return L.replay(R(spark, sf, "oplog"))


@query(
    "rep_02_policy_fold",
    """with recursive chain as (select id, n, pr, pw, dp, row_number() over (partition by id order by line) as k from (select id, line, pr, pw, dp, 0 as n from oplog where op = 'policy') p),
      walk as (select distinct id, cast(0 as bigint) as k, id % 2 = 0 as fr, id % 3 = 0 as fw, id % 5 = 0 as fd, cast(0 as bigint) as refused from oplog
        union all select w.id, c.k, w.fr and c.pr, w.fw and c.pw, w.fd or c.dp,
          w.refused + case when c.pr and not w.fr then 1 else 0 end + case when c.pw and not w.fw then 1 else 0 end + case when not c.dp and w.fd then 1 else 0 end from walk w join chain c on w.id = c.id and c.k = w.k + 1)
      select id, fr as pr, fw as pw, fd as dp, refused from (select *, row_number() over (partition by id order by k desc) as r from walk) x where r = 1""",
)
def rep_02(spark: SparkSession, sf: str) -> DataFrame:
    log = R(spark, sf, "oplog")
    initial = log.select("id").distinct().select("id", (F.col("id") % 2 == 0).alias("pr"), (F.col("id") % 3 == 0).alias("pw"), (F.col("id") % 5 == 0).alias("dp"))
    return L.fold_policy(log, initial).withColumn("refused", F.col("refused").cast("bigint"))


@query(
    "rep_03_04_fates",
    f"""select fate, count(*) as n from (select case when s.object_id is not null then 'restored' when parked then 'deleted' when x.id % 3 = 0 then 'missing' else 'dropped' end as fate
      from ({_STATE}) x left join (select distinct object_id from slices where object_id % 2 = 0) s on x.id = s.object_id where kind = 'put') f group by fate""",
)
def rep_03(spark: SparkSession, sf: str) -> DataFrame:
    names = L.replay(R(spark, sf, "oplog"))
    return L.keep_with_slices(names, R(spark, sf, "slices").filter("object_id % 2 = 0"), names.filter("id % 3 = 0")).groupBy("fate").agg(F.count(F.lit(1)).alias("n"))


@query("agg_23_dangling", f"select x.id, x.cid from ({_STATE}) x where cid is not null and cid not in (select id from ({_STATE}) y where kind = 'container')")
def agg_23(spark: SparkSession, sf: str) -> DataFrame:
    return L.dangling(L.replay(R(spark, sf, "oplog"))).select("id", "cid")


@query("fil_19_coherent_records", "select op, count(*) as n, count(*) filter (where case when line % 10 = 0 then false when op = 'put' then size >= 0 else true end) as coherent from oplog group by op")
def fil_19(spark: SparkSession, sf: str) -> DataFrame:
    log = R(spark, sf, "oplog").withColumn("id", F.when(F.col("line") % 10 != 0, F.col("id")))
    return L.coherent(log).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.count_if("coherent").alias("coherent"))


_MANIFESTS = """select volume_id as device, case when volume_id % 4 = 0 then null when volume_id % 3 = 0 then 'other' else 'this' end as identity, volume_id % 2 = 0 as usable,
  case when volume_id % 5 = 0 then null else timestamp '2024-01-01 00:00:00' + to_days(cast(volume_id % 50 as int)) end as completed_at, timestamp '2024-02-01 00:00:00' + to_days(cast(volume_id % 40 as int)) as updated_at from volumes"""


def _manifests(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("volume_id")
    day = lambda start, n: F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(n.cast("int"))
    return R(spark, sf, "volumes").select(
        v.alias("device"), F.when(v % 4 == 0, None).when(v % 3 == 0, "other").otherwise("this").alias("identity"), (v % 2 == 0).alias("usable"),
        F.when(v % 5 != 0, day("2024-01-01 00:00:00", v % 50)).alias("completed_at"), day("2024-02-01 00:00:00", v % 40).alias("updated_at"),
    )


@query("agg_24_manifest_vote", f"select identity, count(*) as votes, 2 * count(*) > (select count(*) from volumes) as majority from ({_MANIFESTS}) m where identity is not null group by identity")
def agg_24(spark: SparkSession, sf: str) -> DataFrame:
    return L.manifest_vote(_manifests(spark, sf))


@query("agg_27_best_manifest", f"select device from ({_MANIFESTS}) m order by usable desc, coalesce(case when usable then completed_at end, updated_at) desc, device desc limit 1")
def agg_27(spark: SparkSession, sf: str) -> DataFrame:
    return L.best_manifest(_manifests(spark, sf))


@query("srt_07_bounded_sample", "select count(*) as n, string_agg(case when r <= 20 then cast(object_id as string) end, ',' order by object_id) as sample from (select object_id, row_number() over (order by object_id) as r from objects o where not exists (select 1 from slices s where s.object_id = o.object_id)) x")
def srt_07(spark: SparkSession, sf: str) -> DataFrame:
    found = D.phantoms(R(spark, sf, "objects"), R(spark, sf, "slices")).select("object_id")
    few = found.orderBy("object_id").limit(20).agg(F.array_join(F.array_sort(F.collect_list("object_id")), ",").alias("sample"))
    return found.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(few))


@query("win_11_last_per_volume", "select volume_id, max(event_id) as event_id, arg_max(code, event_id) as code from observations where volume_id is not null and code is not null group by volume_id")
def win_11(spark: SparkSession, sf: str) -> DataFrame:
    o = R(spark, sf, "observations").filter("volume_id IS NOT NULL AND code IS NOT NULL")
    last = F.row_number().over(Window.partitionBy("volume_id").orderBy(F.desc("event_id")))
    return o.withColumn("_r", last).filter("_r = 1").select("volume_id", "event_id", "code")
