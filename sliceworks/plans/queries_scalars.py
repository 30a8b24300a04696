"""Queries: scalar functions (SCA) and binary sources (SRC) over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import erasure
from ..functions import scalars as S
from ..sources import tables as T
from .fixtures import driver_table
from .fixtures import relation as R
from .registry import ESTIMATE, FILL, FREE, query


@query("sca_02_estimates", f"select object_id, {ESTIMATE} as bytes from objects")
def sca_02(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "objects").select("object_id", S.slice_estimate(F.col("size"), F.col("data_n")).alias("bytes"))


_GEO = """select object_id, size, start_chunk, offs, cnt, end_off, cast(floor((ceil(cast(size - end_off as double) / 4) + 7) / 8) * 8 as bigint) as end_chunk from (
    select *, offs + cnt * 16368 * 4 as end_off from (select *, cast(floor(ceil(cast(greatest(0, size - offs) as double) / 4) / 16368) as bigint) as cnt from (
      select *, start_chunk * 4 as offs from (select object_id, size, cast(floor((greatest(1, least(16320, cast(floor(size / 4.0::double) as bigint))) + 7) / 8.0::double) * 8 as bigint) as start_chunk from objects where size is not null) a) b) c) d"""


@query("sca_03_geometry", f"select object_id, start_chunk, offs as standard_offset, cnt as standard_count, end_off as end_offset, end_chunk from ({_GEO}) g")
def sca_03(spark: SparkSession, sf: str) -> DataFrame:
    g = S.geometry(F.col("size"), F.lit(16384).cast("bigint"), F.lit(4).cast("bigint"))
    return R(spark, sf, "objects").filter("size IS NOT NULL").select("object_id", g.alias("g")).select("object_id", "g.start_chunk", "g.standard_offset", "g.standard_count", "g.end_offset", "g.end_chunk")


@query(
    "sca_04_05_06_offsets",
    f"""select object_id, cast(case when off < offs then 0 else 1 + floor((off - offs) / (16368 * 4.0::double)) end as bigint) as chunk, cast(48 + 16 + start_chunk + 16384 as bigint) as third_start, off < offs + 1000 and off + 500 > offs as touches
      from (select *, cast(object_id * 977 % size as bigint) as off from ({_GEO}) g where size > 0) x""",
)
def sca_04(spark: SparkSession, sf: str) -> DataFrame:
    o = R(spark, sf, "objects").filter("size > 0")
    g = o.select("object_id", (F.col("object_id") * 977 % F.col("size")).alias("off"), S.geometry(F.col("size"), F.lit(16384).cast("bigint"), F.lit(4).cast("bigint")).alias("g"))
    chunk = S.chunk_of_offset(F.col("off"), F.col("g.standard_offset"), F.col("g.standard_chunk"), F.lit(4))
    touches = S.overlaps(F.col("off"), F.col("off") + 500, F.col("g.standard_offset"), F.col("g.standard_offset") + 1000)
    return g.select("object_id", chunk.alias("chunk"), S.chunk_start(F.lit(2), F.lit(16384), F.col("g.start_chunk")).alias("third_start"), touches.alias("touches"))


@query("sca_07_fill", f"select volume_id, round({FILL}, 9) as fill from volumes")
def sca_07(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "volumes").select("volume_id", F.round(S.fill(F.col("bytes_total"), F.col("bytes_free"), F.col("bytes_pending")), 9).alias("fill"))


@query("sca_08_45_progress", "select volume_id, round(case when bytes_data + bytes_parity > 0 then cast(bytes_data as double) / (bytes_data + bytes_parity) else 1 end, 9) as progress, case when f >= 0.9 then 'critical' when f >= 0.7 then 'warn' else 'ok' end as band from (select *, greatest(0.0::double, least(1.0::double, cast(bytes_data + bytes_parity as double) / bytes_total)) as f from volumes) v")
def sca_08(spark: SparkSession, sf: str) -> DataFrame:
    used = S.used_fraction(F.col("bytes_data") + F.col("bytes_parity"), F.col("bytes_total"))
    return R(spark, sf, "volumes").select("volume_id", F.round(S.progress(F.col("bytes_data"), F.col("bytes_parity")), 9).alias("progress"), S.fullness(used).alias("band"))


@query(
    "sca_09_categories",
    """select event_id, case when k = 0 then 'checksum' when k = 1 then 'header-mismatch' when k = 2 then 'volume-unavailable' when k = 3 then 'missing' when k = 4 then 'timeout' when k = 5 then 'io' when k = 6 then 'unknown' else 'parity-mismatch' end as category from (select event_id, event_id % 8 as k from {events}) e""",
)
def sca_09(spark: SparkSession, sf: str) -> DataFrame:
    texts = ["Bad CHECKSUM here", "Header field mismatch", "volume is not mounted", "ENOENT: no such file", "read timed out", "short read", "who knows", "header checksum"]
    message = F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 8 + 1).cast("int"))
    return driver_table(spark, sf, "events").select("event_id", S.error_category(F.when(F.col("event_id") % 8 == 7, "EPARITY").otherwise("EWHAT"), message).alias("category"))


@query("sca_12_fault_keys", "select event_id, coalesce(cast(volume_id as string), 'unknown') || ':' || cast(object_id as string) || ':' || cast(slice_index as string) as key from observations")
def sca_12(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "observations").select("event_id", S.fault_key(F.col("volume_id"), F.col("object_id"), F.col("slice_index")).alias("key"))


@query("sca_13_id_times", "select object_id, epoch_ms(((case when s >= 2147483648 then s - 4294967296 else s end) * 1000)::bigint) as created from (select object_id, ('0x' || substr(md5(cast(object_id as string)), 1, 8))::bigint as s from objects) x")
def sca_13(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "objects").select("object_id", S.id_time(S.make_id(F.col("object_id"))).cast("timestamp_ntz").alias("created"))


@query("sca_15_16_slice_files", "select object_id, h as parsed_id, cast(slice_index as int) as parsed_index, cast(null as string) as wrong from (select object_id, slice_index, substr(md5(cast(object_id as string)), 1, 24) as h from slices) x")
def sca_15(spark: SparkSession, sf: str) -> DataFrame:
    path = S.shard_path(S.make_id(F.col("object_id")), F.col("slice_index"))
    parsed = R(spark, sf, "slices").select("object_id", S.slice_file(F.element_at(F.split(path, "/"), -1)).alias("f"), S.slice_file(F.concat(F.lit("x"), path))["object_id"].alias("wrong"))
    return parsed.select("object_id", F.col("f.object_id").alias("parsed_id"), F.col("f.slice_index").alias("parsed_index"), "wrong")


@query("sca_17_46_paths", "select page_id, cast(len(list_filter(string_split(url, '/'), lambda x: x <> '')) as int) as parts, list_filter(string_split(url, '/'), lambda x: x <> '')[-1] as last from {pages}")
def sca_17(spark: SparkSession, sf: str) -> DataFrame:
    return driver_table(spark, sf, "pages").select("page_id", F.size(S.path_prefixes(F.col("url"))).alias("parts"), F.element_at(S.path_parts(F.col("url")), -1).alias("last"))


@query("sca_18_bucket_refs", "select event_id, case when url like '/$%' then 'id' when url = '/' then 'none' else 'path' end as form, case when url like '/bucket%' then split_part(ltrim(url, '/'), '/', 1) end as bucket from requests")
def sca_18(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "requests").select("event_id", S.bucket_ref(F.col("url")).alias("r")).select("event_id", "r.form", "r.bucket")


@query("sca_19_ranges", "select event_id, case when event_id % 3 <> 2 and event_id % 700 < 500 then event_id % 700 end as s, case when event_id % 3 <> 2 and event_id % 700 < 500 then case when event_id % 3 = 0 then least(event_id % 700 + 51, 500) else 500 end end as e from {events}")
def sca_19(spark: SparkSession, sf: str) -> DataFrame:
    start = (F.col("event_id") % 700).cast("string")
    header = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("bytes="), start, F.lit("-"), (F.col("event_id") % 700 + 50).cast("string"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("bytes="), start, F.lit("-"))).otherwise(F.concat(F.lit("bytes=-"), start))
    return driver_table(spark, sf, "events").select("event_id", S.byte_range(header, F.lit(500).cast("bigint")).alias("r")).select("event_id", F.col("r.start").alias("s"), F.col("r.end").alias("e"))


@query("sca_23_chunk_sums", "select id, k, md5(substr(t, k * 100 + 1, 100)) as md5 from (select doc_id as id, regexp_replace(text, '[^ -~]', '', 'g') as t from {documents}) d, (select unnest(generate_series(0, 400)) as k) g where k * 100 < length(t)")
def sca_23(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of 100 bytes; the texts are reduced to ASCII, where bytes and characters are one."""
    bodies = driver_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", "[^ -~]", "").cast("binary").alias("body"))
    return T.chunks(bodies, 100).select("id", F.col("k").cast("bigint").alias("k"), "md5")


@query("sca_24_whole_sums", "select doc_id, md5(text) as md5 from {documents}")
def sca_24(spark: SparkSession, sf: str) -> DataFrame:
    """Whole sums from chunks put together again. Each row is a body of its own, as ids may repeat; an empty one has no chunks and the sum of nothing, one without text has null."""
    rows = driver_table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("body"))
    bodies = rows.select(F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("id"), "body")
    joined = T.read_range(T.chunks(bodies, 4096), 4096, 0, 1 << 30)
    unchunked = rows.filter("body IS NULL OR length(body) = 0").select("doc_id", F.md5("body").alias("md5"))
    return joined.select("id.doc_id", F.md5(F.unhex("hex")).alias("md5")).unionByName(unchunked)


@query("sca_25_record_sums", "select conv_id, turn, sha256(role || ':' || text) as sha from {conversations}")
def sca_25(spark: SparkSession, sf: str) -> DataFrame:
    return driver_table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(F.concat_ws(":", "role", "text").cast("binary"), 256).alias("sha"))


@query("src_23_read_range", "select doc_id as id, md5(substr(t, 151, 500)) as md5 from (select doc_id, regexp_replace(text, '[^ -~]', '', 'g') as t from {documents}) d where length(t) > 150")
def src_23(spark: SparkSession, sf: str) -> DataFrame:
    bodies = driver_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", "[^ -~]", "").cast("binary").alias("body"))
    return T.read_range(T.chunks(bodies, 100), 100, 150, 650).select("id", F.md5(F.unhex("hex")).alias("md5")).join(bodies.filter(F.length("body") > 150).select("id"), "id")


@query(
    "src_08_headers",
    """select object_id, slice_index, case when status <> 'absent' then substr(md5(cast(object_id as string)), 1, 24) end as header_id, case status when 'absent' then null when 'corrupt' then h_size + 1 else h_size end as size,
      case when status <> 'absent' then cast(h_data_n as bigint) end as data_n, case when status <> 'absent' then cast(h_parity_n as bigint) end as parity_n, case when status <> 'absent' then cast(h_chunk as bigint) end as chunk,
      case status when 'absent' then null when 'corrupt' then false else true end as sum_ok from headers""",
)
def src_08(spark: SparkSession, sf: str) -> DataFrame:
    """Every slice's header packed by expressions, then decoded by the reader's; corrupt ones got another size after they were summed, absent ones end after 20 bytes."""
    le = lambda c, width: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(c.cast("bigint"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(width)]))
    body = lambda size: F.concat(F.unhex(S.make_id(F.col("object_id"))), le(size, 5), le(F.col("h_data_n"), 1), le(F.col("h_parity_n"), 1), le(F.col("h_chunk"), 3), le(F.col("slice_index"), 1), F.unhex(F.lit("000000")))
    corrupt = F.col("status") == "corrupt"
    raw = F.concat(F.lit("SLICE01").cast("binary"), F.unhex(F.md5(body(F.col("h_size")))), body(F.col("h_size") + corrupt.cast("bigint")))
    header = T.decode_header(F.when(F.col("status") == "absent", F.substring(raw, 1, 20)).otherwise(raw))
    whole = lambda name: F.when(F.col("h.long_enough"), F.col(f"h.{name}"))
    decoded = R(spark, sf, "headers").select("object_id", "slice_index", header.alias("h"))
    numbers = [whole(c).cast("bigint").alias(c) for c in ("size", "data_n", "parity_n", "chunk")]
    return decoded.select("object_id", "slice_index", whole("object_id").alias("header_id"), *numbers, "h.sum_ok")


@query("src_13_longest_copies", "select segment, cast(arg_max(replica, len) as int) as replica, cast(max(len) as int) as length, true as consistent from (select cast(conv_id as varchar) || '-' || cast(turn as varchar) as segment, r as replica, length(regexp_replace(text, '[^ -~]', '', 'g')) // r as len from {conversations}, (select unnest([1, 2, 3]) as r) g) x group by segment")
def src_13(spark: SparkSession, sf: str) -> DataFrame:
    text = F.regexp_replace("text", "[^ -~]", "")
    copies = driver_table(spark, sf, "conversations").withColumn("replica", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    cut = copies.select(F.concat_ws("-", "conv_id", "turn").alias("segment"), "replica", F.left(text, F.floor(F.length(text) / F.col("replica")).cast("int")).alias("body"))
    return T.longest_copies(cut)


@query("src_14_missing_segments", "select cast(i as bigint) as segment from (select unnest(generate_series(0, (select max(event_id) from {events} where event_id % 7 <> 0))) as i) g where i not in (select event_id from {events} where event_id % 7 <> 0)")
def src_14(spark: SparkSession, sf: str) -> DataFrame:
    return T.missing_segments(driver_table(spark, sf, "events").filter("event_id % 7 <> 0").select(F.col("event_id").alias("segment")))


@query("sca_26_27_erasure")
def sca_26(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's bytes in four slices, encoded with two of parity, two slices lost, decoded: whether all came back."""
    raw = F.col("text").cast("binary")
    width = F.greatest(F.lit(1), F.ceil(F.length(raw) / 4)).cast("int")
    parts = F.array(*[F.rpad(F.substring(raw, F.lit(1) + width * i, width), width, F.lit(b"\x00")) for i in range(4)])
    coded = erasure.with_parity(driver_table(spark, sf, "documents").select(F.col("doc_id").alias("object_id"), parts.alias("data")), 2)
    left = F.map_from_arrays(F.array(F.lit(0), F.lit(2), F.lit(4), F.lit(5)), F.array(F.col("data")[0], F.col("data")[2], F.col("parity")[0], F.col("parity")[1]))
    back = erasure.repaired(coded.select("object_id", left.alias("slices")), 4, 2)
    return coded.alias("c").join(back.alias("b"), "object_id").select("object_id", (F.col("c.data") == F.col("b.data")).alias("recovered"))


@query("sca_28_hex_sums", "select object_id, md5(name) as md5 from objects")
def sca_28(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "objects").select("object_id", S.hex_md5(F.unhex(F.md5(F.col("name").cast("binary")))).alias("md5"))


@query("sca_29_smart_flags", "select volume_id, (smart_exit & 172) <> 0 as bad, cast(bit_count(smart_exit & 252) as int) as messages from volumes")
def sca_29(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "volumes").select("volume_id", S.smart_unhealthy(F.col("smart_exit")).alias("bad"), F.size(S.smart_messages(F.col("smart_exit"))).alias("messages"))


@query(
    "sca_31_format_bytes",
    "select object_id, case when s >= 1073741824 then printf('%.2f', s / 1073741824.0::double) || ' GB' when s >= 1048576 then printf('%.2f', s / 1048576.0::double) || ' MB' when s >= 1024 then printf('%.2f', s / 1024.0::double) || ' KB' else cast(s as string) || ' b' end as text from (select object_id, coalesce(size, 0) as s from objects) o",
)
def sca_31(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "objects").select("object_id", S.format_bytes(F.coalesce("size", F.lit(0))).alias("text"))


@query("sca_32_disks", "select event_id, case when event_id % 3 = 0 then 'sd' || chr(cast(97 + user_id % 26 as int)) when event_id % 3 = 1 then 'nvme0n' || cast(user_id % 4 as string) end as disk from {events}")
def sca_32(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    device = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("sd"), F.chr((97 + u % 26).cast("int")), F.lit("1"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("nvme0n"), (u % 4).cast("string"), F.lit("p2"))).otherwise("dm-3")
    return driver_table(spark, sf, "events").select("event_id", S.parent_disk(device).alias("disk"))


@query(
    "sca_33_log_signals",
    """select event_id, case k when 6 then 'dm-7' else 'sd' || l || case when k in (1, 3, 5) then '1' else '' end end as device, case k when 0 then 'pending' else 'ioerror' end as kind,
        case k when 0 then cast(event_id % 90 as string) || ' pending sector(s)' when 1 then 'medium error' when 2 then 'device not ready' when 3 then 'ext4: group 12 has a bad bitmap' when 5 then 'jbd2: cannot commit' else 'ext4: delayed write failed' end as detail,
        case k when 0 then cast(event_id % 90 as int) end as count from (select event_id, event_id % 8 as k, substr('abcdef', cast(1 + user_id % 6 as int), 1) as l from {events}) e where k not in (4, 7)""",
)
def sca_33(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "log_lines").select("event_id", F.explode(S.log_signals(F.col("line"))).alias("s")).select("event_id", "s.device", "s.kind", "s.detail", "s.count")


@query("sca_34_severities", "select event_id, cast(event_id % 4 as int) as rank from {events} where event_id % 4 < 3")
def sca_34(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, (*S.SEVERITIES, "other"))), (F.col("event_id") % 4 + 1).cast("int"))
    return driver_table(spark, sf, "events").select("event_id", S.severity_rank(name).alias("rank")).filter("rank >= 0")


@query("sca_35_clamped", "select event_id, case when event_id % 5 = 0 then 3 else cast(greatest(1, least(64, event_id % 100)) as int) end as n from {events}")
def sca_35(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("event_id") % 5 == 0, "many").otherwise((F.col("event_id") % 100).cast("string"))
    return driver_table(spark, sf, "events").select("event_id", S.clamp(text, 3, 1, 64).alias("n"))


@query("sca_36_37_38_headers", "select p_partkey, p_partkey % 4 in (0, 1) as inline, replace(p_name, ' ', '') as filename, 'u' || cast(p_partkey as string) as username from {part}")
def sca_36(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    mime = F.when(k % 4 == 0, "IMAGE/png; q=1").when(k % 4 == 1, "video/x").when(k % 4 == 2, "image/svg+xml")
    name = F.concat(F.lit('"'), F.regexp_replace("p_name", " ", ""), F.lit("\n"))
    header = F.concat(F.lit("Basic "), F.base64(F.concat(F.lit("u"), k.cast("string"), F.lit(":a:b")).cast("binary")))
    return driver_table(spark, sf, "part").select("p_partkey", S.inline_safe(mime).alias("inline"), S.safe_filename(name).alias("filename"), S.basic_auth(header)["user"].alias("username"))


@query("sca_39_40_arrays", "select object_id, cast(count(*) filter (where volume_id = 7) as int) as hits, count(*) filter (where volume_id = 7) > 1 as twice from slices group by object_id")
def sca_39(spark: SparkSession, sf: str) -> DataFrame:
    held = R(spark, sf, "slices").groupBy("object_id").agg(F.collect_list("volume_id").alias("v"))
    swapped = S.replace_value(F.col("v"), F.lit(7), F.lit(-7))
    return held.select("object_id", F.size(F.filter(swapped, lambda x: x == -7)).alias("hits"), S.occurs_twice(F.col("v"), F.lit(7)).alias("twice"))


@query(
    "sca_41_merged_times",
    """select o.object_id, s.slice_index, case when slice_index in (0, 2) then timestamp '2030-01-01 00:00:00' when verified_at is not null and (last_verified_at is null or verified_at >= last_verified_at) then verified_at else last_verified_at end as verified
      from objects o join slices s on o.object_id = s.object_id""",
)
def sca_41(spark: SparkSession, sf: str) -> DataFrame:
    times = R(spark, sf, "slices").groupBy("object_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slice_index", "verified_at"))), lambda x: x["verified_at"]).alias("t"))
    joined = R(spark, sf, "objects").select("object_id", "last_verified_at").join(times, "object_id")
    merged = S.merged_times(F.size("t"), F.col("last_verified_at"), F.col("t"), F.array(F.lit(0), F.lit(2)), F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"), F.lit(0))
    return joined.select("object_id", F.posexplode(merged).alias("slice_index", "verified"))


@query(
    "sca_42_merged_errors",
    "select object_id, slice_index, case when slice_index = 1 then 'ENEW' else error_code end as code from slices where (slice_index not in (0, 1) and error_code is not null) or slice_index = 1",
)
def sca_42(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.struct(F.col("slice_index").cast("string"), "error_code")
    held = R(spark, sf, "slices").groupBy("object_id").agg(F.map_from_entries(F.filter(F.collect_list(F.when(F.col("error_code").isNotNull(), pairs)), lambda x: x.isNotNull())).alias("old"), F.max(F.col("slice_index") == 1).alias("second"))
    none = F.create_map().cast("map<string,string>")
    merged = S.merged_errors(F.col("old"), F.array(F.lit("0"), F.lit("1")), F.when(F.col("second"), F.create_map(F.lit("1"), F.lit("ENEW"))).otherwise(none))
    return held.select("object_id", F.explode(merged).alias("k", "code")).select("object_id", F.col("k").cast("int").alias("slice_index"), "code")


_SIGNATURE = "case volume_id % 9 when 0 then 'crypto_LUKS' when 1 then 'ext4' when 2 then '' when 3 then null when 4 then 'ntfs' when 5 then 'LUKS2' when 6 then 'EXT3' when 7 then 'next4' else 'xfs' end"


@query(
    "sca_47_partitions",
    f"""select volume_id, case when s is null then 'unreadable' when length(s) = 0 then 'blank' when regexp_matches(s, '(?i)luks') then 'luks' when regexp_matches(s, '(?i)^ext') then 'ext' else 'other' end as kind
      from (select volume_id, {_SIGNATURE} as s from volumes) v""",
)
def sca_47(spark: SparkSession, sf: str) -> DataFrame:
    return R(spark, sf, "volumes").select("volume_id", S.partition_kind(F.expr(_SIGNATURE)).alias("kind"))


@query("sca_50_attention", f"select volume_id, case when deleted then 'deleted' when not started then 'stopped' when not healthy then 'unhealthy' when {FREE} < 100000000 then 'full' when verify_errors > 3 then 'errors' end as reason from volumes")
def sca_50(spark: SparkSession, sf: str) -> DataFrame:
    free = F.coalesce("bytes_free", F.lit(0)) - F.col("bytes_pending")
    reason = F.when(F.col("deleted"), "deleted").when(~F.col("started"), "stopped").when(~F.col("healthy"), "unhealthy").when(free < 100000000, "full").when(F.col("verify_errors") > 3, "errors")
    return R(spark, sf, "volumes").select("volume_id", reason.alias("reason"))


@query("fil_20_bucket_names", "select regexp_matches(c_name, '^[A-Za-z0-9][A-Za-z0-9._-]{0,62}$') as valid, count(*) as n from {customer} group by 1")
def fil_20(spark: SparkSession, sf: str) -> DataFrame:
    return driver_table(spark, sf, "customer").groupBy(S.bucket_name_valid(F.col("c_name")).alias("valid")).agg(F.count(F.lit(1)).alias("n"))
