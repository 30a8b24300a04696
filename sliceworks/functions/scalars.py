"""Scalar functions of the storage model, Column in, Column out. None runs Python on the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the storage format and its classifications.
FILE_HEADER = 48
CHUNK_HEADER = 16
CHUNK = 16384
CODE_CATEGORIES = {
    "ECHECKSUM": "checksum", "EHEADER": "header-mismatch", "EUNAVAIL": "volume-unavailable", "ENOENT": "missing", "EIO": "io", "ETIMEOUT": "timeout", "EPARITY": "parity-mismatch", "EHDRSUM": "header-checksum",
}
SMART_FLAGS = {
    0x04: ("SMART status check failed", True), 0x08: ("Pre-ID SMART health check failed", True), 0x10: ("Mandatory SMART command failed", False),
    0x20: ("Self-test log contains errors", True), 0x40: ("Device in low-power mode (SMART restricted)", False), 0x80: ("Device in low-power mode (SMART unavailable)", True),
}
# What the message of an error without a known code holds, and its category; the first that holds counts. All needles of one alternative must be there.
MESSAGE_CATEGORIES = (
    (("checksum",), "checksum"),
    (("header", "mismatch"), "header-mismatch"),
    (("not readable",), "volume-unavailable"),
    (("mount point is not configured",), "volume-unavailable"),
    (("volume is not",), "volume-unavailable"),
    (("enoent",), "missing"),
    (("no such file",), "missing"),
    (("timed out",), "timeout"),
    (("timeout",), "timeout"),
    (("short read",), "io"),
    (("i/o error",), "io"),
    (("input/output",), "io"),
)
# Phrases of system logs. The kernel's block layer, with the device named after the phrase as "dev NAME":
BLOCK_PHRASES = ("critical target error", "critical medium error", "i/o error", "medium error", "hardware error", "device offline error", "unaligned write command", "rejecting i/o to offline device")
# ... or before it as "[NAME]":
BRACKET_PHRASES = ("rejecting i/o to offline device", "device offline", "hardware error", "medium error", "critical target error", "unrecovered read error", "unaligned partial completion", "device not ready")
# What makes an ext4 line serious although it isn't marked as an error:
EXT4_PHRASES = ("i/o error", "read error", "write error", "failed", "corrupt", "shut down requested", "remounting filesystem read-only", "aborted journal", "journal has aborted", "mounting fs with errors")
EXT4_UNREADABLE = ("comm ", ": reading directory")  # one after the other
PENDING_PHRASE = "Currently unreadable (pending) sectors"
JOURNAL_PHRASE = "aborting journal"
SEVERITIES = ("info", "warning", "critical")
INLINE_TYPES = ("image/png", "image/jpeg", "image/gif", "image/webp", "image/avif", "image/bmp", "image/x-icon", "image/tiff", "application/octet-stream")


# Predicates that every operator shares


def readable() -> Column:
    return F.col("started") & F.col("enabled")


def writable() -> Column:
    return F.col("started") & F.col("enabled") & F.col("healthy") & ~F.col("read_only") & ~F.col("draining")


def missing() -> Column:
    return F.col("enabled") & ~F.col("deleted") & ~F.col("present")


def dead(comment: Column) -> Column:
    """An object is given up when its recovery comment is a text that isn't empty."""
    return F.coalesce(F.length(comment) > 0, F.lit(False))


def stale(time: Column, boundary: Column) -> Column:
    return time.isNull() | (time < boundary)


def failure_domain(group: Column, volume: Column) -> Column:
    return F.when(volume.isNull(), "unknown").when(group.isNull(), F.concat(F.lit("ungrouped:"), volume.cast("string"))).otherwise(F.concat(F.lit("group:"), group.cast("string")))


# Geometry


def ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a.cast("double") / b.cast("double")).cast("bigint")


def slice_size(size: Column, chunk: Column, data_n: Column, declared: Column | None = None) -> Column:
    """Stored bytes of a slice: its share of the object, a file header and a header a chunk."""
    share = ceil_div(F.coalesce(size, F.lit(0)), F.greatest(F.lit(1), data_n))
    step = F.coalesce(chunk, F.lit(CHUNK))
    chunks = F.greatest(F.lit(1), F.ceil(1 + (share - (step - FILE_HEADER) + CHUNK_HEADER).cast("double") / (step - CHUNK_HEADER).cast("double")).cast("bigint"))
    formula = FILE_HEADER + share + CHUNK_HEADER * chunks
    return (formula if declared is None else F.coalesce(declared, formula)).cast("bigint")


def slice_estimate(size: Column, data_n: Column, declared: Column | None = None) -> Column:
    """The share without headers, as relocation plans with it."""
    share = ceil_div(F.coalesce(size, F.lit(0)), F.greatest(F.lit(1), data_n))
    return share if declared is None else F.coalesce(declared, share)


def _ceil8(x: Column) -> Column:
    return (F.floor((x + 7) / 8) * 8).cast("bigint")


def geometry(size: Column, chunk: Column, data_n: Column) -> Column:
    """struct<start_chunk, standard_chunk, standard_offset, standard_count, end_offset, end_chunk>."""
    standard = chunk - CHUNK_HEADER
    start = _ceil8(F.greatest(F.lit(1), F.least(standard - FILE_HEADER, F.floor(size / data_n).cast("bigint"))))
    offset = start * data_n
    left = ceil_div(F.greatest(F.lit(0), size - offset), data_n)
    count = F.floor(left / standard).cast("bigint")
    end_offset = offset + count * standard * data_n
    return F.struct(
        start.alias("start_chunk"), standard.alias("standard_chunk"), offset.alias("standard_offset"), count.alias("standard_count"), end_offset.alias("end_offset"), _ceil8(ceil_div(size - end_offset, data_n)).alias("end_chunk")
    )


def chunk_start(k: Column, chunk: Column, start_chunk: Column) -> Column:
    """Where chunk k of a slice starts in its file."""
    return F.when(k == 0, F.lit(FILE_HEADER)).otherwise(FILE_HEADER + CHUNK_HEADER + start_chunk + (k - 1) * chunk).cast("bigint")


def chunk_of_offset(offset: Column, standard_offset: Column, standard_chunk: Column, data_n: Column) -> Column:
    """The chunk set that holds a byte of the object."""
    return F.when(offset < standard_offset, 0).otherwise(1 + F.floor((offset - standard_offset) / (standard_chunk * data_n))).cast("bigint")


def overlaps(start: Column, end: Column, range_start: Column, range_end: Column) -> Column:
    return (start < range_end) & (end > range_start)


def fill(total: Column, free: Column, pending: Column) -> Column:
    used = total - (F.coalesce(free, F.lit(0)) - F.coalesce(pending, F.lit(0)))
    return F.when(total > 0, used.cast("double") / total.cast("double")).otherwise(0.0)


def progress(moved: Column, left: Column) -> Column:
    return F.when(moved + left > 0, moved.cast("double") / (moved + left).cast("double")).otherwise(1.0)


def used_fraction(used: Column, total: Column) -> Column:
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), used.cast("double") / total.cast("double"))))


def fullness(fraction: Column) -> Column:
    return F.when(fraction >= 0.9, "critical").when(fraction >= 0.7, "warn").when(fraction.isNotNull(), "ok")


def format_bytes(n: Column) -> Column:
    """Two decimals of the largest unit that fits, in whole numbers, so that a half is one and goes to the even digit, as C's printf has it."""
    size = n.cast("bigint")
    out = F.concat(n.cast("string"), F.lit(" b"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        bits, below = 10 * power, 1024**power - 1
        part = size.bitwiseAND(below) * 100
        cents, rest, half = F.shiftright(part, bits), part.bitwiseAND(below), 1 << (bits - 1)
        cents = cents + ((rest > half) | ((rest == half) & (cents % 2 == 1))).cast("bigint")
        whole = F.shiftright(size, bits) + (cents == 100).cast("bigint")
        out = F.when(n >= 1024**power, F.concat(whole.cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(f" {unit}"))).otherwise(out)
    return out


def clamp(value: Column, default: int, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value.try_cast("int"), F.lit(default))))


# Faults


def error_category(code: Column, message: Column | None = None) -> Column:
    """By code, else by what the message holds, else unknown."""
    known = F.create_map(*[F.lit(x) for pair in CODE_CATEGORIES.items() for x in pair])
    text = F.lower(message) if message is not None else F.lit(None).cast("string")
    table = F.array(*[F.struct(F.array(*map(F.lit, needles)).alias("needles"), F.lit(category).alias("category")) for needles, category in MESSAGE_CATEGORIES])
    fitting = F.filter(table, lambda row: F.forall(row["needles"], lambda needle: F.contains(text, needle)))
    return F.coalesce(F.try_element_at(known, code), F.get(fitting, 0)["category"], F.lit("unknown"))


def legacy_category(category: Column, checksum: Column, code: Column, message: Column) -> Column:
    return F.coalesce(category, F.when(checksum, "checksum"), error_category(code, message))


def triage(good: Column, unavailable: Column, restamp: Column, data_n: Column) -> Column:
    return (
        F.when(good >= data_n, "readable-now").when(good + unavailable >= data_n, "recoverable-remount").when(good + unavailable + restamp >= data_n, "recoverable-restamp").otherwise("lost")
    )


def fault_key(volume: Column, object_id: Column, slice_index: Column) -> Column:
    return F.concat_ws(":", F.coalesce(volume.cast("string"), F.lit("unknown")), object_id.cast("string"), slice_index.cast("string"))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1


def smart_messages(exit_code: Column) -> Column:
    flags = F.array(*[F.struct(F.lit(bit).alias("bit"), F.lit(text).alias("text"), F.lit(bad).alias("bad")) for bit, (text, bad) in SMART_FLAGS.items()])
    return F.transform(F.filter(flags, lambda f: exit_code.bitwiseAND(f["bit"]) != 0), lambda f: f["text"])


def smart_unhealthy(exit_code: Column) -> Column:
    return exit_code.bitwiseAND(sum(bit for bit, (_, bad) in SMART_FLAGS.items() if bad)) != 0


# Ids, paths and names


def id_time(object_id: Column) -> Column:
    """Creation time in an id's first eight hex digits, a signed 32-bit number of seconds."""
    seconds = F.conv(F.substring(object_id, 1, 8), 16, 10).cast("bigint")
    return F.timestamp_seconds(F.when(seconds >= 1 << 31, seconds - (1 << 32)).otherwise(seconds))


def make_id(*parts: Column) -> Column:
    """A 24-digit id that its parts decide."""
    return F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 24)


def shard_path(object_id: Column, slice_index: Column) -> Column:
    parts = [F.substring(object_id, at, 2) for at in (1, 3, 5)]
    return F.concat_ws("/", *parts, F.concat_ws(".", object_id, slice_index.cast("string")))


def slice_file(name: Column) -> Column:
    """struct<object_id, slice_index> of a committed slice file's name; null for other names."""
    pattern = r"^([0-9a-f]{24})\.(\d+)$"
    index = F.regexp_extract(name, pattern, 2).try_cast("int")
    return F.when(F.regexp_like(name, F.lit(pattern)) & (index < 32), F.struct(F.regexp_extract(name, pattern, 1).alias("object_id"), index.alias("slice_index")))


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def path_prefixes(path: Column) -> Column:
    parts = path_parts(path)
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def bucket_ref(url: Column) -> Column:
    """struct<form, bucket> that a raw request path addresses: by id, by path, or none."""
    path = F.substring_index(url, "?", 1)
    first = F.substring_index(F.regexp_replace(path, r"^/+", ""), "/", 1)
    form = F.when(F.regexp_like(path, F.lit(r"^/\$[0-9a-f]{24}$")), "id").when(first == "", "none").otherwise("path")
    return F.struct(form.alias("form"), F.when(form == "path", first).alias("bucket"))


def byte_range(header: Column, size: Column) -> Column:
    """struct<start, end> of a Range header; null where the answer is 416. Suffix ranges aren't supported."""
    plain = F.regexp_replace(header, "bytes=", "")
    start = F.regexp_extract(plain, r"^\s*(\d+)", 1).try_cast("bigint")
    last = F.regexp_extract(plain, r"^[^-]*-\s*(\d+)", 1).try_cast("bigint")
    end = F.when(last.isNull(), size).otherwise(F.least(last + 1, size))
    return F.when((start < size) & (end > start), F.struct(start.alias("start"), end.alias("end")))


def bucket_name_valid(name: Column) -> Column:
    return F.regexp_like(name, F.lit(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,62}$"))


def parent_disk(device: Column) -> Column:
    nvme, plain = r"^(nvme\d+n\d+)p\d+$", r"^([a-zA-Z]+)\d+$"
    return F.when(F.regexp_like(device, F.lit(nvme)), F.regexp_extract(device, nvme, 1)).when(F.regexp_like(device, F.lit(plain)), F.regexp_extract(device, plain, 1))


def label_bay(label: Column) -> Column:
    """struct<group, bay> of a label such as 3.12."""
    pattern = r"^(\d+)\.(\d+)$"
    return F.when(F.regexp_like(label, F.lit(pattern)), F.struct(F.regexp_extract(label, pattern, 1).cast("int").alias("group"), F.regexp_extract(label, pattern, 2).cast("int").alias("bay")))


def inline_safe(mime: Column) -> Column:
    kind = F.lower(F.trim(F.substring_index(mime, ";", 1)))
    return F.coalesce(kind.isin(*INLINE_TYPES) | F.startswith(kind, F.lit("video/")) | F.startswith(kind, F.lit("audio/")), F.lit(False))


def safe_filename(name: Column) -> Column:
    return F.left(F.regexp_replace(name, r'[\x00-\x1f\x7f"\\]', ""), F.lit(255))


def basic_auth(header: Column) -> Column:
    """struct<user, secret> of a Basic header: decoded, split at the first colon."""
    text = F.try_to_binary(F.regexp_extract(header, r"^(?i:basic)\s+(\S+)$", 1), F.lit("base64")).cast("string")
    at = F.instr(text, ":")
    return F.when(at > 0, F.struct(F.left(text, at - 1).alias("user"), F.substring(text, at + 1, F.length(text)).alias("secret")))


def partition_kind(signature: Column) -> Column:
    s = F.lower(signature)
    return F.when(signature.isNull(), "unreadable").when(s == "", "blank").when(F.contains(s, F.lit("luks")), "luks").when(F.startswith(s, F.lit("ext")), "ext").otherwise("other")


def hex_md5(value: Column) -> Column:
    return F.lower(F.hex(value))


# Arrays


def replace_value(values: Column, old: Column, new: Column) -> Column:
    return F.transform(values, lambda x: F.when(x == old, new).otherwise(x))


def occurs_twice(values: Column, value: Column) -> Column:
    return F.size(F.filter(values, lambda x: x == value)) > 1


def min_or_null(times: Column) -> Column:
    """The least, null if one is null or there are none."""
    return F.when(F.exists(times, lambda t: t.isNull()), None).otherwise(F.array_min(times))


def merged_times(count: Column, baseline: Column, times: Column, processed: Column, now: Column, offset: Column) -> Column:
    """Verification time of each slice: the baseline, overlaid by its own unless older, and now if it was processed (its index counts from ``offset``)."""

    def one(i: Column) -> Column:
        own = F.get(times, i)
        kept = F.when(own.isNotNull() & (baseline.isNull() | (own >= baseline)), own).otherwise(baseline)
        return F.when(F.array_contains(processed, i + offset), now).otherwise(kept)

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array().cast("array<timestamp_ntz>"))


def merged_errors(old: Column, processed: Column, new: Column) -> Column:
    """Errors by slice: those of processed slices go, new ones come; null if none is left."""
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(processed, k) & ~F.array_contains(F.map_keys(new), k))
    both = F.map_concat(kept, new)
    return F.when(F.size(both) > 0, both)


# Log lines


_DEVICE = r"[\w.-]+"


def _earliest(text: Column, phrases: Sequence[str]) -> Column:
    """struct<at, order, phrase> of the phrase that a lower-case text holds first, of several at one place the first of the list; null if it holds none."""
    places = F.array(*[F.struct(F.locate(p, text).alias("at"), F.lit(i).alias("order"), F.lit(p).alias("phrase")) for i, p in enumerate(phrases)])
    return F.array_min(F.filter(places, lambda x: x["at"] > 0))


def _signal(device: Column, kind: str, detail: Column, count: Column | None = None) -> Column:
    """A signal, if there is a device."""
    count = F.lit(None).cast("int") if count is None else count
    return F.when(device != "", F.struct(device.alias("device"), F.lit(kind).alias("kind"), detail.alias("detail"), count.alias("count")))


def _pending_sectors(line: Column) -> Column:
    """smartd counts the sectors right before its phrase and names the device after "Device:"."""
    count = F.regexp_extract(F.substring_index(line, f" {PENDING_PHRASE}", 1), r"(\d+)$", 1).try_cast("int")
    device = F.regexp_extract(line, rf"Device:\s+/dev/({_DEVICE})", 1)
    return F.when(F.contains(line, F.lit(PENDING_PHRASE)) & count.isNotNull(), _signal(device, "pending", F.format_string("%d pending sector(s)", count), count))


def _block_error(line: Column) -> Column:
    """The kernel names the device behind its phrase, or in brackets before it."""
    low = F.lower(line)
    named_after = _earliest(low, BLOCK_PHRASES)
    behind = F.regexp_extract(F.substr(line, named_after["at"]), rf"\bdev\s+({_DEVICE})", 1)
    bracketed = F.regexp_extract(line, rf"\[({_DEVICE})\]", 1)
    rest = F.regexp_extract(low, rf"\[{_DEVICE}\](.*)", 1)
    return F.coalesce(_signal(behind, "ioerror", named_after["phrase"]), F.when(_earliest(rest, BRACKET_PHRASES).isNotNull(), _signal(bracketed, "ioerror", _earliest(rest, BRACKET_PHRASES)["phrase"])))


def _ext4_error(line: Column) -> Column:
    """ext4 names its device in parentheses; what it says is serious if marked as an error, or by its words."""
    head = rf"(?i)ext4-fs\s*(error|warning|)\s*\((?:device\s+)?({_DEVICE})\)\s*:?(.*)"
    level, device, said = (F.regexp_extract(line, head, i) for i in (1, 2, 3))
    said = F.left(F.trim(said), F.lit(120))
    low = F.lower(said)
    unreadable = F.contains(F.substr(low, F.greatest(F.lit(1), F.locate(EXT4_UNREADABLE[0], low))), F.lit(EXT4_UNREADABLE[1])) & F.contains(low, F.lit(EXT4_UNREADABLE[0]))
    serious = (F.lower(level) == "error") | _earliest(low, EXT4_PHRASES).isNotNull() | unreadable
    detail = F.when(said != "", said).when(level != "", level).otherwise("error")
    return F.when(serious, _signal(device, "ioerror", F.concat(F.lit("ext4: "), detail)))


def _journal_error(line: Column) -> Column:
    """The journal names a device with the journal's own number behind it, which goes."""
    spoken = rf"(?i)jbd2:\s*(.*?)\s+(?:on|for)\s+({_DEVICE})"
    aborted = rf"(?i){JOURNAL_PHRASE} on device\s+({_DEVICE})"
    device = F.coalesce(F.nullif(F.regexp_extract(line, spoken, 2), F.lit("")), F.regexp_extract(line, aborted, 1))
    said = F.coalesce(F.nullif(F.trim(F.regexp_extract(line, spoken, 1)), F.lit("")), F.lit(JOURNAL_PHRASE))
    bare = F.regexp_replace(F.rtrim(device, F.lit(".")), r"-\d+$", "")
    return _signal(bare, "ioerror", F.concat(F.lit("jbd2: "), F.left(said, F.lit(120))))


def log_signals(line: Column) -> Column:
    """array<struct<device, kind, detail, count>> of one line of a system log: pending sectors, errors of the block layer, of ext4 and of its journal."""
    return F.filter(F.array(_pending_sectors(line), _block_error(line), _ext4_error(line), _journal_error(line)), lambda s: s.isNotNull())
