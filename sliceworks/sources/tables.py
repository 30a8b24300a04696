"""Sources and sinks: snapshots, journals, slice files, manifests, rewritten tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import ship

RECORD = "op string, ts timestamp, id string, cid string, name string, mime string, md5 string, size bigint, cs bigint, pr boolean, pw boolean, dp boolean, containers bigint, objects bigint, sha256 string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON records, gzip or plain, with their raw text; a record that doesn't parse has a null op."""
    lines = spark.read.text(path).withColumnRenamed("value", "raw")
    return lines.select("raw", F.from_json("raw", RECORD).alias("r")).select("raw", "r.*")


def records_digest(lines: Column) -> Column:
    """A digest of a multiset of lines, as an aggregate: the SHA-256 of the sums of four parts of each line's SHA-256. Order and partitions don't matter; a line that is changed, lost or there twice does."""
    each = F.sha2(lines.cast("binary"), 256)
    sums = [F.coalesce(F.sum(F.conv(F.substring(each, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return F.sha2(F.concat_ws(":", *sums).cast("binary"), 256)


def write_snapshot(containers: DataFrame, objects: DataFrame, path: str) -> None:
    """Containers, then objects, then a trailer with both counts and the records' digest, as gzipped NDJSON. Parts keep that order by their names.

    A record whose name holds a line break is refused: it would split its line.
    """
    broken = r"[\n\r\x85\u2028\u2029]"
    refused = F.assert_true(~F.regexp_like("name", F.lit(broken)), "a name holds a line break")
    rows = containers.select(F.lit(0).alias("_k"), "id", F.to_json(F.struct(F.lit("container").alias("op"), *containers.columns)).alias("value"), "name").unionByName(
        objects.select(F.lit(1).alias("_k"), "id", F.to_json(F.struct(F.lit("put").alias("op"), *objects.columns)).alias("value"), "name")
    )
    totals = rows.agg(F.count_if(F.col("_k") == 0).alias("containers"), F.count_if(F.col("_k") == 1).alias("objects"), records_digest(F.col("value")).alias("sha256"))
    end = totals.select(F.lit(2).alias("_k"), F.lit("").alias("id"), F.to_json(F.struct(F.lit("end").alias("op"), "containers", "objects", "sha256")).alias("value"), F.lit("").alias("name"))
    checked = rows.filter(refused.isNull()).unionByName(end)
    checked.orderBy("_k", "id").select("value").write.option("compression", "gzip").mode("overwrite").text(path)


def snapshot_verdict(records: DataFrame) -> DataFrame:
    """One row: whether the trailer is there, whether its counts and its digest hold, how many rows name a container that isn't there, and how many don't parse."""
    known = records.filter("op = 'container'").select(F.col("id").alias("cid")).distinct()
    loose = records.filter("cid IS NOT NULL AND op IN ('put', 'container')").join(known, "cid", "left_anti").agg(F.count(F.lit(1)).alias("dangling"))
    counts = records.agg(
        F.count_if(F.col("op") == "end").alias("trailers"), F.count_if(F.col("op") == "container").alias("c"), F.count_if(F.col("op") == "put").alias("o"), F.max("containers").alias("tc"), F.max("objects").alias("to"), F.count_if(F.col("op").isNull()).alias("broken"),
        F.max("sha256").alias("said"), records_digest(F.when(~F.col("op").eqNullSafe("end"), F.col("raw"))).alias("found"),
    )
    holds = F.coalesce((F.col("c") == F.col("tc")) & (F.col("o") == F.col("to")), F.lit(False))
    return counts.join(F.broadcast(loose)).select((F.col("trailers") == 1).alias("complete"), holds.alias("counts_hold"), F.coalesce(F.col("said") == F.col("found"), F.lit(False)).alias("sum_holds"), "dangling", "broken")


def usable_snapshot(spark: SparkSession, paths: list[str]) -> tuple[str | None, DataFrame]:
    """Of a few snapshots, newest first, the first that is whole, and a report: place (1: newest), path, its verdict, or that it can't be read, and used. A snapshot that isn't whole gives way to the one before it."""
    used, report = None, None
    for place, path in enumerate(paths, 1):
        try:
            row = snapshot_verdict(read_records(spark, path)).first()
            verdict = (row["complete"], row["counts_hold"], row["sum_holds"], row["broken"])
        except Exception as e:  # absent, or not to be read
            if "PATH_NOT_FOUND" not in str(e) and "FAILED_READ_FILE" not in str(e):
                raise
            verdict = (False, False, False, None)
        fine = used is None and all(verdict[:3]) and verdict[3] == 0
        used = path if fine else used
        one = spark.range(1).select(F.lit(place).alias("place"), F.lit(path).alias("path"), *[F.lit(v).cast("boolean").alias(n) for v, n in zip(verdict, ("complete", "counts_hold", "sum_holds"), strict=False)], F.lit(fine).alias("used"))
        report = one if report is None else report.unionByName(one)
    return used, report


def restored_containers(records: DataFrame) -> DataFrame:
    """Containers as a snapshot's records have them: a flag that a record lacks stays absent, which is not false."""
    return records.filter("op = 'container'").select("id", "cid", "name", F.col("pr").alias("public_read"), F.col("pw").alias("public_write"), F.col("dp").alias("delete_protected"))


def longest_copies(segments: DataFrame) -> DataFrame:
    """Of each segment's copies (segment, replica, body) the longest, and whether every other is a prefix of it."""
    best = segments.groupBy("segment").agg(F.max_by(F.struct("replica", "body"), F.struct(F.length("body"), -F.col("replica"))).alias("b"))
    joined = segments.join(best, "segment")
    return joined.groupBy("segment").agg(F.first("b.replica").alias("replica"), F.first(F.length("b.body")).alias("length"), F.bool_and(F.startswith(F.col("b.body"), F.col("body"))).alias("consistent"))


def missing_segments(segments: DataFrame) -> DataFrame:
    """Numbers between 0 and the last segment that no copy has."""
    last = segments.agg(F.max("segment").alias("last")).first()["last"]  # one number
    every = segments.sparkSession.range(0 if last is None else int(last) + 1).select(F.col("id").alias("segment"))
    return every.join(segments.select(F.col("segment").cast("bigint").alias("segment")).distinct(), "segment", "left_anti")


def torn_tail(records: DataFrame) -> DataFrame:
    """``records`` (line, op) that parse; raises if one that doesn't isn't the last."""
    whole = records.agg(F.max("line").alias("_last"))
    judged = records.join(F.broadcast(whole))
    fine = F.when(F.col("op").isNotNull(), True).when(F.col("line") == F.col("_last"), False).otherwise(F.raise_error(F.lit("a record before the last does not parse")).cast("boolean"))
    return judged.filter(fine).drop("_last")


def slice_files(spark: SparkSession, folder: str) -> DataFrame:
    """object_id, slice_index, path and length of the slice files below a volume's folder; file bodies aren't read, other names are left out. An unreadable folder fails."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "false").load(folder).select("path", "length")
    named = files.withColumn("_f", S.slice_file(F.element_at(F.split("path", "/"), -1)))
    return named.filter(F.col("_f").isNotNull()).select("_f.object_id", "_f.slice_index", "path", "length")


def _number(raw: Column, at: int, width: int) -> Column:
    """Little-endian bytes as a number; ``at`` counts from 1."""
    digits = F.concat(*[F.hex(F.substring(raw, at + i, 1)) for i in range(width - 1, -1, -1)])
    return F.conv(digits, 16, 10).cast("bigint")


def decode_header(raw: Column) -> Column:
    """struct<long_enough, object_id, size, data_n, parity_n, chunk, slice_index, sum_ok> of a slice header; sum_ok is null for one too short to be judged.

    Layout: magic (7 bytes), MD5 of what follows (16), id (12), size (5), data, parity, chunk size (3), index, padding (3).
    """
    return F.struct(
        (F.length(raw) >= 48).alias("long_enough"), F.lower(F.hex(F.substring(raw, 24, 12))).alias("object_id"), _number(raw, 36, 5).alias("size"), _number(raw, 41, 1).alias("data_n"), _number(raw, 42, 1).alias("parity_n"),
        _number(raw, 43, 3).alias("chunk"), _number(raw, 46, 1).alias("slice_index"), F.when(F.length(raw) >= 48, F.md5(F.substring(raw, 24, 26)) == F.lower(F.hex(F.substring(raw, 8, 16)))).alias("sum_ok"),
    )


def chunks(bodies: DataFrame, size: int) -> DataFrame:
    """id, k, data and md5 of a body's chunks (id, body binary); the last may be short; an empty body has none."""
    n = F.ceil(F.length("body") / float(size)).cast("int")
    at = bodies.filter(F.length("body") > 0).select("id", "body", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    data = F.substring(F.col("body"), F.col("k") * size + 1, F.lit(size))
    return at.select("id", "k", data.alias("data"), F.md5(data).alias("md5"))


def read_range(chunk_rows: DataFrame, size: int, start: int, end: int) -> DataFrame:
    """id and the bytes [start, end) of each body, from the chunks that overlap them only."""
    touched = chunk_rows.filter((F.col("k") * size < end) & ((F.col("k") + 1) * size > start))
    low, high = F.greatest(F.lit(0), start - F.col("k") * size), F.least(F.lit(size), end - F.col("k") * size)
    cut = touched.select("id", "k", F.hex(F.substring(F.col("data"), low + 1, high - low)).alias("h"))
    return cut.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "").alias("hex"))


def first_frame(body: bytes, sum_: str, width: int) -> int | None:
    """The first offset at which ``width`` bytes have this MD5, in hex."""
    wanted, view, md5 = bytes.fromhex(sum_), memoryview(body), hashlib.md5
    return next((at for at in range(len(body) - width + 1) if md5(view[at : at + width]).digest() == wanted), None)


def first_frames(framed: DataFrame, width: int) -> DataFrame:
    """framed: doc_id, body binary, sum. Gives doc_id and the offset of the first frame with that sum, null if none has it."""
    ship(framed.sparkSession)
    framed.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [first_frame(b.as_py(), s.as_py(), width) for b, s in zip(batch.column("body"), batch.column("sum"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int32())], ["doc_id", "offset"])

    return framed.select("doc_id", "body", "sum").mapInArrow(run, "doc_id bigint, offset int")


def by_id(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The row of an id; none fails."""
    found = rows.filter(F.col(key) == value)
    there = found.agg(F.count(F.lit(1)).alias("_n")).filter(F.when(F.col("_n") > 0, True).otherwise(F.raise_error(F.lit(f"ENOENT: no row with {key} {value}")).cast("boolean")))
    return found.join(F.broadcast(there)).drop("_n")  # one row


def upsert(old: DataFrame, new: DataFrame, key: str, unset: tuple[str, ...] = (), on_insert: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both. A new row's values replace the old; where it has null the old stays, but for ``unset`` columns, which then lose their value.

    ``on_insert`` columns are only set by a row that is new. Columns that ``new`` doesn't have stay as they are.
    """
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    there = F.col(f"o.{key}").isNotNull()

    def value(c: str) -> Column:
        was = F.col(f"o.{c}")
        if c not in new.columns:
            return was
        given = F.col(f"n.{c}")
        if c in on_insert:
            return F.when(there, was).otherwise(given)
        if c in unset:
            return F.when(F.col("n._new"), given).otherwise(was)
        return F.coalesce(given, was)

    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*[value(c).alias(c) for c in old.columns])


def archived(rows: DataFrame, retired: Column, path: str) -> DataFrame:
    """Move retired rows to a table of their own: they are appended there, read back and compared, and only then left out of what is returned.

    Fails, with nothing lost, if the copy doesn't hold each of them as often as ``rows`` does.
    """
    going = rows.filter(F.coalesce(retired, F.lit(False)))
    going.write.mode("append").parquet(path)
    copied = rows.sparkSession.read.schema(rows.schema).parquet(path)
    missing = going.exceptAll(copied).limit(1).count()
    if missing:
        raise RuntimeError(f"the copy in {path} lacks rows: nothing is retired")
    return rows.filter(~F.coalesce(retired, F.lit(False)))


def insert_if_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(*old.columns))


def delete_rows(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return old.join(gone.select(key), key, "left_anti")
