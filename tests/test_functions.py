import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sliceworks.functions import erasure
from sliceworks.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("data_n,parity_n", [(4, 2), (2, 1), (6, 2)])
def test_any_quorum_decodes(data_n, parity_n):
    data = [bytes((s * 31 + i * 7) & 0xFF for i in range(128)) for s in range(data_n)]
    data[-1] = data[-1][:64] + bytes(64)
    every = dict(enumerate(data + erasure.encode(data, parity_n)))
    for kept in itertools.combinations(every, data_n):
        assert erasure.decode({i: every[i] for i in kept}, data_n, parity_n) == data
    assert erasure.decode({0: data[0]}, data_n, parity_n) is None
    assert erasure.encode([bytes(128)] * data_n, parity_n) != erasure.encode(data, parity_n)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.binary(min_size=8, max_size=8), min_size=3, max_size=5))
def test_parity_round_trip(data):
    parity = erasure.encode(data, 2)
    left = {**dict(enumerate(data[2:], 2)), len(data): parity[0], len(data) + 1: parity[1]}
    assert erasure.decode(left, len(data), 2) == data


def test_categories_and_triage(spark):
    assert one(spark, S.error_category(F.lit("EHDRSUM"))) == "header-checksum"
    assert one(spark, S.error_category(F.lit(None).cast("string"), F.lit("Header MISMATCH"))) == "header-mismatch"
    assert one(spark, S.error_category(F.lit("EODD"), F.lit("boom"))) == "unknown"
    assert one(spark, S.triage(F.lit(3), F.lit(1), F.lit(0), F.lit(4))) == "recoverable-remount"
    assert one(spark, S.triage(F.lit(1), F.lit(1), F.lit(1), F.lit(4))) == "lost"


def test_ids_and_paths(spark):
    assert str(one(spark, S.id_time(F.lit("ffffffff0000000000000000")).cast("timestamp_ntz"))) == "1969-12-31 23:59:59"
    assert one(spark, S.slice_file(F.lit("0123456789abcdef01234567.31")))["slice_index"] == 31
    assert one(spark, S.slice_file(F.lit("0123456789abcdef01234567.32"))) is None
    assert one(spark, S.path_prefixes(F.lit("/a//b/"))) == ["a", "a/b"]
    assert one(spark, S.path_prefixes(F.lit("/"))) == []
    assert one(spark, S.bucket_ref(F.lit("///x/y?z=1")))["bucket"] == "x"
    assert one(spark, S.parent_disk(F.lit("nvme0n1"))) is None


def test_ranges(spark):
    size = F.lit(10).cast("bigint")
    assert tuple(one(spark, S.byte_range(F.lit("bytes=2-4"), size))) == (2, 5)
    assert tuple(one(spark, S.byte_range(F.lit("bytes=2-"), size))) == (2, 10)
    for bad in ("bytes=10-", "bytes=-3", "bytes=5-2", "what"):
        assert one(spark, S.byte_range(F.lit(bad), size)) is None


def test_dead_is_a_text_that_is_not_empty(spark):
    assert [one(spark, S.dead(F.lit(x).cast("string"))) for x in (None, "", "gone")] == [False, False, True]


def test_log_lines(spark):
    def device(line):
        return [(s["device"], s["kind"]) for s in one(spark, S.log_signals(F.lit(line)))]

    assert device("Device: /dev/sdq [ATA], 17 Currently unreadable (pending) sectors") == [("sdq", "pending")]
    assert device("Device: /dev/sdq [ATA], no Currently unreadable (pending) sectors") == []
    assert device("EXT4-fs (sdz9): recovery complete") == [] and device("EXT4-fs warning (device sdz9): slow") == []
    assert device("EXT4-fs (dm-12): Write Error on inode 7") == [("dm-12", "ioerror")]
    assert device("EXT4-fs error (device sdz9): odd bitmap") == [("sdz9", "ioerror")]
    assert device("EXT4-fs warning (device sdz9): inode 4 comm ls: reading directory block 2") == [("sdz9", "ioerror")]
    assert device("Aborting journal on device nvme0n1p2-8.") == [("nvme0n1p2", "ioerror")]
    assert device("jbd2: error -28 seen for dm-4-8.") == [("dm-4", "ioerror")]
    assert device("block 9: Medium Error seen by dev sdc, later dev sdd") == [("sdc", "ioerror")]
    assert device("scsi: [sdh] Device Not Ready [sdi]") == [("sdh", "ioerror")]
    assert device("scsi: hardware error before [sdh]") == [] and device("usb 1-1: plugged in") == []
    both = one(spark, S.log_signals(F.lit("[sdk] hardware error, dev sdm: I/O error")))
    assert [(s["device"], s["detail"]) for s in both] == [("sdm", "i/o error")] or [(s["device"], s["detail"]) for s in both] == [("sdm", "hardware error")]


def test_times_and_errors_merge(spark):
    none = F.lit(None).cast("timestamp_ntz")
    assert one(spark, S.min_or_null(F.array(none, F.lit("2020-01-01").cast("timestamp_ntz")))) is None
    merged = S.merged_errors(F.create_map(F.lit("0"), F.lit("a")), F.array(F.lit("0")), F.create_map().cast("map<string,string>"))
    assert one(spark, merged) is None
