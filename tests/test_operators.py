import pytest
from pyspark.sql import functions as F

from sliceworks.operators import accounting, namespace, placement, replay
from sliceworks.sources import tables
from sliceworks.streaming import events


def test_totals_of_nothing_are_zero(spark):
    none = spark.createDataFrame([], "object_id bigint, size bigint, chunk_size bigint, data_n bigint, parity_n bigint")
    assert set(accounting.system_usage(none).first().asDict().values()) == {0}


def test_create_delete_create_nets_one(spark):
    objects = spark.createDataFrame([(1, 10, 64, 2, 1)], "object_id bigint, size bigint, chunk_size bigint, data_n bigint, parity_n bigint")
    slices = spark.createDataFrame([(1, 0, 1, "data"), (1, 1, 1, "data"), (1, 2, 3, "parity")], "object_id bigint, slice_index int, volume_id bigint, slice_type string")
    deltas = [accounting.object_deltas(objects, slices, F.lit(s)) for s in (1, -1, 1)]
    net = {r["volume_id"]: r for r in accounting.merge_deltas(deltas[0].unionByName(deltas[1]).unionByName(deltas[2])).collect()}
    assert net[None]["object_count"] == 1 and net[1]["object_count"] == 1 and net[1]["data_slice_count"] == 2 and set(net) == {None, 1, 3}
    assert accounting.merge_deltas(deltas[0].unionByName(deltas[1])).count() == 0
    assert accounting.apply_deltas(net_frame(spark), deltas[1]).filter("negative").count() == 3


def net_frame(spark):
    return spark.createDataFrame([], "volume_id bigint, " + ", ".join(f"{c} bigint" for c in accounting.COUNTERS))


def test_roots_of_orphans_and_cycles(spark):
    rows = [(1, None, "b"), (2, 1, "x"), (3, 2, "y"), (4, 99, "o"), (5, 4, "p"), (6, 7, "c"), (7, 6, "d")]
    tree = spark.createDataFrame(rows, "id bigint, parent_id bigint, name string")
    found = {r["id"]: (r["root_id"], r["top_id"]) for r in namespace.roots(tree).collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (None, 4), 5: (None, 4), 6: (None, None), 7: (None, None)}
    assert {r["path"] for r in namespace.paths(tree).collect()} == {"/b", "/b/x", "/b/x/y"}


def test_a_deep_chain_has_its_root(spark):
    tree = spark.range(5000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit("n").alias("name"))
    assert namespace.roots(tree).filter("root_id = 0").count() == 5000
    assert namespace.paths(tree).filter(F.col("depth") == F.col("id") + 1).filter(F.length("path") == 2 * F.col("depth")).count() == 5000
    wanted = spark.createDataFrame([("/n" * 5000,), ("/n" * 5001,), ("/",)], "path string")
    assert sorted((r["id"] or 0, r["outcome"]) for r in namespace.resolve(wanted, tree).collect()) == [(0, "missing"), (0, "root"), (4999, "found")]


def test_a_cycle_of_three_ends(spark):
    rows = [(1, 2, "a"), (2, 3, "b"), (3, 1, "c"), (4, 3, "d"), (5, None, "e"), (6, 5, "f")]
    tree = spark.createDataFrame(rows, "id bigint, parent_id bigint, name string")
    assert {r["id"]: r["root_id"] for r in namespace.roots(tree).collect()} == {1: None, 2: None, 3: None, 4: None, 5: 5, 6: 5}
    assert {r["id"]: r["depth"] for r in namespace.parents_first(tree).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 2}


def test_too_few_volumes_fail(spark):
    volumes = spark.createDataFrame(
        [(1, 1, True, True, True, False, False, False, 100, 0)], "volume_id bigint, device_group int, started boolean, enabled boolean, healthy boolean, read_only boolean, draining boolean, deleted boolean, bytes_free bigint, bytes_pending bigint"
    )
    with pytest.raises(Exception, match="fewer writable volumes"):
        placement.plan(volumes, 2, 1, "s").collect()


LOG = "line bigint, op string, id bigint, cid bigint, name string, size bigint, pr boolean, pw boolean, dp boolean"


def test_replay(spark):
    rows = [(1, "container", 1, None, "c", None), (2, "put", 5, 1, "a", 3), (3, "del", 5, None, None, None), (4, "put", 5, 1, "b", 4), (5, "container", 2, None, "d", None), (6, "del", 2, None, None, None), (7, "put", 6, 1, "z", 1), (8, "del", 6, None, None, None)]
    log = spark.createDataFrame([(*r, None, None, None) for r in rows], LOG)
    found = {r["id"]: (r["kind"], r["name"], r["parked"]) for r in replay.replay(log).collect()}
    assert found == {1: ("container", "c", False), 5: ("put", "b", False), 6: ("put", "z", True)}


def test_policies_only_close(spark):
    log = spark.createDataFrame([(1, "policy", 1, None, None, None, False, True, True), (2, "policy", 1, None, None, None, True, True, False)], LOG)
    initial = spark.createDataFrame([(1, True, False, False)], "id bigint, pr boolean, pw boolean, dp boolean")
    assert tuple(replay.fold_policy(log, initial).first()) == (1, False, False, True, 4)


def test_snapshot_verdicts(spark, tmp_path):
    containers = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, name string")
    objects = spark.createDataFrame([("9", "1", "x", 3), ("8", "77", "y", 4)], "id string, cid string, name string, size bigint")
    tables.write_snapshot(containers, objects, str(tmp_path / "s"))
    assert tuple(tables.snapshot_verdict(tables.read_records(spark, str(tmp_path / "s"))).first()) == (True, True, True, 1, 0)
    cut = tables.read_records(spark, str(tmp_path / "s")).filter("op <> 'end'")
    assert tables.snapshot_verdict(cut).first()["complete"] is False
    broken = objects.withColumn("name", F.lit("a\nb"))
    with pytest.raises(Exception, match="line break"):
        tables.write_snapshot(containers, broken, str(tmp_path / "t"))


def test_only_the_last_record_may_be_torn(spark):
    rows = spark.createDataFrame([(1, "put"), (2, None), (3, "put")], "line bigint, op string")
    assert tables.torn_tail(rows.filter("line < 3")).count() == 1
    with pytest.raises(Exception, match="does not parse"):
        tables.torn_tail(rows).collect()


def test_slice_files(spark, tmp_path):
    (tmp_path / "aa").mkdir()
    for name in ("0123456789abcdef01234567.4", "notes.txt", "0123456789abcdef01234567.99"):
        (tmp_path / "aa" / name).write_bytes(b"12345")
    found = tables.slice_files(spark, str(tmp_path)).collect()
    assert [(r["object_id"], r["slice_index"], r["length"]) for r in found] == [("0123456789abcdef01234567", 4, 5)]


def test_escalation_passes_a_cooldown():
    state, passed = events.dedupe_step(None, {"seconds": 0, "rank": 1})
    assert passed
    state, passed = events.dedupe_step(state, {"seconds": 10, "rank": 1})
    assert not passed
    state, passed = events.dedupe_step(state, {"seconds": 20, "rank": 2})
    assert passed and state == (20, 2)


def test_signals_arm_only_what_is_taken_up():
    state, acted = events.signal_step(None, {"seconds": 0, "pending": False, "count": 0, "taken": False})
    assert not acted
    state, acted = events.signal_step(state, {"seconds": 1, "pending": True, "count": 4, "taken": True})
    assert acted and state[1] == 4
    _, acted = events.signal_step(state, {"seconds": 10**6, "pending": True, "count": 4, "taken": True})
    assert not acted


def test_locked_accounts_are_not_looked_at():
    state = None
    for t in range(events.MAX_FAILURES):
        state, seen = events.login_step(state, {"seconds": t, "good": False})
        assert seen
    state, seen = events.login_step(state, {"seconds": 10, "good": True})
    assert not seen


def test_a_snapshot_altered_in_place_gives_way(spark, tmp_path):
    containers = spark.createDataFrame([("1", "a")], "id string, name string")
    objects = spark.createDataFrame([("9", "1", "x", 3)], "id string, cid string, name string, size bigint")
    whole, altered = str(tmp_path / "w"), str(tmp_path / "a")
    tables.write_snapshot(containers, objects, whole)
    spark.read.text(whole).select(F.regexp_replace("value", '"name":"x"', '"name":"y"').alias("value")).write.text(altered)
    used, report = tables.usable_snapshot(spark, [str(tmp_path / "none"), altered, whole])
    assert used == whole
    assert [(r["place"], r["complete"], r["sum_holds"], r["used"]) for r in report.orderBy("place").collect()] == [(1, False, False, False), (2, True, False, False), (3, True, True, True)]
    assert tables.usable_snapshot(spark, [altered])[0] is None


def test_upsert_unsets_and_inserts(spark):
    old = spark.createDataFrame([(1, "a", "blocked", 5), (2, "b", "blocked", 6)], "k int, name string, status string, first int")
    new = spark.createDataFrame([(1, None, None, 9), (3, "c", "new", 9)], "k int, name string, status string, first int")
    found = {r["k"]: tuple(r)[1:] for r in tables.upsert(old, new, "k", unset=("status",), on_insert=("first",)).collect()}
    assert found == {1: ("a", None, 5), 2: ("b", "blocked", 6), 3: ("c", "new", 9)}


def test_rows_retire_only_with_a_copy(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, True), (1, True), (2, False), (3, None)], "k int, gone boolean")
    left = tables.archived(rows, F.col("gone"), str(tmp_path / "archive"))
    assert sorted(r["k"] for r in left.collect()) == [2, 3] and spark.read.parquet(str(tmp_path / "archive")).count() == 2
    monkeypatch.setattr(type(rows.write), "parquet", lambda self, path, **_: self.text(f"{path}/elsewhere") if False else rows.limit(1).write.format("parquet").mode("append").save(path))
    with pytest.raises(RuntimeError, match="nothing is retired"):
        tables.archived(rows, F.col("gone"), str(tmp_path / "short"))


def test_an_id_that_is_not_there_fails(spark):
    rows = spark.range(3)
    assert tables.by_id(rows, "id", 2).count() == 1
    with pytest.raises(Exception, match="ENOENT"):
        tables.by_id(rows, "id", 7).collect()


def test_manifests_without_a_majority_fail(spark):
    rows = [(1, "a", None, None), (2, "b", None, None)]
    manifests = spark.createDataFrame(rows, "device int, identity string, completed_at timestamp, updated_at timestamp")
    with pytest.raises(Exception, match="majority"):
        replay.reconciled_manifest(manifests).collect()
    with pytest.raises(Exception, match="dated"):
        replay.reconciled_manifest(manifests.filter("device = 1")).collect()


def test_a_drain_ends_when_targets_are_full(spark):
    volumes = "volume_id bigint, device_group int, started boolean, enabled boolean, healthy boolean, read_only boolean, draining boolean, deleted boolean, bytes_free bigint, bytes_pending bigint"
    fleet = spark.createDataFrame([(1, 1, True, True, True, False, True, False, 0, 0), (2, 2, True, True, True, False, False, False, 25, 0), (3, 3, True, True, True, False, False, False, 10, 0)], volumes)
    slices = spark.createDataFrame([(i, 0, 1) for i in range(6)], "object_id bigint, slice_index int, volume_id bigint")
    objects = spark.createDataFrame([(i, 10, 1) for i in range(6)], "object_id bigint, size bigint, data_n bigint")
    after, left = placement.drained(slices, fleet, objects, 1)
    assert left[0] == 6 and left[-1] == 3
    assert sorted(r["volume_id"] for r in after.collect()) == [1, 1, 1, 2, 2, 3]
