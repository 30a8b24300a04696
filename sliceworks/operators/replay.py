"""Snapshot and journal folded into the present namespace, and what may be trusted of them.

Rows are ordered by ``line``, which numbers records across segments; the last put, container or del of an id decides. Policy flags fold apart: a flag
of the log can only close a bucket further, so a flag once closed stays so. Each fold is one shuffle by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POLICY_FLAGS = ("pr", "pw", "dp")


def replay(log: DataFrame) -> DataFrame:
    """id, kind, name, cid, size and parked of what the log leaves: objects whose last word is del are parked, containers whose last word is del are gone.

    log: line, op (put, container, del, policy), id, cid, name, size.
    """
    last_word = F.max_by("op", F.when(F.col("op") != "policy", F.col("line")))
    made = F.col("op").isin("put", "container")
    state = log.groupBy("id").agg(
        last_word.alias("last"), F.max_by(F.struct("op", "name", "cid", "size"), F.when(made, F.col("line"))).alias("made")
    )
    present = state.filter(F.col("made").isNotNull())
    kept = present.filter(~((F.col("last") == "del") & (F.col("made.op") == "container")))
    return kept.select("id", F.col("made.op").alias("kind"), F.col("made.name").alias("name"), F.col("made.cid").alias("cid"), F.when(F.col("made.op") == "put", F.col("made.size")).alias("size"), (F.col("last") == "del").alias("parked"))


def fold_policy(log: DataFrame, initial: DataFrame) -> DataFrame:
    """Per bucket the flags after the log and how many changes were refused.

    Opening is refused: pr or pw true unless it is true already, dp false if it is true now. So a flag's history is
    decided by whether any record has closed it, and by what came before.
    initial: id, pr, pw, dp. Records of unknown buckets are ignored.
    """
    changes = log.filter("op = 'policy'").select("id", "line", *[F.col(c).alias(f"to_{c}") for c in POLICY_FLAGS])
    both = changes.join(initial.select("id", *POLICY_FLAGS), "id")
    before = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    shut = {"pr": ~F.col("to_pr"), "pw": ~F.col("to_pw"), "dp": F.col("to_dp")}
    refused = F.lit(0)
    for c in POLICY_FLAGS:
        closed_before = F.coalesce(F.max(shut[c].cast("int")).over(before), F.lit(0)) == 1
        now_open = (F.col(c) if c != "dp" else ~F.col(c)) & ~closed_before
        wants_open = F.col(f"to_{c}") if c != "dp" else ~F.col(f"to_{c}")
        refused = refused + (wants_open & ~now_open).cast("int")
    judged = both.withColumn("refused", refused)
    summed = judged.groupBy("id").agg(*[F.max(shut[c].cast("int")).alias(f"shut_{c}") for c in POLICY_FLAGS], F.sum("refused").alias("refused"))
    out = initial.select("id", *POLICY_FLAGS).join(summed, "id", "left")

    def after(c: str) -> Column:
        closed = F.coalesce(F.col(f"shut_{c}"), F.lit(0)) == 1
        return (F.col(c) & ~closed if c != "dp" else F.col(c) | closed).alias(c)

    return out.select("id", *[after(c) for c in POLICY_FLAGS], F.coalesce("refused", F.lit(0)).alias("refused"))


def keep_with_slices(names: DataFrame, slices: DataFrame, snapshot_ids: DataFrame) -> DataFrame:
    """Each put's fate: restored if it has slices (parked ones too: orphans are safer than losses), else missing if the snapshot named it, else dropped."""
    there = slices.select(F.col("object_id").alias("id")).distinct().withColumn("_s", F.lit(True))
    named = snapshot_ids.select("id").distinct().withColumn("_n", F.lit(True))
    fate = F.when(F.col("_s").isNotNull(), "restored").when(F.col("parked"), "deleted").when(F.col("_n").isNotNull(), "missing").otherwise("dropped")
    return names.filter("kind = 'put'").join(there, "id", "left").join(named, "id", "left").withColumn("fate", fate).drop("_s", "_n")


def dangling(rows: DataFrame) -> DataFrame:
    """Rows whose container the rows don't hold."""
    known = rows.filter("kind = 'container'").select(F.col("id").alias("cid"))
    return rows.filter(F.col("cid").isNotNull()).join(known, "cid", "left_anti")


def coherent(log: DataFrame) -> DataFrame:
    """``log`` with whether each record has what its op needs."""
    has = F.col("id").isNotNull()
    ok = (
        F.when(F.col("op") == "put", has & F.col("cid").isNotNull() & F.col("name").isNotNull() & (F.col("size") >= 0))
        .when(F.col("op") == "container", has & F.col("name").isNotNull())
        .when(F.col("op") == "del", has)
        .when(F.col("op") == "policy", has & (F.col("pr").isNotNull() | F.col("pw").isNotNull() | F.col("dp").isNotNull()))
        .otherwise(F.lit(False))
    )
    return log.withColumn("coherent", F.coalesce(ok, F.lit(False)))


def manifest_vote(manifests: DataFrame) -> DataFrame:
    """identity, votes and whether it has a strict majority of all manifests, silent ones included."""
    counted = manifests.groupBy("identity").agg(F.count(F.lit(1)).alias("votes"))
    whole = manifests.agg(F.count(F.lit(1)).alias("total"))
    return counted.filter(F.col("identity").isNotNull()).join(F.broadcast(whole)).select("identity", "votes", (2 * F.col("votes") > F.col("total")).alias("majority"))


def reconciled_manifest(manifests: DataFrame) -> DataFrame:
    """One row: the identity of a strict majority of the manifests that have one, how many agree, how many are foreign or silent, whether those
    that agree are a majority of all, the device of the newest volume table and that of the newest snapshot, each among those that agree.

    Fails without such a majority, and if no manifest that agrees is dated. manifests: device, identity, completed_at, updated_at.
    """
    votes = manifest_vote(manifests.filter(F.col("identity").isNotNull()))
    first = votes.agg(F.max_by(F.struct("identity", "majority"), F.struct("votes", "identity")).alias("v")).select("v.identity", "v.majority")
    ours = F.col("identity") == F.col("chosen")
    one = manifests.join(F.broadcast(first.select(F.col("identity").alias("chosen"), "majority"))).agg(  # one row
        F.first("chosen").alias("chosen"), F.first("majority").alias("majority"), F.count_if(ours).alias("agreeing"), F.count_if(F.col("identity").isNotNull() & ~ours).alias("foreign"), F.count_if(F.col("identity").isNull()).alias("silent"),
        F.max_by("device", F.when(ours & F.col("updated_at").isNotNull(), F.struct("updated_at", "device"))).alias("newest_table"),
        F.max_by("device", F.when(ours & F.col("completed_at").isNotNull(), F.struct("completed_at", "device"))).alias("newest_snapshot"),
    )
    fine = F.when(~F.coalesce("majority", F.lit(False)), F.raise_error(F.lit("no identity holds a majority of the disks that answered"))).when(F.col("newest_table").isNull(), F.raise_error(F.lit("no manifest of this array is dated"))).otherwise(F.col("chosen"))
    return one.select(fine.alias("identity"), "agreeing", "foreign", "silent", (2 * F.col("agreeing") > F.col("agreeing") + F.col("foreign") + F.col("silent")).alias("complete"), "newest_table", "newest_snapshot")


def restore_summary(names: DataFrame, slices: DataFrame, verdicts: DataFrame, snapshot_ids: DataFrame, existing: DataFrame, declined: DataFrame) -> DataFrame:
    """One row of a restore's counters.

    names: what ``replay`` leaves. verdicts: object_id, verdict (deferred, below-quorum or other). existing: id of the rows that the database
    held before. declined: id, refused. Objects that can't be judged keep their names; those without a readable quorum, and those without slices, don't.
    """
    fates = keep_with_slices(names, slices, snapshot_ids).join(verdicts.select(F.col("object_id").alias("id"), "verdict"), "id", "left")
    there = F.col("fate") == "restored"
    lost, unsure = F.coalesce(F.col("verdict") == "below-quorum", F.lit(True)), F.coalesce(F.col("verdict") == "deferred", F.lit(False))
    kept = fates.filter(there & (unsure | ~lost)).select("id").unionByName(names.filter("kind = 'container'").select("id"))
    objects = fates.agg(
        F.count_if(~F.col("parked") | there).alias("objects_in_namespace"), F.count_if(there & ~unsure & ~lost).alias("objects_restored"), F.count_if(F.col("fate") == "missing").alias("objects_missing"),
        F.count_if(there & ~unsure & lost).alias("objects_unrecoverable"), F.count_if(there & unsure).alias("objects_indeterminate"), F.count_if(there & F.col("parked")).alias("dels_ignored"), F.count_if(F.col("fate") == "dropped").alias("puts_dropped"),
    )
    one = [
        names.agg(F.count_if(F.col("kind") == "container").alias("containers")), existing.join(kept.distinct(), "id", "left_anti").agg(F.count(F.lit(1)).alias("rows_pruned")), declined.agg(F.coalesce(F.sum("refused"), F.lit(0)).cast("bigint").alias("policies_declined")),
    ]
    for row in one:
        objects = objects.join(F.broadcast(row))  # one row each
    return objects


def best_manifest(manifests: DataFrame) -> DataFrame:
    """The manifest to trust: a usable snapshot first, then the latest; unreadable times never win. manifests: device, usable, completed_at, updated_at."""
    key = F.struct(F.col("usable").cast("int"), F.coalesce(F.when(F.col("usable"), F.col("completed_at")), F.col("updated_at")), F.col("device"))
    dated = F.coalesce(F.when(F.col("usable"), F.col("completed_at")), F.col("updated_at")).isNotNull()
    return manifests.agg(F.max_by("device", F.when(dated, key)).alias("device"))
