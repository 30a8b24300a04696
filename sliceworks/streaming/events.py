"""Streams: counter changes, faults, notifications, device signals, logins, device states.

State is kept by key and holds two or three numbers. Within a micro-batch a key's rows are put in order of time; how many
there are is bounded by what a trigger reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_folder, ship

COOLDOWN = 300
SIGNAL_COOLDOWN = 6 * 3600
MAX_FAILURES = 5
LOCKOUT = 900


def read_events(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """A stream of a table's files. The path is spelled as a pattern of itself, so that a table of one file is taken as well as a folder."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and return what it wrote. Each micro-batch overwrites its own folder, so a repeated one leaves no second copy."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{_ddl(stream)}, batch bigint").parquet(f"{base}/out")


def poll(spark: SparkSession, log: str, base: str, collect: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Take in what a folder of log lines has got since the last poll that succeeded, and return all that was collected so far.

    The stream's checkpoint below ``base`` is the cursor. A poll that fails leaves it where it was, so the next one covers the same lines again; what it had
    collected is overwritten, as each batch has its own folder.
    """

    def take(batch: DataFrame, number: int) -> None:
        collect(batch).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = spark.readStream.text(log).writeStream.foreachBatch(take).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def counters(changes: DataFrame, key: str, value: str) -> DataFrame:
    """Totals by key, emitted when they change. Read the last batch of each key."""
    return changes.groupBy(key).agg(F.sum(value).cast("bigint").alias("total"))


def latest(table: DataFrame, key: str) -> DataFrame:
    """Of each key the row of its last batch."""
    value = [c for c in table.columns if c not in (key, "batch")]
    return table.groupBy(key).agg(F.max_by(F.struct(*value), "batch").alias("r")).select(key, "r.*")


def fault_stream(observations: DataFrame) -> DataFrame:
    """Faults so far, emitted when they change."""
    return observations.groupBy("key").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"))


def windowed_faults(observations: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Faults by tumbling window and source; windows close when the watermark passes."""
    return observations.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "source").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "source", "n")


def bursts(observations: DataFrame, gap: str = "3 seconds", late: str = "10 minutes") -> DataFrame:
    """Observations of a device that follow each other within ``gap`` are one burst, with the last state."""
    return (
        observations.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "device").agg(F.count(F.lit(1)).alias("n"), F.max_by("state", "ts").alias("state")).select("device", F.col("w.start").alias("start"), "n", "state")
    )


Fold = Callable[[tuple | None, dict[str, Any]], tuple[tuple, bool]]


def folded(rows: DataFrame, key: str, columns: list[str], state: str, step: Fold) -> DataFrame:
    """event_id and ``accepted`` of each row, decided by a state that is kept by key. rows: ``key``, event_id, seconds and ``columns``."""

    def run(key_value: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        now = kept.get if kept.exists else None
        frame = pd.concat(list(frames), ignore_index=True).sort_values(["seconds", "event_id"])
        out = []
        for row in frame[["event_id", "seconds", *columns]].to_dict("records"):
            now, accepted = step(now, row)
            out.append((row["event_id"], accepted))
        if now is not None:
            kept.update(now)
        yield pd.DataFrame(out, columns=["event_id", "accepted"])

    ship(rows.sparkSession)
    return rows.select(key, "event_id", "seconds", *columns).groupBy(key).applyInPandasWithState(run, "event_id bigint, accepted boolean", state, "append", GroupStateTimeout.NoTimeout)


def dedupe_step(last: tuple | None, row: dict[str, Any]) -> tuple[tuple, bool]:
    """A notification passes after the cooldown, or at once if it is more severe than the last that passed. State: seconds, rank."""
    if last is not None and row["seconds"] - last[0] < COOLDOWN and row["rank"] <= last[1]:
        return last, False
    return (int(row["seconds"]), int(row["rank"])), True


def signal_step(last: tuple | None, row: dict[str, Any]) -> tuple[tuple, bool]:
    """A signal acts unless the volume acted within the cooldown; a pending count must also exceed the highest yet; an action that isn't taken up arms nothing. State: seconds, high water."""
    high = last[1] if last is not None else 0
    at = last[0] if last is not None else None
    if row["pending"] and row["count"] <= high:
        return (at if at is not None else -(10**12), high), False
    if at is not None and row["seconds"] - at < SIGNAL_COOLDOWN:
        return (at, high), False
    if not row["taken"]:
        return (at if at is not None else -(10**12), high), False
    return (int(row["seconds"]), int(row["count"]) if row["pending"] else high), True


def login_step(last: tuple | None, row: dict[str, Any]) -> tuple[tuple, bool]:
    """A login is looked at unless the account is locked; so many failures in a row lock it. State: failures, locked until."""
    failures, until = last if last is not None else (0, -(10**12))
    if row["seconds"] < until:
        return (failures, until), False
    if row["good"]:
        return (0, -(10**12)), True
    failures += 1
    if failures >= MAX_FAILURES:
        return (0, int(row["seconds"]) + LOCKOUT), True
    return (failures, until), True


def notifications(rows: DataFrame) -> DataFrame:
    return folded(rows, "key", ["rank"], "at bigint, rank bigint", dedupe_step)


def signals(rows: DataFrame) -> DataFrame:
    return folded(rows, "volume_id", ["pending", "count", "taken"], "at bigint, high bigint", signal_step)


def logins(rows: DataFrame) -> DataFrame:
    return folded(rows, "account", ["good"], "failures bigint, until bigint", login_step)
