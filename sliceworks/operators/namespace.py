"""The container tree: roots, paths, buckets, listings. A container with no parent is a bucket.

Walks double their step each round (a container's pointer becomes its pointer's pointer), so a tree of depth d takes
log2(d) joins, however deep it is; every round is a written table. A round in which no container reaches its top leaves only
cycles and what hangs below them, since of what is still on its way the nearest always arrives; so walks end by themselves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder


def materialise(df: DataFrame) -> DataFrame:
    """The rows, written to the session's checkpoint folder."""
    path = f"{shared_folder(df.sparkSession)}/sliceworks-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def climbed(containers: DataFrame, named: bool = False) -> DataFrame:
    """id, top (the highest known ancestor, null for cycles and what hangs below them), depth below it, from 1 on, and, if ``named``, the path of names from it down."""
    known = containers.select(F.col("id").alias("_id"))
    name = F.concat(F.lit("/"), F.col("name")) if named else F.lit("")
    found = F.col("_id").isNotNull()
    state = containers.join(known, containers["parent_id"] == F.col("_id"), "left").select("id", F.when(found, F.col("parent_id")).alias("up"), F.when(~found, F.col("id")).alias("top"), F.lit(1).cast("bigint").alias("depth"), name.alias("path"))
    state = materialise(state)
    open_rows = state.filter("top IS NULL").count()
    while open_rows:
        above = state.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("top").alias("_top"), F.col("depth").alias("_depth"), F.col("path").alias("_path"))
        going = state.filter("top IS NULL").join(above, F.col("up") == F.col("_id"))
        moved = going.select("id", F.when(F.col("_top").isNull(), F.col("_up")).alias("up"), F.col("_top").alias("top"), (F.col("depth") + F.col("_depth")).alias("depth"), F.concat("_path", "path").alias("path"))
        state = materialise(state.filter("top IS NOT NULL").unionByName(moved))
        left = state.filter("top IS NULL").count()
        if left == open_rows:
            break
        open_rows = left
    return state.select("id", "top", "depth", *(["path"] if named else []))


def roots(containers: DataFrame) -> DataFrame:
    """id, root_id (null for orphans, cycles and what hangs below them) and top_id, the highest known ancestor (null only for cycles)."""
    bucket = containers.filter(F.col("parent_id").isNull()).select(F.col("id").alias("_root"))
    return climbed(containers).join(bucket, F.col("top") == F.col("_root"), "left").select("id", F.col("_root").alias("root_id"), F.col("top").alias("top_id"))


def backfill_buckets(containers: DataFrame) -> DataFrame:
    """id and bucket_id: known ones stay, others take their root's id."""
    return containers.select("id", "known_bucket").join(roots(containers), "id").select("id", F.coalesce("known_bucket", "root_id").alias("bucket_id"), (F.col("known_bucket").isNull() & F.col("root_id").isNotNull()).alias("filled"))


def paths(containers: DataFrame) -> DataFrame:
    """id, path, depth and bucket_id of every container that a bucket reaches."""
    bucket = containers.filter(F.col("parent_id").isNull()).select(F.col("id").alias("bucket_id"))
    return climbed(containers, named=True).join(bucket, F.col("top") == F.col("bucket_id")).select("id", "path", F.col("depth").cast("int").alias("depth"), "bucket_id")


def resolve(wanted: DataFrame, containers: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """For each path: the container it names, its bucket, and an outcome: found, root, file (a file stands where a container should) or missing."""
    known = paths(containers)
    clean = wanted.withColumn("_p", F.concat(F.lit("/"), F.array_join(F.filter(F.split("path", "/"), lambda x: x != ""), "/")))
    joined = clean.join(known.select(F.col("path").alias("_p"), "id", "bucket_id"), "_p", "left")
    if objects is None:
        outcome = F.when(F.col("_p") == "/", "root").when(F.col("id").isNotNull(), "found").otherwise("missing")
        return joined.withColumn("outcome", outcome).drop("_p")
    files = known.select(F.col("id").alias("container_id"), F.col("path").alias("_folder")).join(objects.select("container_id", "name"), "container_id").select(F.concat_ws("/", "_folder", "name").alias("_p"), F.lit(True).alias("_file"))
    joined = joined.join(files.distinct(), "_p", "left")
    outcome = F.when(F.col("_p") == "/", "root").when(F.col("id").isNotNull(), "found").when(F.col("_file"), "file").otherwise("missing")
    return joined.withColumn("outcome", outcome).drop("_p", "_file")


def objects_by_path(wanted: DataFrame, containers: DataFrame, objects: DataFrame) -> DataFrame:
    """Each path's object: its container by all but the last part, its name by the last. Paths without an object are left out.

    Objects get their folder's path first, and meet the paths by folder and name at once: containers may share a path, and a folder's namesakes alone say nothing.
    """
    parts = wanted.select("path", F.filter(F.split("path", "/"), lambda x: x != "").alias("_parts")).filter(F.size("_parts") > 1)
    split = parts.select("path", F.concat(F.lit("/"), F.array_join(F.slice("_parts", 1, F.size("_parts") - 1), "/")).alias("_folder"), F.element_at("_parts", -1).alias("name"))
    folders = paths(containers).select(F.col("path").alias("_folder"), F.col("id").alias("container_id"))
    placed = objects.select("object_id", "container_id", "name").join(folders, "container_id")
    return split.join(placed, ["_folder", "name"]).select("path", "object_id", "container_id")


def children(containers: DataFrame, objects: DataFrame, parent: int) -> DataFrame:
    """Containers and objects directly below a container."""
    inner = containers.filter(F.col("parent_id") == parent).select("id", "name", F.lit(True).alias("is_container"))
    files = objects.filter(F.col("container_id") == parent).select(F.col("object_id").alias("id"), "name", F.lit(False).alias("is_container"))
    return inner.unionByName(files)


def page(entries: DataFrame, after: str | None, limit: int = 200) -> DataFrame:
    """A page by name, with has_more on every row; limit is held to 1..1000."""
    limit = max(1, min(1000, limit))
    rows = entries if after is None else entries.filter(F.col("name") > after)
    some = rows.orderBy("name", "id").limit(limit + 1)  # one more row than shown
    numbered = some.withColumn("_n", F.row_number().over(Window.orderBy("name", "id"))).withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > limit)
    return numbered.filter(F.col("_n") <= limit).drop("_n")


def missing_containers(files: DataFrame, containers: DataFrame) -> DataFrame:
    """The folders that paths of files need and that don't exist, parents first: path, depth."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    prefixes = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))))
    wanted = files.select(F.explode(prefixes).alias("path")).distinct()
    return wanted.join(paths(containers).select("path"), "path", "left_anti").withColumn("depth", F.size(F.split("path", "/")) - 1)


def parents_first(containers: DataFrame) -> DataFrame:
    """id, parent_id and depth, by which parents precede children; depth 0 for what no bucket reaches."""
    return containers.select("id", "parent_id").join(paths(containers).select("id", "depth"), "id", "left").select("id", "parent_id", F.coalesce("depth", F.lit(0)).alias("depth"))
