"""Exact top-k search with vector-approximation files.

Vectors become whole numbers, floor(64 x) a component. The approximation of a vector is one byte for each component: the cell
of a grid that it falls into. Cells are ``CELL`` wide, or wider by the least power of two, kept with the vector, with which all
its cells fit a byte. So the file that is scanned has a byte a component. Three steps answer a block of queries:

1. Scan the approximations. The inner product of a query with the middles of the cells lies within half a cell, times
   the sum of the query's absolute components, of the exact one: these are the bounds. The kth largest lower bound over
   all vectors, from the k best of each task, is a threshold.
2. Scan them again and keep what has an upper bound that reaches its query's threshold.
3. Exact vectors are read in the order of their bounds: first the k best by upper bound; their kth exact score is a
   threshold, and of the others only those whose upper bound reaches it are read. Then the kth result is certain.

Equal vectors are one class; only the k + 1 smallest ids of a class can ever be among a query's k (one may be the
query's own), so a class of any size costs no more. Queries go out in blocks of ``BLOCK``, which bounds what is
broadcast; every block scans the approximations twice, in as many tasks as they have partitions.

Numbers: while every sum stays below 2^53, doubles are exact and Spark's own functions score. If one finite vector is too long for
that, bounds are widened by their rounding errors and scores are summed in integers of any length; they order exactly, and a score
that no long holds is returned as the nearest long.

Cases: vectors that are null, or hold a null or non-finite component, take no part; all other vectors do, however long; shorter
vectors count as filled up with zeros; ties go to the smaller id; a query with fewer than k candidates gets all; rows with a query's
own id aren't its candidates; of several vectors of a query's id the smallest, component by component, asks; a null id takes no part;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import python_ready, stash, unstash

K = 20
EVERY = 20
CELL = 2
BLOCK = 4096
STEP = 1024  # candidates compared at once
SCALE = 64
EXACT = float(1 << 53)
LONGEST = float(1 << 62) ** 4  # components beyond, which floats don't have, count as this much


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and v, whole numbers as array<double>, of the rows that take part."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))

    def whole(c: Column) -> Column:
        y = c.cast("double") * SCALE
        return F.when(F.abs(y) < EXACT, F.floor(F.when(F.abs(y) < EXACT, y)).cast("double")).otherwise(F.greatest(F.least(y, F.lit(LONGEST)), F.lit(-LONGEST)))

    return vectors.select("vec_id", F.when(fine, F.transform(x, whole)).alias("v")).filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull())


def classes(rows: DataFrame, k: int = K) -> DataFrame:
    """One row for each different vector: class_id (its smallest id), v and ids, its k + 1 smallest ids in order."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.distinct().withColumn("_rank", rank).filter(F.col("_rank") <= k + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("class_id"), "v", "ids")


def approximations(found: DataFrame) -> DataFrame:
    """class_id, members (how many ids are kept), width of a cell, and cells: a byte for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, cells = [], []
            for v in _vectors(batch.column("v")):
                width = float(CELL)
                while len(v) and (v.min() < -128 * width or v.max() >= 128 * width):
                    width *= 2
                widths.append(width)
                cells.append(np.floor(v / width).astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("class_id"), batch.column("members"), pa.array(widths, pa.float64()), pa.array(cells, pa.binary())], ["class_id", "members", "width", "cells"])

    return found.select("class_id", F.size("ids").alias("members"), "v").mapInArrow(run, "class_id bigint, members int, width double, cells binary")


def _vectors(column: pa.Array) -> list[np.ndarray]:
    limits = np.cumsum([0, *column.value_lengths().to_pylist()])
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)]


def _products(batches: Iterator[pa.RecordBatch], q: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of approximations with twice the lower and twice the upper bounds of the inner products of all queries (rows) with them."""
    dims, reach = q.shape[1], np.abs(q).sum(1)
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            raw = part.column("cells").to_pylist()
            cells = np.zeros((len(raw), dims))
            for i, c in enumerate(raw):
                cells[i, : len(c)] = np.frombuffer(c, np.int8)
            there = np.arange(dims)[None, :] < np.array([len(c) for c in raw])[:, None]
            width = part.column("width").to_numpy()
            middles = np.where(there, cells * (2 * width[:, None]) + (width[:, None] - 1), 0)
            most = reach.max(initial=0) * np.abs(middles).max(initial=0)
            kind = np.float32 if most < 1 << 24 else np.float64
            twice = (q.astype(kind) @ middles.T.astype(kind)).astype(np.float64)
            gap = reach[:, None] * (width - 1)[None, :]
            if most >= EXACT / 4:  # sums are rounded
                gap = gap * (1 + 1e-9) + (np.abs(q) @ np.abs(middles).T) * ((dims + 4) * 2.0**-51)
            yield part, twice - gap, twice + gap


def thresholds(approx: DataFrame, shared: Broadcast, k: int) -> dict[int, float]:
    """For each query twice the (k + 1)th largest lower bound; queries with fewer vectors have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best, several = np.full((len(q), k + 1), -np.inf), np.zeros((len(q), k + 1), np.int64)
        for part, low, _ in _products(batches, q):
            members = np.broadcast_to(part.column("members").to_numpy().astype(np.int64), low.shape)
            if low.shape[1] > k + 1:  # a class has a member at least, so k + 1 classes are enough
                some = np.argpartition(low, low.shape[1] - k - 1, axis=1)[:, -(k + 1) :]
                low, members = np.take_along_axis(low, some, 1), np.take_along_axis(members, some, 1)
            best, several = np.concatenate([best, low], axis=1), np.concatenate([several, members], axis=1)
            order = np.argsort(-best, axis=1, kind="stable")[:, : k + 1]
            best, several = np.take_along_axis(best, order, 1), np.take_along_axis(several, order, 1)
        row, column = np.nonzero(several)
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(best[row, column]), pa.array(several[row, column])], ["query_id", "low", "members"])

    so_far = F.sum("members").over(Window.partitionBy("query_id").orderBy(F.desc("low")))  # k + 1 rows a query and task
    found = approx.mapInArrow(run, "query_id bigint, low double, members bigint").withColumn("_n", so_far).filter(F.col("_n") >= k + 1)
    return {r["query_id"]: r["low"] for r in found.groupBy("query_id").agg(F.max("low").alias("low")).collect()}  # a row a query


def survivors(approx: DataFrame, queries: list, dims: int, k: int) -> DataFrame:
    """query_id, class_id, members and high (the upper bound): what may be among a query's k best, by bounds alone."""
    ids = np.array([r["vec_id"] for r in queries], np.int64)
    matrix = np.zeros((len(queries), dims))
    for i, r in enumerate(queries):
        matrix[i, : len(r["v"])] = r["v"]
    context = approx.sparkSession.sparkContext
    shared = context.broadcast((ids, matrix))  # BLOCK vectors at most
    sure = thresholds(approx, shared, k)
    limits = context.broadcast(np.array([sure.get(int(i), -np.inf) for i in ids]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = shared.value
        for part, _, high in _products(batches, q):
            qi, ci = np.nonzero(high >= limits.value[:, None])
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[qi]), pa.array(part.column("class_id").to_numpy()[ci], pa.int64()), pa.array(part.column("members").to_numpy()[ci], pa.int32()), pa.array(high[qi, ci] / 2, pa.float64())], ["query_id", "class_id", "members", "high"]
            )

    return approx.mapInArrow(run, "query_id bigint, class_id bigint, members int, high double")


def _long_scores(pairs: DataFrame) -> DataFrame:
    """Scores of vectors of any length: the nearest long, a double that is not above, and bytes that order as the score does."""
    half, most = 1 << 1023, (1 << 63) - 1
    names = ["query_id", "class_id", "members", "ids", "score", "low", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = [sum(int(a) * int(b) for a, b in zip(x, y, strict=False)) for x, y in zip(_vectors(batch.column("q")), _vectors(batch.column("v")), strict=True)]
            columns = [pa.array([max(-most - 1, min(most, s)) for s in exact], pa.int64()), pa.array([math.nextafter(float(s), -math.inf) for s in exact]), pa.array([(s + half).to_bytes(128, "big") for s in exact], pa.binary())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:4]], *columns], names)

    return pairs.select(*names[:4], "q", "v").mapInArrow(run, "query_id bigint, class_id bigint, members int, ids array<bigint>, score bigint, low double, key binary")


def _short_scores(pairs: DataFrame) -> DataFrame:
    """The same while doubles are exact, by Spark's functions: the score is its own key."""
    exact = F.aggregate(F.arrays_zip(F.col("q").alias("a"), F.col("v").alias("b")), F.lit(0.0), lambda s, x: s + F.coalesce(x["a"], F.lit(0.0)) * F.coalesce(x["b"], F.lit(0.0)))
    score = exact.cast("long")
    return pairs.select("query_id", "class_id", "members", "ids", score.alias("score"), exact.alias("low"), score.alias("key"))


def search(vectors: DataFrame, every: int = EVERY, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of every query, the rows whose vec_id is divisible by ``every``."""
    python_ready(vectors.sparkSession)
    found = stash(classes(whole_vectors(vectors), k), "va-exact")
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    approx = stash(approximations(found.repartition(spread, "class_id")), "va-cells")
    largest = F.max(F.greatest(F.array_max(F.transform("v", lambda c: F.abs(c))), F.lit(0.0)))
    seen = found.agg(F.max(F.size("v")).alias("dims"), largest.alias("most")).first()
    dims, short = seen["dims"] or 0, (seen["dims"] or 0) * (seen["most"] or 0.0) ** 2 < EXACT
    asked = whole_vectors(vectors).filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = stash(asked, "va-queries")
    blocks = max(1, -(-asked.count() // block))
    results = None
    for b in range(blocks):  # a block's queries are a bounded hash share of all
        mine = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        one = _answer(found, approx, mine, dims, k, short)
        results = one if results is None else results.unionByName(one)
    unstash(approx)
    return results


def _answer(found: DataFrame, approx: DataFrame, queries: DataFrame, dims: int, k: int, short: bool) -> DataFrame:
    rows = queries.collect()
    bounds = stash(survivors(approx, rows, dims, k), "va-bounds")
    ahead = F.sum("members").over(Window.partitionBy("query_id").orderBy(F.desc("high"), "class_id"))
    ordered = stash(bounds.withColumn("ahead", ahead - F.col("members")), "va-order")
    unstash(bounds)
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def read(some: DataFrame) -> DataFrame:
        pairs = some.join(found.select("class_id", "v", "ids"), "class_id").join(F.broadcast(asked), "query_id")
        return _short_scores(pairs) if short else _long_scores(pairs)

    first = stash(read(ordered.filter(F.col("ahead") <= k)), "va-first")
    # the score that k other vectors are sure to reach: one more than k members, as one may be the query's own
    so_far = F.sum("members").over(Window.partitionBy("query_id").orderBy(F.desc("key"), "class_id"))
    kth = first.withColumn("_so_far", so_far).groupBy("query_id").agg(F.max(F.when(F.col("_so_far") >= k + 1, F.col("low"))).alias("kth"))
    rest = ordered.filter(F.col("ahead") > k).join(F.broadcast(kth), "query_id").filter(F.col("kth").isNull() | (F.col("high") >= F.col("kth"))).drop("kth")
    scored = first.unionByName(read(rest))
    each = scored.select("query_id", "score", "key", F.explode("ids").alias("vec_id")).filter(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SEARCH_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
