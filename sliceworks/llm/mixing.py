"""Mixing sources to target weights.

The words of each source are summed; a water-filling rule turns the sources' weights into targets; a source's
repetition rate is its target over its size. Every document is then taken floor(rate) times, and once more if a
number in [0, 1) that its id and the seed decide lies below the rate's fraction.

Only the table with one row a source is ordered as a whole. It joins the documents by broadcast if a count has shown
that it has at most ``BROADCAST_SOURCES`` rows, else by a shuffled join, whose hot partitions Spark splits.

Cases: a null text has size 0; a null source is a source of its own, last in order; a source without words has target
and rate 0, so its documents are not taken; repeated rows share their draw; a null id draws as the text 'null'; an
empty table gives an empty result; other columns of any name pass through. Sources are ordered in one task, as a table of one
short row a source; documents never are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stash, word_count

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"
BROADCAST_SOURCES = 50_000


def source_rates(sized: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row a source: source, source_size, target and rate, from rows of source and size.

    Sources in code-point order, null last, weigh ``weights``, repeating. They share all words by weight; a share stops
    at ``cap`` times its source's size, and the excess goes to the others by weight. In order of size over weight the
    sources that stop come first, so one pass of prefix sums decides who stops, in whole numbers.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    picks = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (rank % len(weights) + 1).cast("int"))
    filling = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        sizes.withColumn("w", picks)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("before", F.coalesce(F.sum(F.col("source_size") * cap).over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_w", F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("stops", (F.col("total") - F.col("before")) * F.col("w") >= F.col("source_size") * cap * F.col("open_w"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("source_size") * cap)).over(everything), F.lit(0)))
        .withColumn("left_w", F.sum(F.when(~F.col("stops"), F.col("w"))).over(everything))
    )
    target = F.when(F.col("stops"), (F.col("source_size") * cap).cast("double")).otherwise(F.col("left").cast("double") * F.col("w").cast("double") / F.col("left_w").cast("double"))
    return filled.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )


def draw(rows: DataFrame, rates: DataFrame, seed: str = SEED) -> DataFrame:
    """``rows``, which have a doc_id and a source, with source_size, target and copies."""
    rates = stash(rates, "mix-rates").withColumnRenamed("source", "of")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    uniform = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
    copies = F.floor("rate") + (uniform < F.col("rate") - F.floor("rate")).cast("int")
    return rows.join(rates, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", copies.cast("int")).drop("of", "rate")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row as often as it is taken."""
    rates = source_rates(docs.select("source", word_count(F.col("text")).alias("size")), weights, cap)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("doc_id"), docs["source"].alias("source"))
    drawn = draw(rows, rates, seed).filter("copies > 0")
    again = drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return again.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target and taken. Words are counted once, into a narrow table."""
    sized = stash(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    drawn = draw(sized, source_rates(sized))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


REPORT_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source),
w AS (SELECT source, s, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM g),
p AS (SELECT *, sum(s) OVER () AS total,
        coalesce(sum(s * 3) OVER (ORDER BY s::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(w) OVER (ORDER BY s::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM w),
c AS (SELECT *, (total - before) * w >= s * 3 * open_w AS stops FROM p),
t AS (SELECT source, s, CASE WHEN stops THEN (s * 3)::DOUBLE ELSE
        (total - coalesce(sum(CASE WHEN stops THEN s * 3 END) OVER (), 0))::DOUBLE * w::DOUBLE / (sum(CASE WHEN NOT stops THEN w END) OVER ())::DOUBLE END AS target FROM c),
r AS (SELECT *, CASE WHEN s > 0 THEN target / s ELSE 0.0 END AS rate FROM t),
u AS (SELECT d.doc_id, d.size, r.s, r.target, r.rate,
        (('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0 AS x
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, s AS source_size, target,
  (size * (floor(rate)::BIGINT + CASE WHEN x < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM u
"""
