"""Results and shapes of plans that small tables alone do not show."""

import pytest
from pyspark.sql import functions as F

from sliceworks.functions import scalars as S
from sliceworks.plans import catalog


@pytest.mark.parametrize(
    "n,text",
    [(1023, "1023 b"), (1024, "1.00 KB"), (203904, "199.12 KB"), (203914, "199.13 KB"), (1152, "1.12 KB"), (1408, "1.38 KB"), (1048575, "1024.00 KB"), ((1 << 30) * 3 // 8 * 3, "1.12 GB"), (1 << 50, "1024.00 TB")],
)
def test_bytes_round_half_to_even(spark, n, text):
    assert spark.range(1).select(S.format_bytes(F.lit(n).cast("bigint")).alias("x")).first()["x"] == text
    assert text.endswith(("b", "TB")) or text[:-3] == f"{n / 1024 ** {'KB': 1, 'MB': 2, 'GB': 3}[text[-2:]]:.2f}"


def test_chunks_of_a_long_body_are_whole(spark, tmp_path):
    """41,000 bytes are 410 chunks, more than the 401 that the query's SQL numbers."""
    spark.createDataFrame([(1, "x" * 40_999 + "y")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["sca_23_chunk_sums"](spark, str(tmp_path))
    assert [tuple(r) for r in found.agg(F.count(F.lit(1)), F.max("k"), F.count_distinct("md5")).collect()] == [(410, 409, 2)]


def test_whole_sums_keep_every_row(spark, tmp_path):
    """Rows without text, empty ones and ones that share an id or have none each keep their sum."""
    from oracle import connect, rows

    long = "".join(chr(97 + i % 26) for i in range(9_000))
    texts = [(1, None), (2, ""), (3, long), (3, long), (3, long[::-1]), (4, None), (4, ""), (4, "\u00e9\x00" * 4_096), (None, "x"), (None, long), (None, None), (5, "y" * 4_096), (5, "y" * 8_192)]
    spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/written")
    (part,) = (tmp_path / "written").glob("*.parquet")
    part.rename(tmp_path / "documents.parquet")
    found = catalog.QUERIES["sca_24_whole_sums"](spark, str(tmp_path)).toPandas()
    assert len(found) == len(texts) and rows(found) == rows(connect(tmp_path).sql(catalog.ORACLES["sca_24_whole_sums"]).df())


def test_canonical_relations_are_not_written(spark):
    """Queries over objects alone make no order of slices, and none leaves a table behind."""
    from oracle import DATA

    for name in ("sca_01_slice_sizes", "src_19_delete", "fil_16_17_verifiable"):
        plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "sliceworks_" not in plan
        assert ("Window" in plan) == name.startswith("fil")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("sliceworks_")]


def test_sibling_bays_make_no_pairs(spark, monkeypatch):
    """Two devices of a bridge are not paired; blocks of three differences give what one block gives."""
    from sliceworks.plans import queries_joins

    found = catalog.QUERIES["joi_15_sibling_bays"](spark, "/root/testdata/sf0.01")
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1 and "block" in joins[0]
    whole = sorted(found.collect())
    monkeypatch.setattr(queries_joins, "BLOCK", 3)
    assert whole and sorted(catalog.QUERIES["joi_15_sibling_bays"](spark, "/root/testdata/sf0.01").collect()) == whole


def test_repeated_objects_by_path_are_not_multiplied(spark, tmp_path):
    import os

    from oracle import DATA

    for name in ("region", "nation", "customer", "lineitem"):
        os.symlink(f"{DATA}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    orders = spark.read.parquet(f"{DATA}/orders.parquet").limit(3)
    orders.unionByName(orders).write.parquet(f"{tmp_path}/orders.parquet")
    assert catalog.QUERIES["ns_03_objects_by_path"](spark, str(tmp_path)).count() == 6


def test_erasure_holds_batches_of_bounded_bytes(spark):
    """Neither query makes rows for choices nor moves slices to try them; a batch takes no more rows once it has its bytes."""
    from oracle import DATA

    plan = catalog.QUERIES["sca_48_subset_search"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    catalog.QUERIES["sca_26_27_erasure"](spark, DATA)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_the_search_for_a_frame_ends_at_the_first(spark):
    import hashlib

    from sliceworks.sources.tables import first_frame

    digest = hashlib.md5(b"b" * 64).hexdigest()
    assert first_frame(b"a" * 9 + b"b" * 200, digest, 64) == 9
    assert first_frame(b"a" * 200, digest, 64) is None and first_frame(b"", digest, 64) is None
