"""Every query of the catalogue against its SQL, on the smallest tables."""

import pytest
from oracle import DATA, connect, rows

from sliceworks.plans import catalog


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    found = catalog.QUERIES[name](spark, DATA).toPandas()
    if name not in catalog.ORACLES:
        assert len(found)
        return
    expected = con.sql(catalog.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


def test_erasure_recovers_all(spark):
    assert catalog.QUERIES["sca_26_27_erasure"](spark, DATA).filter("NOT recovered").count() == 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_subset_search_finds_every_document(spark):
    """One slice of six is damaged, so five choices of four are whole."""
    sf = "/root/testdata/sf0.001"
    found = catalog.QUERIES["sca_48_subset_search"](spark, sf).collect()
    texts = spark.read.parquet(f"{sf}/documents.parquet").filter("text IS NOT NULL").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in found) == sorted(r["doc_id"] for r in texts)
    assert {r["choices"] for r in found} == {5}
