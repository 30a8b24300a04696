"""How queries register: a function over (spark, sf_dir), and the SQL that DuckDB answers it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import for_duckdb

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = for_duckdb(oracle)
        return f

    return register


#: Stored bytes of a slice of an object, in SQL over size, chunk_size and data_n.
SLICE_SIZE = """cast(48 + ceil(cast(coalesce(size, 0) as double) / greatest(1, data_n)) + 16 * greatest(1, ceil(1 + (ceil(cast(coalesce(size, 0) as double) / greatest(1, data_n))
  - (chunk_size - 48) + 16) / cast(chunk_size - 16 as double))) as bigint)"""
ESTIMATE = "cast(ceil(cast(coalesce(size, 0) as double) / greatest(1, data_n)) as bigint)"
READABLE = "(started and enabled)"
WRITABLE = "(started and enabled and healthy and not read_only and not draining)"
CATEGORY = """case error_code when 'ECHECKSUM' then 'checksum' when 'EHEADER' then 'header-mismatch' when 'EUNAVAIL' then 'volume-unavailable' when 'ENOENT' then 'missing' when 'EIO' then 'io'
  when 'ETIMEOUT' then 'timeout' when 'EPARITY' then 'parity-mismatch' when 'EHDRSUM' then 'header-checksum' else 'unknown' end"""
DOMAIN = "case when device_group is null then 'ungrouped:' || cast(volume_id as string) else 'group:' || cast(device_group as string) end"
FREE = "(coalesce(bytes_free, 0) - coalesce(bytes_pending, 0))"
FILL = f"(cast(bytes_total - {FREE} as double) / cast(bytes_total as double))"
