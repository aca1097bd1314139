"""Where the library's modules put their queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Common tables of the oracle side: blocks of 64 samples, their tall form, and each block beside the next.
BLOCKS = """blocks AS MATERIALIZED (SELECT vec_id AS block, label, list_transform(embedding[1:64], lambda e: least(255, greatest(0, floor(e::DOUBLE * 256 + 128)::INT))) AS px FROM embeddings)"""
SAMPLES = BLOCKS + """, samples AS MATERIALIZED (SELECT block, label, ((i - 1) % 8)::INT AS x, ((i - 1) // 8)::INT AS y, px[i] AS v FROM blocks, range(1, 65) t(i))"""
PAIRS = SAMPLES + """, pairs AS (SELECT a.block, a.label, a.x, a.y, a.v AS src, b.v AS ref FROM samples a JOIN samples b ON b.block = a.block + 1 AND b.x = a.x AND b.y = a.y)"""
COEFFICIENTS = """coefs AS (SELECT l_orderkey, l_linenumber, ((l_orderkey * 31 + l_partkey * 7 + l_linenumber) % 65536 - 32768)::BIGINT AS x FROM lineitem)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add
