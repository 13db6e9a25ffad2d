"""Queries whose results depend on the number of rows or on all attributes, against their SQL at several scales."""

import duckdb
import pytest

from tallyveil import queries

def by_sql(sql, d):
    con = duckdb.connect()
    for t in ("orders", "customer", "nation"):
        con.execute(f"create view {t} as from read_parquet('{d}/{t}.parquet')")
    return sorted(map(tuple, con.execute(sql).fetchall()))


def same(spark, key, sql, d):
    found = sorted(map(tuple, queries.QUERIES[key](spark, d).collect()))
    wanted = by_sql(sql, d)
    assert len(found) == len(wanted)
    for f, w in zip(found, wanted, strict=True):
        assert f == pytest.approx(w, abs=1e-4) if not any(isinstance(x, str) for x in f) else [x if isinstance(x, str) else pytest.approx(x, abs=1e-4) for x in w] == list(f)


SMALL = ("n12_unary_intersection", "n15_central_supports", "e4_marginal_map", "a9_likelihood", "e6_bounds", "e8_complement_inverse", "v1_ranking_metrics", "v3_errors_by_band")


@pytest.mark.parametrize("key", SMALL)
def test_rows_come_from_the_table(spark, sf, key):
    same(spark, key, queries.ORACLE_SQL[key], sf)


@pytest.mark.parametrize("key", ["e6_bounds", "v3_errors_by_band"])
def test_rows_come_from_a_larger_table(spark, key):
    same(spark, key, queries.ORACLE_SQL[key], "/root/testdata/sf0.1")


def test_more_rows_than_15000_are_not_cut(spark, monkeypatch):
    wide = spark.range(40_000, numPartitions=4).selectExpr("id tid", "2L a0", "3L a5")
    monkeypatch.setattr(queries, "_orders", lambda *_: wide)
    assert queries.QUERIES["n12_unary_intersection"](spark, "").first().estimate == pytest.approx(40_000, rel=0.01)


@pytest.mark.parametrize("key", ["c6_public_universe", "cr8_padding_rows", "j10_tid_intersections"])
def test_all_attributes_are_covered(spark, sf, key):
    same(spark, key, queries.ORACLE_SQL[key], sf)
