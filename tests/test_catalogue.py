"""Every query against its SQL twin on the smallest tables, compared as multisets of rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from assayflow.plans import catalogue, drafting, durable, notes, papers, records, releases, resampled, similarity  # noqa: F401

SF = "/root/testdata/sf0.001"


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(cell(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    relation = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert rows == sorted((tuple(cell(r[i]) for i in at) for r in relation.fetchall()), key=str)


def test_empty_tables(spark, tmp_path):
    for f in Path(SF).glob("*.parquet"):
        spark.read.parquet(str(f)).limit(0).write.parquet(str(tmp_path / f.name))
    for name in ("slo_all", "reconcile_orders", "claim_verdicts", "risk_coverage", "incident_timeline", "sample_stratified"):
        assert catalogue.QUERIES[name](spark, str(tmp_path)).count() == 0
