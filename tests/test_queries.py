"""Every query with SQL against DuckDB, on the smallest tables where they exist; the plans of some."""

from __future__ import annotations

import math
import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from shutterlake.plans import registry
from shutterlake.sources.library import Library

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def norm(v: object) -> object:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return str(v)


@pytest.fixture(scope="module")
def duck():  # noqa: ANN201
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name: str) -> None:  # noqa: ANN001
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == Counter(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def test_every_sql_has_a_query() -> None:
    assert set(registry.oracle_sql()) <= set(registry.queries())


def plan(df) -> str:  # noqa: ANN001
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_narrow(spark) -> None:  # noqa: ANN001
    p = plan(Library(spark, DATA).live().where("country = 'Kestria'").select("photo_id"))
    assert "metadata_json" not in p
    assert "camera_make" not in p


def test_no_cartesian_products(spark) -> None:  # noqa: ANN001
    for name in ("JN12", "JN14", "SP06", "p4_found", "JN08"):
        assert "CartesianProduct" not in plan(registry.queries()[name](spark, DATA)), name


def test_pages_are_top_k(spark) -> None:  # noqa: ANN001
    assert "TakeOrderedAndProject" in plan(registry.queries()["SL01"](spark, DATA))


@pytest.mark.parametrize("name", ["PF05", "SL01", "AG03", "WN07"])
def test_filters_reach_the_scan(spark, name: str) -> None:  # noqa: ANN001
    """Filters come before any exchange: none deduplicates photos by their key."""
    p = plan(registry.queries()[name](spark, DATA))
    assert "PushedFilters: [IsNotNull(trashed)" in p
    assert "hashpartitioning(photo_id" not in p


def test_snapshots_follow_the_files(spark, tmp_path) -> None:  # noqa: ANN001
    import shutil

    for name in ("photos", "trash"):
        shutil.copy(f"{DATA}/{name}.parquet", tmp_path / f"{name}.parquet")
    first = Library(spark, str(tmp_path)).trash().count()
    t = Library(spark, str(tmp_path)).table("trash")
    t.limit(3).toPandas().to_parquet(tmp_path / "new.parquet", coerce_timestamps="us")
    shutil.copyfile(tmp_path / "new.parquet", f"{tmp_path}/copy.parquet")
    (tmp_path / "trash.parquet").chmod(0o644)
    shutil.move(tmp_path / "copy.parquet", tmp_path / "trash.parquet")
    assert Library(spark, str(tmp_path)).trash().count() <= 3 < first
