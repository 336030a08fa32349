"""Queries against their SQL on DuckDB, over the smallest test tables."""

import math
from pathlib import Path

import pytest

from termloom import plans
from termloom.plans import storage

SF = "/root/testdata/sf0.001"
NAMES = (*storage.QUERIES, "greedy_dedup", "greedy_dedup_legacy", "slot_fill", "validate_anchors", "fuzzy_pairs", "fuzzy_tier_dedup", "fuzzy_domains", "chunk_windows", "html_probe", "answer_json", "timing_rows")


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not Path(SF).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    cursor = duck.execute(plans.oracle_sql()[name])
    cols = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(cols)
    rows = lambda found: sorted((tuple(map(plain, r)) for r in found), key=repr)
    assert rows(df.select(*cols).collect()) == rows(cursor.fetchall())
