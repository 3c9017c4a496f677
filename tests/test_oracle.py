"""The registered queries of the engine against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidegauge import queries as core

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def cell(x):
    return None if isinstance(x, float) and math.isnan(x) else float(f"{x:.9g}") if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, con, name):
    df = core.QUERIES[name](spark, DATA)
    want = con.execute(core.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    mine = sorted((tuple(cell(r[c]) for c in columns) for r in df.collect()), key=str)
    assert mine == sorted((tuple(cell(x) for x in r) for r in want.fetchall()), key=str)


WHOLE = "fill_null fill_zero fill_previous fill_linear difference nn_difference derivative nn_derivative integral_running elapsed math_scalars round_half_even multi_transform raw_fields agg_by_time_tag"


@pytest.mark.parametrize("name", WHOLE.split())
def test_whole_table_is_queried(name):
    """No filter on a tag, and none on time but the fill grid over all of it."""
    text, sql = core.TEXTS[f"{name}_whole"]
    assert "user_id =" not in text and "event_type =" not in text and core.WEEK not in text and core.DAY_ONE not in text
    assert ("WHERE" in text) == name.startswith("fill") and core.WEEK_SQL not in sql and core.DAY_ONE_SQL not in sql


@pytest.mark.parametrize("name", ["integral_running", "integral_running_whole"])
def test_points_at_one_time(spark, con, tmp_path, name):
    """Every event twice, the second time of another user: each has its row."""
    con.execute(f"copy (select * replace (event_id + k * 1000000 as event_id, user_id + k * 1000000 as user_id) from '{DATA}/events.parquet', range(2) r(k)) to '{tmp_path}/events.parquet' (format parquet)")
    for t in ("lineitem", "orders"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{DATA}/{t}.parquet")
    mine = sorted(tuple(map(cell, r)) for r in core.QUERIES[name](spark, str(tmp_path)).collect())
    sql = core.ORACLE_SQL[name].replace("from events", f"from '{tmp_path}/events.parquet'")
    assert mine == sorted(tuple(map(cell, r)) for r in con.execute(sql).fetchall())
