import duckdb
import pytest

import __spark_entry__
from tidemark import queries

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    got = queries.QUERIES[name](spark, D)
    cursor = duck.execute(queries.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    want = sorted([str(dict(zip(names, r))[c]) for c in order] for r in cursor.fetchall())
    assert sorted([str(r[c]) for c in order] for r in got.collect()) == want


def test_error_isolated_with_rows_of_no_user_and_without_a_call_of_pandas_for_each_key(spark, duck, tmp_path):
    duck.execute(f"copy (select * replace (case when user_id % 7 = 3 then null else user_id end as user_id) from events) to '{tmp_path}/events.parquet' (format parquet)")
    got = queries.QUERIES["error_isolated"](spark, str(tmp_path)).select("user_id", "n", "cursor_position", "failed")
    assert "CoGroups" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = duck.execute(queries.SQL["error_isolated"].replace("from events", f"from '{tmp_path}/events.parquet'")).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
