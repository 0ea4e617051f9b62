"""Every registered query at the smallest scale, against DuckDB where it has a twin."""

import os

import pytest

import __spark_entry__ as driver
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not present")


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, connection, name):
    problem = compare(spark, connection, name, driver.queries()[name], driver.oracle_sql().get(name), SF)
    assert problem is None, problem


@pytest.fixture(scope="module")
def people_missing(tmp_path_factory):
    """Clips in whose frames people are missing, one with a short last frame, one without visible joints."""
    import duckdb

    folder = tmp_path_factory.mktemp("people-missing")
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT vec_id, CASE WHEN vec_id >= 320 THEN list_transform(embedding, lambda v: -abs(v)) ELSE embedding END AS embedding, label
        FROM '{SF}/embeddings.parquet' WHERE vec_id < 350 AND vec_id % 23 <> 7 AND vec_id NOT BETWEEN 84 AND 87) TO '{folder}/embeddings.parquet'""")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["clip_archive_source", "clip_features", "pose_array_source"])
def test_people_missing_in_frames(spark, people_missing, name):
    folder, con = people_missing
    problem = compare(spark, con, name, driver.queries()[name], driver.oracle_sql()[name], folder)
    assert problem is None, problem
