"""The operators' queries against their SQL, on the same tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from postlark.llm.oracles import oracle_sql
from postlark.llm.queries import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for file in sorted(Path(SF_DIR).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    yield connection
    connection.close()


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(row[i] for i in order) for row in rows]
    return sorted(rows, key=lambda row: [(value is not None, str(value)) for value in row])


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, oracle, name):
    frame = queries()[name](spark, SF_DIR)
    answer = oracle.execute(oracle_sql()[name])
    columns = [column[0] for column in answer.description]
    assert sorted(frame.columns) == sorted(columns)
    expected = _sorted(columns, answer.fetchall())
    actual = _sorted(frame.columns, [tuple(row) for row in frame.collect()])
    assert actual and len(actual) == len(expected)
    for left, right in zip(actual, expected):
        for a, b in zip(left, right):
            assert (math.isclose(a, b, rel_tol=1e-12) if isinstance(a, float) else a == b), (
                left,
                right,
            )
