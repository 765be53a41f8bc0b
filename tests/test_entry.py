import os

import duckdb
import pytest

import __spark_entry__ as entry
from textloom.plans import checks, queries

QUERIES, SQL = queries.QUERIES | checks.QUERIES, queries.SQL | checks.SQL

SF = "/root/testdata/sf0.001"
#: One query of each kind; the others differ in parameters.
SOME = ("rule_occurrences", "rule_findings", "first_samples", "severity_rollup", "category_matrix", "acquire_release", "look_back", "ignored_paths", "unguarded", "open_events", "as_of_events", "dependency_gaps", "report_lines", "sarif_levels", "masked_lengths", "number_literals", *checks.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def test_every_query_with_sql_is_registered():
    assert set(SQL) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    want = sorted((tuple(r[k] for k in order) for r in found.fetchall()), key=key)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == want
