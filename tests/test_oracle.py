"""Every registered query that has SQL, held against DuckDB in a process of its own on the smallest tables."""

import json
import math
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
RUN = """
import duckdb, json, sys
db = duckdb.connect()
for t in {tables!r}:
    db.execute(f"CREATE VIEW {{t}} AS SELECT * FROM read_parquet('{sf}/{{t}}.parquet')")
out = {{}}
for name, sql in json.load(sys.stdin).items():
    r = db.execute(sql)
    out[name] = [[d[0] for d in r.description], [[str(x) if x is not None and not isinstance(x, (int, float, str, bool)) else x for x in row] for row in r.fetchall()]]
json.dump(out, sys.stdout)
"""


@pytest.fixture(scope="module")
def duck():
    done = subprocess.run([sys.executable, "-c", RUN.format(tables=TABLES, sf=SF)], input=json.dumps(entry.oracle_sql()), capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    return json.loads(done.stdout)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "~"
        if isinstance(x, bool):
            return str(x)
        return str(int(x)) if isinstance(x, float) and x.is_integer() else repr(round(x, 6)) if isinstance(x, float) else str(x)

    return sorted(columns), sorted([plain(row[i]) for i in order] for row in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_is_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    assert canonical(df.columns, [list(r) for r in df.collect()]) == canonical(*duck[name])


def test_every_query_without_sql_runs(spark):
    for name in sorted(set(entry.queries()) - set(entry.oracle_sql())):
        assert entry.queries()[name](spark, SF).limit(5).collect(), name


def test_entry(spark):
    assert entry.entry(spark).count() > 0
