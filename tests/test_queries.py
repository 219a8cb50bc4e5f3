import datetime
from collections import Counter

import duckdb
import pytest

from tessera.queries import ORACLES, QUERIES, flagship

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def plain(row):
    return tuple(x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    found = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert found.count() > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert Counter(map(plain, found.select(*columns).collect())) == Counter(map(plain, want.fetchall()))


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0
