"""Every core query against its SQL on the smallest tables."""

from collections import Counter
from datetime import date, datetime
from pathlib import Path

import duckdb
import pytest

from lexloom.plans import core_problems, oracles, queries

Q, SQL = {**queries.Q, **core_problems.Q}, {**oracles.sql(), **core_problems.SQL}


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return str(v) if isinstance(v, (date, datetime)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, data, name):
    df = Q[name](spark, data)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == Counter(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def test_all_have_sql():
    assert set(Q) - set(SQL) == {"stem_tokens", "lexicon_agree_stemmed", "nb_hashed_agreement"}
