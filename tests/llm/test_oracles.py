"""Each query of this subpackage that has an oracle against it, on all columns and types."""

import math
from pathlib import Path

import duckdb
import pytest

from convoylake.llm import oracle_sql, queries

DATA = "/root/testdata/sf0.01"
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double"}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries()[name](spark, DATA)
    want = con.execute(oracle_sql()[name])
    kinds = {d[0]: TYPES[str(d[1])] for d in want.description}
    assert dict(df.dtypes) == kinds
    names = sorted(kinds)
    order = [[d[0] for d in want.description].index(c) for c in names]
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    assert sorted(repr([plain(r[c]) for c in names]) for r in df.collect()) == sorted(repr([plain(r[k]) for k in order]) for r in want.fetchall())
