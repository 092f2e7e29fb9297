"""The queries of the subpackage against their SQL on the small tables."""

import duckdb
import numpy as np
import pytest

from scenelake.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    by = next(k for k in (["vec_id"], ["conv_id", "depth"], ["doc_id"]) if k[0] in ORACLE_SQL[name])
    want = con.execute(ORACLE_SQL[name]).df().sort_values(by).reset_index(drop=True)
    got = QUERIES[name](spark, SF).toPandas().sort_values(by).reset_index(drop=True)
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    for c in got.columns:
        same = np.isclose(got[c], want[c], rtol=1e-9, atol=0) if got[c].dtype == float and not got[c].hasnans else (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert same.all(), (c, got[~same].head(), want[~same].head())
