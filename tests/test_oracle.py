"""Every query with SQL gives the rows of DuckDB on the smallest tables; the others run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from verify import norm

D = "/root/testdata/sf0.001"
#: Core queries without SQL, and what checks them instead.
NO_SQL = {
    "v6_mmr": "greedy and iterative: test_mmr_is_the_greedy_order", "q6_hybrid": "text rank over free queries: its parts are f8 and q6_search", "x21_payload": "composed of x4, x14 and x31, each with SQL",
}
CORE = {k for m in entry.MODULES for k in __import__(f"loamgraph.queries.{m}", fromlist=["QUERIES"]).QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(D):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{D}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(x) for x in r) for r in df.select(*cols).collect()), key=repr)
    if name in NO_SQL:
        assert got and name not in entry.oracle_sql()
        return
    res = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in res.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert [names[i] for i in order] == cols
    assert got == sorted((tuple(norm(r[i]) for i in order) for r in res.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "name", "score"]


def test_mmr_is_the_greedy_order(spark):
    import numpy as np
    import pyarrow.parquet as pq

    t = pq.read_table(f"{D}/embeddings.parquet").to_pandas().sort_values("vec_id")
    x = np.stack(t["embedding"].to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 1):
        got = [r["id"] for r in entry.queries()["v6_mmr"](spark, D).where(f"query = '{q}'").orderBy("rank").collect()]
        score = x @ x[list(t["vec_id"]).index(q)]
        left, chosen = list(np.argsort(-score, kind="stable")[:50]), []
        while left:
            best = max(left, key=lambda i: (round(0.7 * score[i] - 0.3 * max((x[i] @ x[j] for j in chosen), default=0.0), 9), -i))
            chosen.append(best)
            left.remove(best)
        assert got[:10] == [int(t["vec_id"].iloc[i]) for i in chosen[:10]] and len(got) == len(chosen)
