import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgraph.llm import neighbours as N


def table(spark, x, extra=()):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "id long, embedding array<float>").withColumn("vec", F.lit("clash")).withColumn("key", F.lit(1))


def brute(x, k, low):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u.astype(np.float32) @ u.astype(np.float32).T, 5).astype(float)
    np.fill_diagonal(s, -9)
    return {i: {j for j in range(len(x)) if s[i, j] >= low and s[i, j] >= np.sort(s[i])[-k]} for i in range(len(x))}


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(2)
    c = rng.standard_normal((40, 16))
    return np.concatenate([c[rng.integers(0, 40, 500)] + 0.12 * rng.standard_normal((500, 16)), rng.standard_normal((300, 16))])


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], set()).add(r["neighbour"])
    return out


def test_factor_one_is_exact(spark, clusters):
    have, want = got(N.similar(table(spark, clusters), 5, 1.0, 16)), brute(clusters, 5, -9)
    assert all(len(have[i]) == 5 and have[i] <= want[i] for i in want)


def test_relaxed_search_keeps_nine_tenths(spark, clusters):
    have, want = got(N.similar(table(spark, clusters), 5, 0.4, 16)), brute(clusters, 5, -9)
    assert sum(len(have[i] & want[i]) for i in want) / (5 * len(want)) >= 0.9


def test_least_cosine(spark, clusters):
    have = got(N.similar(table(spark, clusters), 10, 1.0, 16, min_cosine=0.9))
    u = clusters / np.linalg.norm(clusters, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    for i in range(len(s)):
        near = np.sort(s[i][s[i] >= 0.9])[-10:]
        mine = have.get(i, set())
        assert len(mine) == len(near) and all(s[i, j] >= near[0] - 1e-5 for j in mine)


def test_unusable_vectors_take_no_part(spark):
    x = np.eye(4)
    bad = [(90, None), (91, [1.0]), (92, [0.0] * 4), (93, [float("nan"), 0.0, 0.0, 1.0]), (94, [1.0, None, 0.0, 0.0]), (95, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (96, [])]
    assert {r["id"] for r in N.usable(table(spark, x, bad), 4).collect()} == {0, 1, 2, 3}
    assert set(got(N.similar(table(spark, x, bad), 2, 1.0, 4))) == {0, 1, 2, 3}


def test_copies_and_lengths(spark):
    """A third of all rows are copies, of other lengths; each gets the smallest ids, and no row is lost."""
    rng = np.random.default_rng(1)
    x = np.concatenate([np.outer(rng.uniform(1, 9, 100), np.ones(8)), rng.standard_normal((200, 8))])
    have = got(N.similar(table(spark, x), 3, 1.0, 8))
    assert set(have) == set(range(300)) and have[0] == {1, 2, 3} and have[1] == {0, 2, 3} and have[99] == {0, 1, 2}


def test_repeated_rows_one_vector_and_none(spark):
    one = table(spark, [[1.0, 0.0]])
    assert N.similar(one.unionByName(one), 3, 1.0, 2).count() == 0
    assert N.similar(one.limit(0), 3, 1.0, 2).count() == 0
    two = got(N.similar(table(spark, [[1.0, 0.0], [0.9, 0.1]]), 3, 1.0, 2, ask=F.col("id") == 1))
    assert two == {1: {0}}


def test_route_sends_each_row_home_once():
    x = np.random.default_rng(0).standard_normal((500, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    heap = N.shard_tree(x[:200], 4)
    row, shard, home = N.route(heap, 4, x, np.full(500, 0.1))
    assert sorted(row[home]) == list(range(500)) and len(row) > 500 and shard.max() < 16
    everywhere = N.route(heap, 4, x, np.full(500, 2.0))
    assert len(everywhere[0]) == 500 * 16


def test_recall_at_the_parameters_of_the_queries(spark):
    import pyarrow.parquet as pq

    from loamgraph.llm import queries as Q

    d = "/root/testdata/sf0.01"
    t = pq.read_table(f"{d}/graph_nodes.parquet", columns=["id", "embedding"]).to_pandas().dropna()
    t = t[t["embedding"].map(lambda v: len(v) == 64 and any(v))].drop_duplicates("id").sort_values("id")
    x, ids = np.stack(t["embedding"].to_numpy()).astype(float), t["id"].to_numpy()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1, kind="stable")[:, :10]
    near = {tuple(sorted((int(ids[i]), int(ids[j])))) for i in range(len(ids)) for j in top[i] if s[i, j] >= 0.9}
    got = {tuple(r) for r in Q.p2_found(spark, d).collect()}
    assert len(got & near) >= 0.98 * len(near) and len(got) <= 1.02 * len(near)
    asked = {int(i): set(ids[top[k]]) for k, i in enumerate(ids) if i % 20 == 0}
    hits = {}
    for r in Q.p2_nearest(spark, d).collect():
        hits.setdefault(r["id"], set()).add(r["neighbour"])
    assert hits.keys() == asked.keys() and all(len(v) == 10 for v in hits.values())
    assert sum(len(hits[k] & v) for k, v in asked.items()) >= 0.95 * 10 * len(asked)
