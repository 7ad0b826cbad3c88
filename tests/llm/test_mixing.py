import numpy as np

from loamgraph.llm import mixing as M
from loamgraph.llm.prefix import with_running_sum

DOCS, TARGETS = "source string, doc_id long, tokens long, block string", "source string, target_share double, max_repeats int"


def setup(spark, docs, targets):
    return spark.createDataFrame([(*d, "clash") for d in docs], DOCS), spark.createDataFrame(targets, TARGETS)


def test_shares_repeats_and_spread(spark):
    rng = np.random.default_rng(1)
    docs = [("big", i, int(n)) for i, n in enumerate(rng.integers(10, 90, 3000))] + [("mid", 9000 + i, 40) for i in range(400)] + [("small", 8000 + i, 30) for i in range(100)] + [("other", 7000, 50)]
    d, t = setup(spark, docs, [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 3), ("none", 0.05, 2)])
    mixed = M.mix(d, t, block_tokens=200)
    p = mixed.toPandas().sort_values(["slot", "epoch", "start"])
    assert set(p.source) == {"big", "mid", "small"} and not p.duplicated(["source", "doc_id", "epoch"]).any()
    assert p.groupby(["source", "doc_id"]).size().groupby("source").max().to_dict() == {"big": 1, "mid": 2, "small": 3} or p.groupby(["source", "doc_id"]).size().groupby("source").max()["small"] <= 3
    rep = {r["source"]: r for r in M.share_report(d, t, mixed).collect()}
    assert not rep["none"]["met"] and rep["none"]["tokens"] == 0
    for s, want in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert abs(rep[s]["actual_share"] - want / 0.95) < 0.01 and rep[s]["most_uses"] <= rep[s]["max_repeats"]
    for part in np.array_split(p, 4):  # every stretch of the mix has the shares
        share = part.groupby("source").tokens.sum() / part.tokens.sum()
        assert abs(share["big"] - 0.5 / 0.95) < 0.06 and abs(share["small"] - 0.15 / 0.95) < 0.06


def test_given_total_reports_what_cannot_be_met(spark):
    d, t = setup(spark, [("a", i, 10) for i in range(100)] + [("b", 1000 + i, 10) for i in range(10)], [("a", 0.5, 1), ("b", 0.5, 2)])
    rep = {r["source"]: r for r in M.share_report(d, t, M.mix(d, t, 1000, 50), 1000).collect()}
    assert rep["a"]["tokens"] == 500 and rep["b"]["tokens"] == 200 and not rep["b"]["met"]


def test_empty_and_nulls(spark):
    d, t = setup(spark, [("a", 1, None), (None, 2, 5), ("a", None, 5), ("a", 3, 0), ("a", 4, -1)], [("a", 0.5, 1), (None, 0.5, 1), ("b", None, 1), ("c", 0.5, None)])
    assert M.mix(d, t).where("doc_id is not null").count() == 0
    e, f = setup(spark, [], [])
    assert M.mix(e, f).count() == 0 and M.share_report(e, f, M.mix(e, f)).count() == 0


def test_running_sum_equals_one_window(spark):
    df = spark.range(500).selectExpr("id % 2 as g", "int(id / 10) as part", "id", "id % 7 as v")
    got = {r["id"]: r["s"] for r in with_running_sum(df, ["g"], "part", ["id"], "v", "s").collect()}
    for g in (0, 1):
        run = 0
        for i in range(g, 500, 2):
            assert got[i] == run
            run += i % 7


def test_a_large_document_at_the_border_leaves_no_gap(spark):
    docs = [("a", i, 10) for i in range(200)] + [("b", 1000 + i, 400 if i % 7 == 0 else 3) for i in range(300)]
    d, t = setup(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)])
    for total in (2000, 2600, 3000):
        rep = {r["source"]: r for r in M.share_report(d, t, M.mix(d, t, total, 50), total).collect()}
        assert abs(rep["b"]["tokens"] - total / 2) <= 200 and rep["b"]["most_uses"] == 1
