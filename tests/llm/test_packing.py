import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamgraph.llm import packing as P

ITEMS, KINDS = "item_id long, tokens long, container string", "kind string, capacity long, grp int"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=60), st.sampled_from(["norm", "dot"]), st.integers(2, 20))
def test_no_capacity_is_exceeded(sizes, rule, most):
    t = np.array(sizes)
    place = P.pack_group(t, 50, most, 2500.0, rule)
    for b in range(place.max() + 1):
        x = t[place == b]
        assert len(x) and x.sum() <= 50 and len(x) <= most and (x.astype(float) ** 2).sum() <= 2500 + 1e-6
    if most >= 20:
        assert place.max() + 1 <= max(1, 2 * -(-t.sum() // 50) + len(t) // most + 1)


def pack(spark, items, kinds=(("a", 100, 0),), **kw):
    return P.pack(spark.createDataFrame([(i, n, "clash") for i, n in items], ITEMS), spark.createDataFrame(list(kinds), KINDS), **kw)


def test_every_item_once_and_fill(spark):
    rng = np.random.default_rng(1)
    items = [(i, int(n)) for i, n in enumerate(rng.integers(1, 60, 9000))]
    got = pack(spark, items, [("a", 100, 0), ("b", 333, 0)], items_per_token=1.0).toPandas()
    assert sorted(got[got.kind == "a"].item_id) == list(range(9000)) == sorted(got[got.kind == "b"].item_id)
    per = got.groupby(["kind", "container"]).agg(n=("tokens", "sum"), used=("used", "max"), cap=("capacity", "max"))
    assert (per.n == per.used).all() and (per.used <= per.cap).all()
    for kind, cap in (("a", 100), ("b", 333)):
        assert len(per.loc[kind]) <= 1.02 * sum(n for _, n in items) / cap + 2


def test_oversized_nulls_and_bad_rows(spark, rows):
    got = pack(spark, [(1, 250), (2, None), (3, -4), (4, 0), (5, 100), (None, 7), (6, 101)], [("a", 100, 0), ("none", 0, 0), (None, 9, 0), ("null", None, 0)])
    assert rows(got, "item_id", "piece", "tokens") == [(1, 0, 100), (1, 1, 100), (1, 2, 50), (2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 0, 100), (6, 0, 100), (6, 1, 1)]
    assert pack(spark, []).count() == 0 and pack(spark, [(1, 1)], []).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_report(spark, rule):
    r = P.fill_report(pack(spark, [(i, 50) for i in range(10)], rule=rule)).first()
    assert (r["n_containers"], r["n_items"], r["tokens"], r["fill"], r["lower_bound"]) == (5, 10, 500, 1.0, 5)


def test_attention_and_count_refuse_items():
    t = np.array([90, 10, 10, 60, 40])
    place = P.pack_group(t, 100, 10, 0.75 * 100**2)
    assert list(np.bincount(place)) == [1, 2, 2] and place[0] == 0  # 90 is over the attention capacity alone, though 10 would fit beside it
    assert len(set(P.pack_group(np.ones(9, int), 100, 4, 1e4))) == 3
