import random

import pytest
from pyspark.sql import functions as F

from loamgraph.operators import hierarchy as H


def build(spark, pairs, group="g"):
    df = spark.createDataFrame(pairs, "id string, up string, label string, depth int")
    return H.links(df, "id", "up", "label", group)


def brute(pairs):
    parent, label = {}, {}
    for i, p, l, _ in sorted(set(pairs), key=lambda x: (x[1] is None or not x[1].strip(), x[1] or "", x[2] or "")):
        if i is not None and i not in parent:
            parent[i], label[i] = (p if p and p.strip() else None), l if l is not None else i
    out = {}
    for i in parent:
        seen, x = [i], i
        while parent[x] in parent and parent[x] not in seen:
            x = parent[x]
            seen.append(x)
        if parent[x] in parent:
            out[i] = ("", -1 if parent[x] == i else -2, "")
        else:
            out[i] = (x, len(seen) - 1, ".".join(label[y] for y in reversed(seen)))
    return sorted((i, *v) for i, v in out.items())


def got(rows, placed):
    return rows(placed, "node", "root", "depth", "path")


CASES = {
    "empty": [],
    "roots": [("a", None, "A", 7), ("b", "", "B", 7), ("c", "gone", "C", 7), ("d", "  ", None, 7)],
    "own parent": [("a", "a", "A", 0), ("b", "a", "B", 0), ("c", "b", "C", 0)],
    "ring": [("a", "c", "A", 0), ("b", "a", "B", 0), ("c", "b", "C", 0), ("x", "b", "X", 0), ("y", "x", "Y", 0), ("r", None, "R", 0)],
    "ring with trees": [("a", "b", "a", 0), ("b", "a", "b", 0), *[(f"t{i}", "a", "t", 0) for i in range(5)], *[(f"u{i}", "t1", "u", 0) for i in range(3)]],
    "repeated and null keys": [("a", None, "A", 1)] * 3 + [(None, "a", "N", 1), ("b", "a", "B", 1), ("b", "a", "B", 1)],
    "chain": [(f"n{i:03}", f"n{i - 1:03}" if i else None, f"l{i}", 0) for i in range(70)],
    "star": [("hub", None, "hub", 0)] + [(f"s{i}", "hub", f"s{i}", 0) for i in range(300)],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, rows, name):
    assert got(rows, H.hierarchy(build(spark, CASES[name]))) == brute(CASES[name])


def test_random_links_match_walking_up(spark, rows):
    rng = random.Random(4)
    pairs = [(str(i), str(rng.randrange(140)) if rng.random() < 0.9 else None, f"l{i}", 0) for i in range(120)]
    assert got(rows, H.hierarchy(build(spark, pairs))) == brute(pairs)


def test_descendants_and_sizes(spark, rows):
    records = build(spark, [("a", None, "A", 0), ("b", "a", "B", 0), ("c", "b", "C", 0), ("d", "a", "D", 0), ("z", "z", "Z", 0), ("y", "z", "Y", 0)])
    placed = H.hierarchy(records)
    assert rows(H.descendants(placed), "ancestor", "descendant", "distance") == [("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)]
    assert rows(H.subtree_sizes(records), "node", "subtree_size", "height") == [("a", 4, 2), ("b", 2, 1), ("c", 1, 0), ("d", 1, 0), ("y", 1, 0), ("z", 0, -1)]


def test_sizes_of_random_trees(spark):
    import random

    rng = random.Random(4)
    parent = {i: rng.choice([None, i - 1, rng.randrange(i)]) if i else None for i in range(400)}
    size, height = dict.fromkeys(parent, 1), dict.fromkeys(parent, 0)
    for i in sorted(parent, reverse=True):
        if parent[i] is not None:
            size[parent[i]] += size[i]
            height[parent[i]] = max(height[parent[i]], height[i] + 1)
    got = {int(r["node"]): (r["subtree_size"], r["height"]) for r in H.subtree_sizes(build(spark, [(str(i), None if p is None else str(p), str(i), 0) for i, p in parent.items()])).collect()}
    assert got == {i: (size[i], height[i]) for i in parent}


def test_clashing_columns_do_not_matter(spark, rows):
    df = spark.createDataFrame([(1, None, "A", "x", "y"), (2, 1, "B", "x", "y")], "id long, parent long, label string, path string, node string").withColumn("root", F.lit(1)).withColumn("grp", F.lit("q"))
    assert rows(H.hierarchy(H.links(df, "id", "parent", "label", "t")), "grp", "node", "path") == [("t", "1", "A"), ("t", "2", "A.B")]
