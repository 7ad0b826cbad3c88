from datetime import datetime as T

from pyspark.sql import functions as F

from loamgraph.operators import references as R

REFS = "ref_field string, scope string, row_id long, ref_key long, at timestamp, extra string"
TARGETS = "ref_field string, scope string, ref_key long, born timestamp, gone timestamp"
JAN, FEB, MAR = T(2025, 1, 5), T(2025, 2, 5), T(2025, 3, 5)


def run(spark, rows, refs, targets):
    r = R.classify(spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS))
    return rows(r, "ref_field", "row_id", "ref_key", "orphan_kind", "period")


def test_kinds(spark, rows):
    targets = [("f", "g", 1, JAN, None), ("f", "g", 2, JAN, FEB), ("f", "g", 3, MAR, None), ("f", None, 4, JAN, None), ("f", "h", 1, MAR, None)]
    refs = [
        ("f", "g", 10, 1, FEB, ""), ("f", "g", 11, 2, JAN, ""), ("f", "g", 12, 2, MAR, ""), ("f", "g", 13, 3, FEB, ""), ("f", "g", 14, 9, FEB, ""),
        ("f", "g", 15, None, FEB, ""), ("f", None, 16, 4, FEB, ""), ("f", "h", 17, 1, FEB, ""), ("f", "g", 18, 2, None, ""), ("f", "g", 19, 9, None, ""), ("e", "g", 20, 1, FEB, ""),
    ]
    assert run(spark, rows, refs, targets) == [
        ("e", 20, 1, "missing", "2025-02"), ("f", 12, 2, "deleted", "2025-03"), ("f", 13, 3, "late", "2025-02"), ("f", 14, 9, "missing", "2025-02"), ("f", 17, 1, "late", "2025-02"), ("f", 19, 9, "missing", None),
    ]


def test_hot_key_and_empty(spark, rows):
    refs = [("f", "g", i, 7, FEB, "") for i in range(3000)] + [("f", "g", 9000 + i, i, FEB, "") for i in range(50, 60)]
    out = run(spark, rows, refs, [("f", "g", 50, JAN, None)])
    assert len(out) == 3009 and {x[3] for x in out} == {"missing"}
    assert run(spark, rows, [], []) == []


def test_fold_equals_recount_in_any_split(spark, rows):
    e = spark.createDataFrame([("g", 1), ("g", 1), ("g", 2), ("g", None), (None, 3)], "g string, k long")
    n = spark.createDataFrame([("g", 1), ("g", 5)], "g string, k long")
    whole = R.fold(R.reference_deltas(e, "f", F.col("g"), F.col("k")), R.existence_deltas(n, "f", F.col("g"), F.col("k")))
    first = R.fold(R.reference_deltas(e.limit(2), "f", F.col("g"), F.col("k")))
    removed = R.fold(whole, R.reference_deltas(e, "f", F.col("g"), F.col("k"), -1))
    assert rows(R.current_orphans(whole), "scope", "ref_key", "refs") == [("g", 2, 1), (None, 3, 1)] or rows(R.current_orphans(whole), "scope", "ref_key", "refs") == sorted([("g", 2, 1), (None, 3, 1)], key=repr)
    assert rows(removed.where("refs <> 0 or alive <> 0"), "ref_key", "refs", "alive") == [(1, 0, 1), (5, 0, 1)]
    assert rows(R.current_orphans(R.fold(whole, R.existence_deltas(e.where("k = 2"), "f", F.col("g"), F.col("k")))), "ref_key") == [(3,)]
    assert first.count() == 1


def test_found_rows_come_from_the_folded_state(spark):
    """A key with removal after all its references is no suspect, one removed before the last is, whatever the split into batches."""
    made = spark.createDataFrame([("g", 1, JAN), ("g", 1, FEB), ("g", 2, JAN), ("g", 2, MAR), ("g", 3, JAN), ("g", 4, JAN)], "g string, k long, at timestamp")
    born = spark.createDataFrame([("g", 1, JAN), ("g", 2, JAN), ("g", 3, FEB)], "g string, k long, at timestamp")
    gone = spark.createDataFrame([("g", 1, MAR), ("g", 2, FEB)], "g string, k long, at timestamp")
    of = F.col("g"), F.col("k")
    parts = [R.reference_deltas(made, "f", *of, at=F.col("at")), R.existence_deltas(born, "f", *of, at=F.col("at")), R.existence_deltas(gone, "f", *of, -1, F.col("at"))]
    for state in (R.fold(*parts), R.fold(R.fold(parts[2], parts[0]), parts[1])):
        assert {r["ref_key"] for r in R.suspects(state).collect()} == {2, 3, 4}
        assert {r["ref_key"] for r in R.current_orphans(state).collect()} == {1, 2, 4}
