"""References to records that do not exist, kept as signed counts per key.

Every change is a delta: +1 / -1 references to a key, +1 / -1 existences of a key. Deltas of any number
of batches add up, so a state table of sums is folded with the next batch instead of being recomputed.
A key with positive references and zero existence is an orphan. Sums are combined before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many keys can hold more than 1/HOT_KEYS of all references each, which bounds what is broadcast.
HOT_KEYS = 1000


_TIMES = ("first_at", "last_at", "born", "gone")


def _deltas(df: DataFrame, field, scope, key, refs: int, alive: int, **times) -> DataFrame:
    at = [(times.get(t, F.lit(None))).cast("timestamp").alias(t) for t in _TIMES]
    return df.select(
        (F.lit(field) if isinstance(field, str) else field).alias("ref_field"), scope.cast("string").alias("scope"), key.cast("bigint").alias("ref_key"),
        F.lit(refs).cast("bigint").alias("refs"), F.lit(alive).cast("bigint").alias("alive"), F.lit(int(alive > 0)).alias("known"), *at,
    ).where("ref_key is not null")


def reference_deltas(df: DataFrame, field, scope, key, sign: int = 1, at=None) -> DataFrame:
    """One delta per row that names a key, made at `at` if that is given; a null key is no reference. A delta has the columns of a state."""
    return _deltas(df, field, scope, key, sign, 0, **({} if at is None else {"first_at": at, "last_at": at}))


def existence_deltas(df: DataFrame, field, scope, key, sign: int = 1, at=None) -> DataFrame:
    """As reference_deltas, for records that came to exist (sign 1) or were removed (-1)."""
    return _deltas(df, field, scope, key, 0, sign, **({} if at is None else {"born" if sign > 0 else "gone": at}))


def fold(*deltas: DataFrame) -> DataFrame:
    """Fold states and deltas to one row per key: (ref_field, scope, ref_key, refs, alive, known, first_at, last_at, born, gone).

    refs and alive are sums, known tells whether a record of the key ever was, the times are the first and last reference,
    the first birth and the first removal. Keys whose sums are both zero leave the state, unless a record of theirs was.
    """
    both = deltas[0]
    for d in deltas[1:]:
        both = both.unionByName(d)
    low, high = ("first_at", "born", "gone"), ("known", "last_at")
    return (
        both.groupBy("ref_field", "scope", "ref_key")
        .agg(F.sum("refs").alias("refs"), F.sum("alive").alias("alive"), *[F.min(c).alias(c) for c in low], *[F.max(c).alias(c) for c in high])
        .where("refs <> 0 or alive <> 0 or known = 1")
        .select("ref_field", "scope", "ref_key", "refs", "alive", "known", *_TIMES)
    )


def current_orphans(state: DataFrame) -> DataFrame:
    """Keys that are referenced and do not exist."""
    return state.where("refs > 0 and alive <= 0")


def suspects(state: DataFrame) -> DataFrame:
    """Keys of which some reference can be an orphan at its own time: current orphans that a reference came after, and records born after a reference.

    A key whose record was born before its first reference and is not gone before its last is settled by the state alone.
    """
    now = current_orphans(state).where("known = 0 or gone < last_at or born > first_at")
    return now.unionByName(state.where("refs > 0 and alive > 0 and (born > first_at or gone < last_at)"))


def classify(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Each reference that is missing, deleted or late: (ref_field, row_id, ref_key, orphan_kind, period).

    refs: (ref_field, scope, row_id, ref_key, at); targets: (ref_field, scope, ref_key, born, gone), one row
    per key. scope null on both sides matches. missing: no target; else deleted: gone before at; else late:
    born after at. A null time never makes a reference late or deleted; its period is null.

    The keys come from the state of signed counts (`suspects`); only rows of suspect keys are looked at one by one. Those
    holding over 1/HOT_KEYS of all references (at most HOT_KEYS of them) are joined by broadcast, so that no task gets
    the rows of a hot key.
    """
    keys = ["ref_field", "scope", "ref_key"]
    refs = refs.where("ref_key is not null").withColumn("scope", F.coalesce("scope", F.lit("\0")))
    targets = targets.withColumn("scope", F.coalesce("scope", F.lit("\0")))
    total = refs.agg(F.count("*")).first()[0]
    of = F.col("ref_field"), F.col("scope"), F.col("ref_key")
    state = fold(
        reference_deltas(refs, *of, at=F.col("at")), existence_deltas(targets, *of, at=F.col("born")), existence_deltas(targets.where("gone is not null"), *of, -1, F.col("gone"))
    )
    suspect = suspects(state).select(*keys, "refs", "known", "born", "gone")
    hot = F.broadcast(suspect.where(F.col("refs") * HOT_KEYS > total).drop("refs"))
    cold = suspect.where(F.col("refs") * HOT_KEYS <= total).drop("refs")
    hits = refs.join(hot, keys).unionByName(refs.join(hot.select(*keys), keys, "left_anti").join(cold, keys))
    kind = F.when(F.col("known") == 0, "missing").when(F.col("gone") < F.col("at"), "deleted").when(F.col("born") > F.col("at"), "late")
    return hits.select("ref_field", "row_id", "ref_key", kind.alias("orphan_kind"), F.date_format("at", "yyyy-MM").alias("period")).where("orphan_kind is not null")


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts per field, month and kind, with the number of different keys."""
    return found.groupBy("ref_field", "period", "orphan_kind").agg(
        F.count("*").alias("n_refs"), F.countDistinct("ref_key").alias("n_keys")
    )
