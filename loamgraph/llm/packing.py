"""Filling fixed-capacity containers: vector best-fit under token, document-count and attention-cost capacities.

Items are spread over groups of about GROUP_ITEMS by a hash, and each group is packed on its own in
decreasing size. A container must have room in every dimension; an item that alone exceeds the attention capacity has a
container to itself, and others join it as little as one that is full. Among those that do, best-fit takes the
one with the smallest residual norm after the item (rule 'norm') or the largest weighted dot product of
item and residual (rule 'dot'). Containers left below REPACK_FILL are emptied and their items packed
again in groups of their own, so that the rest of a group costs no container per group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

GROUP_ITEMS = 4000
REPACK_FILL = 0.98
WEIGHTS = (1.0, 0.1, 0.1)  # of the token, document and attention dimension


def pack_group(tokens: np.ndarray, capacity: int, max_items: int, max_attention: float, rule: str = "norm") -> np.ndarray:
    """The container number of each item; items must not exceed the capacity. Largest items go first, ties in given order."""
    n = len(tokens)
    need = np.stack([tokens / capacity, np.full(n, 1 / max_items), np.minimum((tokens.astype(float) ** 2) / max_attention, 1.0)], axis=1)
    weights = np.array(WEIGHTS)
    left = np.empty((0, 3))
    place = np.full(n, -1)
    used = 0
    room = np.empty((max(16, n), 3))
    for i in np.argsort(-tokens, kind="stable"):
        left = room[:used]
        after = left - need[i]
        fits = np.flatnonzero(after.min(axis=1) >= -1e-9) if used else np.empty(0, int)
        if len(fits):
            score = (weights * after[fits] ** 2).sum(axis=1) if rule == "norm" else -(weights * need[i] * left[fits]).sum(axis=1)
            b = fits[np.argmin(score)]
        else:
            b, used = used, used + 1
            room[b] = 1.0
        room[b] -= need[i]
        place[i] = b
    return place


def _pack(pdf: pd.DataFrame, rule: str, tag: str) -> pd.DataFrame:
    pdf = pdf.sort_values(["tokens", "item_id", "piece"], ascending=[False, True, True], ignore_index=True)
    cap = int(pdf["capacity"].iloc[0])
    place = pack_group(pdf["tokens"].to_numpy(), cap, int(pdf["max_items"].iloc[0]), float(pdf["max_attention"].iloc[0]), rule)
    fill = np.bincount(place, weights=pdf["tokens"], minlength=place.max() + 1)
    return pdf.assign(container=[f"{tag}{g}-{p}" for g, p in zip(pdf["grp"], place)], used=fill[place].astype("int64"))


_SCHEMA = "kind string, capacity bigint, max_items bigint, max_attention double, item_id bigint, piece int, tokens bigint, grp bigint, container string, used bigint"


def _grouped(items: DataFrame, rule: str, tag: str) -> DataFrame:
    """Pack items in groups of about GROUP_ITEMS per kind."""
    many = {r["kind"]: -(-r["n"] // GROUP_ITEMS) for r in items.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    groups = F.lit(1)
    for kind, n in many.items():
        groups = F.when(F.col("kind") == kind, n).otherwise(groups)
    spread = items.withColumn("grp", F.pmod(F.xxhash64("item_id", "piece", F.lit(tag)), groups.cast("bigint")))
    return spread.groupBy("kind", "grp").applyInPandas(lambda pdf: _pack(pdf, rule, tag), _SCHEMA)


def pack(items: DataFrame, containers: DataFrame, rule: str = "norm", items_per_token: float = 1 / 16, attention_share: float = 0.9) -> DataFrame:
    """(kind, container, item_id, piece, tokens, capacity, used): every item in one container of every kind.

    items: (item_id, tokens), one row per item; a null or negative size counts as 0, null ids are left out.
    containers: (kind, capacity), capacities below 1 are left out. An item above the capacity is split into
    full containers of its own and a rest (piece 0, 1, ...), which is packed like an item. A container holds
    at most max(16, capacity * items_per_token) items and attention_share * capacity**2 of summed squares; a single item may exceed the latter.
    """
    kinds = containers.where("kind is not null and capacity >= 1").groupBy("kind").agg(F.max("capacity").cast("bigint").alias("capacity"))
    rows = items.where("item_id is not null").select("item_id", F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("bigint").alias("tokens"))
    cap = F.col("capacity")
    # the kinds are a short, fixed list
    each = rows.crossJoin(F.broadcast(kinds)).select(
        "kind", "capacity", F.greatest(F.lit(16), (cap * items_per_token).cast("bigint")).cast("bigint").alias("max_items"), (attention_share * cap * cap).cast("double").alias("max_attention"), "item_id",
        F.explode(F.expr("sequence(0, int(greatest(ceil(tokens / capacity), 1)) - 1)")).alias("piece"), F.col("tokens").alias("whole"),
    )
    each = each.select("kind", "capacity", "max_items", "max_attention", "item_id", "piece", F.least(cap, F.col("whole") - F.col("piece") * cap).cast("bigint").alias("tokens"))
    first = cut(_grouped(each, rule, "a"))
    loose = first.where(F.col("used") < REPACK_FILL * cap).drop("grp", "container", "used")
    again = _grouped(cut(loose), rule, "b")
    done = first.where(F.col("used") >= REPACK_FILL * cap)
    return done.unionByName(again).select("kind", "container", "item_id", "piece", "tokens", "capacity", "used")


def fill_report(packed: DataFrame) -> DataFrame:
    """Per kind: containers, items, tokens, the share of the containers' space that is used, and the least number that could do."""
    per = packed.groupBy("kind", "container").agg(F.first("capacity").alias("capacity"), F.sum("tokens").alias("used"), F.count("*").alias("n"))
    return per.groupBy("kind").agg(
        F.first("capacity").alias("capacity"), F.count("*").alias("n_containers"), F.sum("n").alias("n_items"), F.sum("used").alias("tokens"),
        F.round(F.sum("used") / (F.first("capacity") * F.count("*")), 4).alias("fill"), F.ceil(F.sum("used") / F.first("capacity")).alias("lower_bound"),
    )
