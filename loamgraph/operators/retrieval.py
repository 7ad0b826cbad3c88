"""Hybrid retrieval over nodes and episodes as one lazy plan.

Candidates are cut before they are scored, as a search service would: nodes by text rank, episodes by
time. All cuts are top-k with an id as the last key, so that results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..functions import vectors as X
from .graph import spreading_activation
from .pairs import look_up
from .sessions import clustered, neighbours

DIM, MAX_DISTANCE = 64, 0.5


def similarity_to(query: Column | None) -> Column:
    """Cosine of a usable embedding with the query vector, else null."""
    if query is None:
        return F.lit(None).cast("double")
    return F.when(F.size("embedding") == DIM, X.cosine(F.col("embedding"), query))


def node_candidates(nodes: DataFrame, query: str, vector: Column | None, limit: int) -> DataFrame:
    """Live nodes that hold all query words or lie within MAX_DISTANCE of the vector, the 3 * limit best by text rank."""
    words = T.tokens(F.lit(query))
    doc = T.tokens(F.concat_ws(" ", "name", "content"))
    hit = T.matches_all(doc, words)
    n = nodes.where("not forgotten").withColumn("vector_sim", similarity_to(vector)).withColumn("hit", hit)
    n = n.where(F.col("hit") | (F.col("vector_sim") > 1 - MAX_DISTANCE))
    rank = F.round(F.when(F.col("hit"), T.text_rank(doc, words)).otherwise(0.0), 6)
    return n.withColumn("text_rank", rank).orderBy(F.desc("text_rank"), "id").limit(3 * limit)


def score_nodes(cand: DataFrame, flags: DataFrame, as_of: str) -> DataFrame:
    """(kind, id, graph_name, name, score): hybrid score times the supersession factor. flags: supersession_flags."""
    score = S.hybrid(
        vector=F.col("vector_sim"), text=F.col("text_rank"), recency=S.recency(F.greatest("created_at", "updated_at"), as_of),
        activation=S.activation(F.col("access_count"), F.col("last_accessed_at"), as_of), importance=F.col("importance"),
    )
    c = cand.join(flags, "id", "left")
    factor = S.supersession(F.coalesce("is_target", F.lit(False)), F.coalesce("is_source", F.lit(False)))
    return c.select(F.lit("node").alias("kind"), "id", "graph_name", F.col("name").alias("label"), F.round(score * factor, 6).alias("score"))


def episode_candidates(episodes: DataFrame, query: str, limit: int) -> DataFrame:
    """Episodes whose text contains the query apart from case, the 3 * limit newest."""
    return episodes.where(T.contains_ci(F.col("content"), F.lit(query))).orderBy(F.desc("created_at"), F.desc("id")).limit(3 * limit)


def score_episodes(cand: DataFrame, as_of: str) -> DataFrame:
    """(kind, id, graph_name, label, score): recency and a full text match, boosted while in short-term memory."""
    score = S.hybrid(text=F.lit(1.0), recency=S.recency(F.col("created_at"), as_of)) * S.stm_boost(F.col("created_at"), as_of)
    return cand.select(F.lit("episode").alias("kind"), "id", "graph_name", F.substring("content", 1, 80).alias("label"), F.round(score, 6).alias("score"))


def with_session_neighbours(scored: DataFrame, episodes: DataFrame, window: int = 3) -> DataFrame:
    """Episode hits and their session neighbours at NEIGHBOUR_FACTOR times the best score of a hit; hits keep their own."""
    near = neighbours(episodes, scored.select("id"), window).join(scored.select("id", "score"), "id")
    near = near.groupBy(F.col("neighbour_id").alias("id")).agg(F.round(F.max("score") * S.NEIGHBOUR_FACTOR, 6).alias("score"))
    near = near.join(scored.select("id"), "id", "left_anti")
    return scored.select("id", "score", F.lit(False).alias("is_neighbour")).unionByName(near.select("id", "score", F.lit(True).alias("is_neighbour")))


def add_bonus(items: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2, weight: float = S.BONUS_WEIGHT) -> DataFrame:
    """Raises node scores by weight times their spreading activation from the seeds (graph_name, id, score)."""
    bonus = spreading_activation(seeds, edges, depth).select("graph_name", F.col("node").alias("id"), "bonus", F.lit("node").alias("kind"))
    got = items.join(bonus, ["kind", "graph_name", "id"], "left")
    return got.select(*[c for c in items.columns if c != "score"], F.round(F.col("score") + weight * F.coalesce("bonus", F.lit(0.0)), 6).alias("score"))


def ranked(items: DataFrame, limit: int) -> DataFrame:
    """The limit best items: by score, nodes before episodes, then id."""
    return items.orderBy(F.desc("score"), F.desc("kind"), "id").limit(limit)


def simple_recall(nodes: DataFrame, query: str, as_of: str, limit: int = 10) -> DataFrame:
    """(id, name, score): substring search scored by recency, activation and importance."""
    n = nodes.where(~F.col("forgotten") & (T.contains_ci(F.coalesce("name", F.lit("")), F.lit(query)) | T.contains_ci(F.coalesce("content", F.lit("")), F.lit(query))))
    score = S.hybrid(recency=S.recency(F.col("created_at"), as_of), activation=S.activation(F.col("access_count"), F.col("last_accessed_at"), as_of), importance=F.col("importance"))
    return n.select("id", "name", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def cascade(queries: DataFrame, nodes: DataFrame, aliases: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(query, id, match_type, sim): nodes of the first of exact name, alias, similar name that finds any; similar: the best 5.

    queries: (query); nodes: (id, name); aliases: (alias, node_id). Similar names share a trigram, by which they are looked up.
    """
    q = queries.select("query").distinct()
    exact = q.join(nodes.where("name is not null"), F.lower("query") == F.lower("name")).select("query", "id", F.lit("1_exact").alias("match_type"), F.lit(1.0).alias("sim"))
    alias = q.join(aliases, F.lower("query") == F.lower("alias")).select("query", F.col("node_id").alias("id"), F.lit("2_alias").alias("match_type"), F.lit(1.0).alias("sim"))
    left = q.join(exact.unionByName(alias).select("query"), "query", "left_anti")
    named = nodes.where("name is not null")
    near = look_up(left.select(F.lit("").alias("grp"), F.col("query").alias("name")), named.select(F.lit("").alias("grp"), "name"), threshold)
    sim = near.select(F.col("name").alias("query"), F.col("other").alias("name"), F.round("sim", 6).alias("sim")).join(named.select("id", "name"), "name").select("query", "id", "sim")
    w = Window.partitionBy("query").orderBy(F.desc("sim"), "id")
    fuzzy = sim.withColumn("r", F.row_number().over(w)).where("r <= 5").select("query", "id", F.lit("3_fuzzy").alias("match_type"), "sim")
    both = exact.unionByName(alias).unionByName(fuzzy)
    first = both.groupBy("query").agg(F.min("match_type").alias("match_type"))
    return both.join(first, ["query", "match_type"]).select("query", "id", "match_type", "sim").distinct()


def mmr(items: DataFrame, lam: float = 0.7) -> DataFrame:
    """Adds rank to items (query, id, score, embedding), reordered per query for relevance and diversity.

    Greedy: the next item has the largest lam * score - (1 - lam) * (largest cosine to those chosen). Items without
    embedding follow in order of score. A query's items are one bounded result list, ranked in one task.
    """
    import numpy as np
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], ignore_index=True)
        has = pdf["embedding"].map(lambda v: v is not None and len(v) > 0)
        v, rest = pdf[has], pdf[~has]
        order: list[int] = []
        if len(v):
            x = np.array([np.asarray(e, dtype=float) for e in v["embedding"]])
            n = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
            rel, worst, left = v["score"].to_numpy(), np.zeros(len(v)), list(range(len(v)))
            while left:
                i = max(left, key=lambda j: (lam * rel[j] - (1 - lam) * worst[j], -j))
                left.remove(i)
                order.append(v.index[i])
                worst = np.maximum(worst, x @ x[i]) if len(order) > 1 else x @ x[i]
        out = pdf.loc[[*order, *rest.index]]
        return pd.DataFrame({"query": out["query"], "id": out["id"], "score": out["score"], "rank": range(1, len(out) + 1)})

    return items.select("query", "id", "score", "embedding").groupBy("query").applyInPandas(one, "query string, id bigint, score double, rank bigint")


def clustered_context(items: DataFrame, episodes: DataFrame) -> DataFrame:
    """Adds position to episode results (id, score), sessions kept together in order of time."""
    return clustered(items.join(episodes.select("id", "session_id", "created_at"), "id"))
