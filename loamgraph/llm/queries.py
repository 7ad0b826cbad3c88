"""Queries of the training data operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, table
from . import mixing, names, neighbours, packing, pii, reading, repeats


#: Relaxation of the triangle inequality. For near copies (cosine 0.90) a small band loses next to nothing, because a pair is
#: lost only if the search fails from both ends; for the 10 nearest of anything the band must be wider (README: recall).
NEAR_FACTOR, KNN_FACTOR = 0.1, 0.2


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of cosine 0.90 or more of which one is among the 10 nearest of the other."""
    hit = neighbours.similar(table(spark, d, "graph_nodes"), 10, NEAR_FACTOR, min_cosine=0.90)
    return hit.select(F.least("id", "neighbour").alias("node_id_a"), F.greatest("id", "neighbour").alias("node_id_b")).distinct()


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar nodes of every node whose id is divisible by 20, among all nodes."""
    hit = neighbours.similar(table(spark, d, "graph_nodes"), 10, KNN_FACTOR, ask=F.col("id") % 20 == 0)
    return hit.select("id", "neighbour", F.col("rank").cast("bigint").alias("rank"), F.round("cosine", 4).alias("cosine"))


def _people(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "graph_nodes").where("id is not null").groupBy("id").agg(F.max(F.struct("updated_at", "type_id", "name")).alias("x")).select("id", "x.type_id", "x.name")
    types = table(spark, d, "graph_node_types").where("name in ('Person', 'Organization')").select(F.col("id").alias("type_id"), F.col("name").alias("kind"))
    return nodes.join(F.broadcast(types), "type_id").select("id", "kind", "name")  # the type list is fixed


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_entity_pairs(names.entities(_people(spark, d)))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return names.entity_classes(names.entities(_people(spark, d)))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(text_field, row_id, text) of both tables; repeated rows of a record have the same text."""
    nodes = table(spark, d, "graph_nodes").select(F.lit("node_content").alias("text_field"), F.col("id").alias("row_id"), F.col("content").alias("text"))
    reqs = table(spark, d, "ingest_requests").select(F.lit("request_text").alias("text_field"), F.col("request_id").alias("row_id"), "text")
    return nodes.unionByName(reqs).where("row_id is not null and text is not null")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found_spans(_texts(spark, d)).select("text_field", "row_id", "pii_type", "found_text").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text with typed placeholders instead of personal data."""
    return pii.redacted(_texts(spark, d).dropDuplicates(["text_field", "row_id"]))


def _batches(spark: SparkSession, d: str) -> DataFrame:
    req = table(spark, d, "ingest_requests")
    return req.where("request_id is not null").groupBy(F.col("request_id").alias("id")).agg(F.max("batch_no").alias("batch_no"))


def _accepted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(id, first_id) of the history, and of the new batches that were added to it."""
    req = table(spark, d, "ingest_requests")
    old, state = repeats.add_batch(repeats.scratch_history(spark), req.where("batch_no = 0"))
    return old, repeats.add_batch(state, req.where("batch_no >= 1"))[0]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Requests of the new batches that repeat an earlier one, and hash checks that name a known text.

    The history is stored once; the eight batches are then added to it together, which gives what one after the other gives.
    """
    hit = _accepted(spark, d)[1].where("first_id < id")
    req = table(spark, d, "ingest_requests").where("batch_no = 0").select(F.col("request_id").alias("id"), "text")
    known = repeats.known_hashes(table(spark, d, "hash_checks"), req)
    return hit.select(F.lit("request").alias("case_kind"), "first_id", F.col("id").alias("second_id")).unionByName(
        known.select(F.lit("check").alias("case_kind"), "first_id", F.col("check_id").alias("second_id")).distinct()
    )


def p6_batches(spark: SparkSession, d: str) -> DataFrame:
    """What each batch brings: requests, repeats and messages not seen before."""
    old, new = _accepted(spark, d)
    per = _batches(spark, d).join(old.unionByName(new), "id", "left")
    return per.groupBy("batch_no").agg(
        F.count("*").alias("n_requests"), F.count(F.when(F.col("first_id") < F.col("id"), 1)).alias("n_repeats"), F.count(F.when(F.col("first_id") == F.col("id"), 1)).alias("n_new")
    )


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """Answers to the hash checks: how many different hashes were asked, known and unknown."""
    checks = table(spark, d, "hash_checks")
    req = table(spark, d, "ingest_requests").where("batch_no = 0").select(F.col("request_id").alias("id"), "text")
    known = repeats.known_hashes(checks, req).groupBy("check_id").agg(F.count("*").alias("n_known"))
    asked = checks.select("check_id", F.size(F.array_distinct(F.filter(F.transform(F.coalesce("hashes", F.array().cast("array<string>")), repeats.normal_hash), lambda x: x.isNotNull()))).cast("bigint").alias("n_asked"))
    return asked.join(known, "check_id", "left").select("check_id", "n_asked", F.coalesce("n_known", F.lit(0)).alias("n_known"), (F.col("n_asked") - F.coalesce("n_known", F.lit(0))).alias("n_missing"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, tokens): n_tokens, counted anew where it is missing."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", reading.normal_source(F.col("source")).alias("source"), F.coalesce("n_tokens", reading.token_count(F.col("text")), F.lit(0)).cast("bigint").alias("tokens"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "pack_containers").select(F.col("container_kind").alias("kind"), F.col("capacity_tokens").alias("capacity"))
    return packing.pack(_sized(spark, d).select(F.col("doc_id").alias("item_id"), "tokens"), kinds)


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's container of each kind, and how full that is."""
    return _packed(spark, d).select(
        F.col("kind").alias("container_kind"), F.col("container").alias("container_id"), F.col("item_id").alias("doc_id"), "piece", "tokens", "capacity", F.col("used").alias("used_tokens")
    )


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d))


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any packing: documents and tokens placed, pieces of documents above the capacity, containers over it, documents in two containers without need."""
    got = cut(_packed(spark, d))
    full = got.groupBy("kind", "container").agg((F.sum("tokens") > F.first("capacity")).cast("int").alias("over")).groupBy("kind").agg(F.sum("over").cast("bigint").alias("n_over"))
    doc = got.groupBy("kind", "item_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), F.first("capacity").alias("capacity"))
    split = F.when(F.col("pieces") > 1, 1)
    per = doc.groupBy("kind").agg(
        F.count("*").alias("n_docs"), F.sum("tokens").alias("tokens"), F.sum("pieces").alias("n_pieces"), F.count(F.when(F.col("tokens") <= F.col("capacity"), split)).alias("n_split_without_need")
    )
    return per.join(full, "kind").withColumnRenamed("kind", "container_kind")


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_targets").select(reading.normal_source(F.col("source")).alias("source"), "target_share", "max_repeats")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixed documents in order of slot and start."""
    return mixing.mix(_sized(spark, d), _targets(spark, d))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    docs, targets = cut(_sized(spark, d)), _targets(spark, d)
    return mixing.share_report(docs, targets, mixing.mix(docs, targets))


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any mix: per target source, whether a document occurs more often than allowed, and whether sources without a target or documents give any."""
    docs, targets = cut(_sized(spark, d)), _targets(spark, d)
    use = mixing.mix(docs, targets).groupBy("source", "doc_id").agg(F.count("*").alias("uses")).groupBy("source").agg(F.max("uses").alias("uses"))
    there = docs.where("tokens > 0").groupBy("source").agg(F.count("*").alias("n_docs"))
    return targets.join(use, "source", "left").join(there, "source", "left").select(
        "source", (F.coalesce("uses", F.lit(0)) > F.col("max_repeats")).alias("too_often"), (F.col("uses").isNotNull()).alias("in_mix"), F.coalesce("n_docs", F.lit(0)).alias("n_docs")
    )


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels")).select("doc_id", F.col("level").alias("reading_level"))


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents per source and level, and the mean level of the source."""
    docs = table(spark, d, "documents").select("doc_id", reading.normal_source(F.col("source")).alias("source"))
    got = p9_found(spark, d).join(docs, "doc_id")
    return got.groupBy("source").agg(*[F.count(F.when(F.col("reading_level") == k, 1)).alias(f"n_level_{k}") for k in reading.LEVELS], F.round(F.avg("reading_level"), 4).alias("mean_level"))


QUERIES = {"p2_found": p2_found, "p2_nearest": p2_nearest, "p3_found": p3_found, "p3_classes": p3_classes, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_found": p6_found, "p6_batches": p6_batches, "p6_checks": p6_checks, "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_kept": p7_kept, "p8_kept": p8_kept, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_profile": p9_profile}
_SIZED = r"""with s as (select doc_id, regexp_replace(lower(trim(source)), '[-\s]+', '_', 'g') as source,
  coalesce(n_tokens, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}\s]+')), 0) as tokens from documents)
"""
SQL = {
    "p7_kept": _SIZED + """select container_kind, count(*) as n_docs, cast(sum(tokens) as bigint) as tokens, cast(sum(greatest(ceil(tokens / capacity_tokens), 1)) as bigint) as n_pieces,
      cast(0 as bigint) as n_split_without_need, cast(0 as bigint) as n_over from s cross join pack_containers group by 1""",
    "p8_kept": _SIZED + r"""select t.source, false as too_often, count(s.doc_id) > 0 as in_mix, count(s.doc_id) as n_docs
      from (select regexp_replace(lower(trim(source)), '[-\s]+', '_', 'g') as source from source_targets) t left join s on s.source = t.source and s.tokens > 0 group by 1""",
    "p6_checks": """with seen as (select distinct sha256(text) as h from ingest_requests where batch_no = 0 and text is not null),
      asked as (select distinct check_id, lower(regexp_extract(x, '([0-9A-Fa-f]{64})', 1)) as h from (select check_id, unnest(hashes) as x from hash_checks)),
      n as (select check_id, count(*) filter (where h <> '') as n_asked, count(*) filter (where h in (select h from seen)) as n_known from asked group by 1)
      select c.check_id, coalesce(n_asked, 0) as n_asked, coalesce(n_known, 0) as n_known, coalesce(n_asked, 0) - coalesce(n_known, 0) as n_missing
      from (select distinct check_id from hash_checks) c left join n on n.check_id = c.check_id""",
}
