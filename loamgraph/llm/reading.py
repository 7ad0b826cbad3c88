"""Reading level of documents from one smoothed unigram language model per level.

Labelled documents train the models; a document gets the level with the highest posterior, that is the likelihood of its
words times the share of the level among the labelled documents. Labels that the first models contradict are taken for
errors and left out of the second, final training. Each text is read once, into the list of its words.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

LEVELS = (1, 2, 3, 4)
#: Bound of the labelled documents the models are fitted on; all their words are in the models.
MAX_LABELLED = 20_000
SMOOTHING = 0.5
#: Least share of English function words in an English text.
MIN_ENGLISH = 0.05
MIN_TOKENS = 50

# Frequent function words by which a text's language is told.
FUNCTION_WORDS = {
    "en": "the and of to in is was that for with on as by be are were this had has not from at it we they but when which",
    "de": "der die das und den dem des ein eine einen ist war nicht mit auf für von zu im am sich wegen ohne dass wurde sie",
    "fr": "le la les des du un une et est dans pour que qui sur avec au aux pas ne ce cette par plus sans il elle",
    "es": "el la los las del un una y es en para que con por no se al su como más sin lo este esta fue",
}


def words_of(col) -> F.Column:
    return F.regexp_extract_all(F.lower(col), F.lit(r"(?U)\p{L}+"), F.lit(0))


def token_count(col) -> F.Column:
    """Tokens by the pattern of runs of word characters and runs of other visible characters."""
    return F.regexp_count(col, F.lit(r"(?U)\w+|[^\w\s]+"))


def is_event_dump(col) -> F.Column:
    """All non-empty lines are JSON objects."""
    lines = F.filter(F.split(col, r"\n"), lambda x: F.trim(x) != "")
    return (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(r"^\s*\{.*\}\s*,?\s*$"))


def _one_of(words: list[str]):
    return lambda w: w.isin(words)


def is_english(words) -> F.Column:
    """Of the words, English function words are at least MIN_ENGLISH and more than those of each other language."""
    n = {k: F.size(F.filter(words, _one_of(v.split()))) for k, v in FUNCTION_WORDS.items()}
    return (n["en"] >= MIN_ENGLISH * F.size(words)) & reduce(lambda a, b: a & b, [n["en"] > n[k] for k in n if k != "en"])


def eligible(documents: DataFrame) -> DataFrame:
    """(doc_id, words) of English documents of at least MIN_TOKENS tokens that are no event dumps, whatever other columns say."""
    t = F.col("text")
    read = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & t.isNotNull() & (token_count(t) >= MIN_TOKENS) & ~is_event_dump(t))
    return read.select("doc_id", words_of("text").alias("words")).where(is_english(F.col("words")))


def votes(labels: DataFrame) -> DataFrame:
    """(doc_id, level, ratings): the lower median of a document's ratings 1 to 4; repeated rows count once."""
    clean = labels.select("doc_id", F.col("reading_level").cast("int").alias("level"), "rater").where("doc_id is not null and level between 1 and 4").distinct()
    return clean.groupBy("doc_id").agg(F.sort_array(F.collect_list("level")).alias("ratings")).select(
        "doc_id", F.expr("ratings[int((size(ratings) - 1) / 2)]").alias("level"), "ratings"
    )


def fit(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((word, s1..s4), (p1..p4)): log likelihoods of all words in labelled (doc_id, words, level), and log priors in one row."""
    per = labelled.select("level", F.explode("words").alias("word")).groupBy("word").agg(*[F.count(F.when(F.col("level") == k, 1)).alias(f"c{k}") for k in LEVELS])
    words = cut(per)
    total = words.agg(*[F.sum(f"c{k}").alias(f"t{k}") for k in LEVELS], F.count("*").alias("v"))
    like = words.crossJoin(F.broadcast(total)).select("word", *[F.ln((F.col(f"c{k}") + SMOOTHING) / (F.col(f"t{k}") + SMOOTHING * F.col("v"))).alias(f"s{k}") for k in LEVELS])
    prior = labelled.agg(*[F.ln((F.count(F.when(F.col("level") == k, 1)) + 1) / (F.count("*") + len(LEVELS))).alias(f"p{k}") for k in LEVELS])
    return cut(like), prior


def score(documents: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(doc_id, level) of the highest posterior for documents (doc_id, words); words the model lacks say nothing; without any known word level is 2.

    The words are joined without a hint: the model is a written table, so the join broadcasts it only if its size allows.
    """
    like, prior = model
    said = documents.select("doc_id", F.explode("words").alias("word"))
    hit = said.join(like, "word").groupBy("doc_id").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in LEVELS]).crossJoin(F.broadcast(prior))
    post = {k: F.col(f"s{k}") + F.col(f"p{k}") for k in LEVELS}
    best = F.greatest(*post.values())
    level = reduce(lambda c, k: c.when(post[k] == best, k), LEVELS[1:], F.when(post[1] == best, 1))
    return documents.select("doc_id").join(hit.select("doc_id", level.cast("bigint").alias("level")), "doc_id", "left").select(
        "doc_id", F.coalesce("level", F.lit(2)).cast("bigint").alias("level")
    )


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, level) of every eligible document. Null or out-of-range labels are ignored; without labels every level is 2."""
    docs = cut(eligible(documents))
    chosen = votes(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    labelled = cut(docs.join(F.broadcast(chosen), "doc_id"))
    first = fit(labelled)
    agreed = labelled.join(score(labelled, first).withColumnRenamed("level", "got"), "doc_id").where(F.array_contains("ratings", F.col("got").cast("int")))
    model = fit(cut(agreed.withColumn("level", F.col("got"))))
    return score(docs, model)


def normal_source(col) -> F.Column:
    """Sources written alike: lower case, trimmed, '-' and spaces as '_'."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[-\s]+", "_")
