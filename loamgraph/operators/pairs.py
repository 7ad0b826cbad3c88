"""Similar pairs without comparing all with all: an inverted index over trigrams with prefix filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import set_similarity, trigrams


def look_up(asked: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """(grp, name, other, sim): different names (grp, name) of trigram similarity of at least threshold (above 0) with each different asked (grp, name).

    A name of similarity t shares at least t of the asked trigrams, so only the floor(|a| (1 - t)) + 1 of them are looked up
    that the fewest names have. Sets are compared as a whole for names met so.
    """
    q = asked.where("grp is not null and name is not null").select("grp", "name").distinct().select("grp", "name", trigrams(F.col("name")).alias("gq"))
    sets = names.where("grp is not null and name is not null").select("grp", F.col("name").alias("other")).distinct().select("grp", "other", trigrams(F.col("other")).alias("gn"))
    of_names = sets.select("grp", "other", F.size("gn").alias("b"), F.explode("gn").alias("gram"))
    of_asked = q.select("grp", "name", F.size("gq").alias("a"), F.explode("gq").alias("gram"))
    freq = of_names.join(of_asked.select("grp", "gram").distinct(), ["grp", "gram"], "left_semi").groupBy("grp", "gram").agg(F.count("*").alias("df"))
    w = Window.partitionBy("grp", "name").orderBy(F.coalesce("df", F.lit(0)), "gram")
    head = of_asked.join(freq, ["grp", "gram"], "left").withColumn("r", F.row_number().over(w)).where((F.col("r") <= F.floor(F.col("a") * (1 - threshold)) + 1) & F.col("df").isNotNull())
    may = (F.col("a") >= threshold * F.col("b")) & (F.col("b") >= threshold * F.col("a"))
    met = head.select("grp", "gram", "name", "a").join(of_names, ["grp", "gram"]).where(may).select("grp", "name", "other").distinct()
    sim = met.join(q, ["grp", "name"]).join(sets, ["grp", "other"]).select("grp", "name", "other", set_similarity(F.col("gq"), F.col("gn")).alias("sim"))
    return sim.where(F.col("sim") >= threshold)


def _near_names(named: DataFrame, threshold: float, group: str | None) -> tuple[DataFrame, DataFrame]:
    """(rows, links): (id, key, grp) of the names that count, and pairs (grp, key, k2, sim) of different names, key < k2.

    Two sets of similarity t share one of the floor(|a| (1 - t)) + 1 rarest members of each, so only those are joined.
    """
    grp = F.lit("") if group is None else F.col(group).cast("string")
    rows = named.where("id is not null and name is not null").select("id", F.lower("name").alias("key"), grp.alias("grp")).where("grp is not null")
    names = rows.select("grp", "key").distinct().select("grp", "key", trigrams(F.col("key")).alias("g")).where("size(g) > 0")
    grams = names.select("grp", "key", F.size("g").alias("n"), F.explode("g").alias("gram"))
    freq = grams.groupBy("grp", "gram").agg(F.count("*").alias("df"))
    w = Window.partitionBy("grp", "key").orderBy("df", "gram")
    head = grams.join(freq, ["grp", "gram"]).select("grp", "key", "n", "gram", F.row_number().over(w).alias("r")).where(F.col("r") <= F.floor(F.col("n") * (1 - threshold)) + 1)
    other = head.select("grp", "gram", F.col("key").alias("k2"), F.col("n").alias("n2"))
    near = (F.col("key") < F.col("k2")) & (F.col("n") >= threshold * F.col("n2")) & (F.col("n2") >= threshold * F.col("n"))
    cand = head.join(other, ["grp", "gram"]).where(near).select("grp", "key", "k2").distinct()
    a, b = names.select("grp", "key", F.col("g").alias("ga")), names.select("grp", F.col("key").alias("k2"), F.col("g").alias("gb"))
    close = cand.join(a, ["grp", "key"]).join(b, ["grp", "k2"]).select("grp", "key", "k2", set_similarity(F.col("ga"), F.col("gb")).alias("sim")).where(F.col("sim") >= threshold)
    return rows.join(names.select("grp", "key"), ["grp", "key"], "left_semi"), close


def name_links(named: DataFrame, threshold: float, group: str | None = None) -> DataFrame:
    """(id_a, id_b, sim), id_a < id_b: similar names as pairs between the smallest ids of either name, and equal names as pairs of the smallest id with each other one.

    A name that n rows have gives n - 1 pairs, not all of them. Rows with a null id, name or group have no pairs; names
    without letters and digits pair with nothing.
    """
    rows, close = _near_names(named, threshold, group)
    first = rows.groupBy("grp", "key").agg(F.min("id").alias("rep"))
    same = rows.join(first, ["grp", "key"]).where("id <> rep").select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("sim"))
    a, b = first.withColumnRenamed("rep", "ra"), first.select("grp", F.col("key").alias("k2"), F.col("rep").alias("rb"))
    near = close.join(a, ["grp", "key"]).join(b, ["grp", "k2"]).select(F.least("ra", "rb").alias("id_a"), F.greatest("ra", "rb").alias("id_b"), "sim")
    return near.unionByName(same)


def trigram_pairs(named: DataFrame, threshold: float, group: str | None = None) -> DataFrame:
    """(id_a, id_b, sim) with id_a < id_b and trigram similarity of at least threshold (above 0), within a group if one is named.

    All pairs of ids, those of equal names too: for short lists, such as types; name_links is for tables. Rows with a null
    id, name or group have no pairs; names without letters and digits pair with nothing.
    """
    rows, close = _near_names(named, threshold, group)
    keys = rows.select("grp", "key").distinct()
    links = close.unionByName(keys.select("grp", "key", F.col("key").alias("k2"), F.lit(1.0).alias("sim")))
    left, right = rows.select("grp", F.col("id").alias("ia"), "key"), rows.select("grp", F.col("id").alias("ib"), F.col("key").alias("k2"))
    both = links.join(left, ["grp", "key"]).join(right, ["grp", "k2"]).where((F.col("key") != F.col("k2")) | (F.col("ia") < F.col("ib")))
    return both.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"), "sim").where("id_a <> id_b")
