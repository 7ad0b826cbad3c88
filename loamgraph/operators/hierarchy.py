"""Parent-child rows to full hierarchies by peeling leaves bottom-up.

Peeling one leaf level per round needs as many rounds as the deepest tree has levels. Here a round
peels every *pendant chain* at once: all nodes below which only a single line of nodes remains. A tree
of n nodes is then gone after at most log2(n) rounds, however deep it is. The chain a node belongs to,
and its place there, come from pointer doubling over the single-child nodes of that round. What no
round can peel lies on a cycle, because every node has one parent. While peeling, each chain sends the size
and height of what hangs below its top to the parent it hung from, so that subtree sizes take one row per
node; undoing the rounds in reverse order hands each chain the path, depth and root of that parent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, cut_counted, discard

ON_CYCLE, BELOW_CYCLE = -1, -2


def links(df: DataFrame, node: str, parent: str, label: str, group: str | None = None) -> DataFrame:
    """(grp, node, parent, label) as strings. Rows without a node key are no records; an empty parent is none.

    Repeated rows are one record; where rows of a node still differ the smallest (parent, label) counts.
    """
    key = F.col(node).cast("string")
    up = F.col(parent).cast("string")
    flat = df.select(
        (F.lit(group) if group is not None else F.lit("")).alias("grp"),
        key.alias("node"),
        F.when(F.trim(up) != "", up).alias("parent"),
        F.coalesce(F.col(label).cast("string"), key).alias("label"),
    ).where("node is not null")
    one = F.min(F.struct(F.col("parent").isNull().alias("n"), "parent", "label")).alias("x")
    return flat.groupBy("grp", "node").agg(one).select("grp", "node", "x.parent", "x.label")


def _doubled(low: DataFrame) -> DataFrame:
    """Pointer doubling: every open pointer goes on to where its target points."""
    step = low.select(F.col("grp").alias("sg"), F.col("node").alias("sn"), F.col("tail").alias("st"), F.col("hops").alias("sh"), F.col("over").alias("so"))
    return low.join(step, (F.col("grp") == F.col("sg")) & (F.col("tail") == F.col("sn")) & ~F.col("over"), "left").select(
        "grp", "node", "parent", "label", F.coalesce("st", "tail").alias("tail"), (F.col("hops") + F.coalesce("sh", F.lit(0))).alias("hops"),
        (F.col("over") | F.coalesce("so", F.lit(False))).alias("over"),
    )


def _chains(rest: DataFrame) -> tuple[DataFrame, int]:
    """Nodes of rest on a pendant chain: (grp, node, parent, label, tail, hops), and their number; tail is the chain's leaf."""
    kids = rest.where("parent is not null").groupBy(F.col("grp").alias("kg"), F.col("parent").alias("kp")).agg(
        F.count("*").alias("n"), F.min("node").alias("child")
    )
    seen = rest.join(kids, (F.col("grp") == F.col("kg")) & (F.col("node") == F.col("kp")), "left")
    counts = {"open": F.count_if(~F.col("over")), "ended": F.count_if(F.col("over"))}
    low, n = cut_counted(
        seen.where("n is null or n = 1").select(
            "grp", "node", "parent", "label",
            F.coalesce("child", "node").alias("tail"),
            F.when(F.col("n").isNull(), 0).otherwise(1).cast("bigint").alias("hops"),
            F.col("n").isNull().alias("over"),
        ),
        **counts,
    )
    while n["open"]:
        before, old = n["open"], low
        low, n = cut_counted(_doubled(_doubled(low)), **counts)  # two in one job
        discard(old)
        # Every doubling ends some nodes of each pendant chain still open, so doublings that end none leave
        # only lines that run into a branching node or round a cycle: nothing for this round.
        if n["open"] == before:
            break
    return low.where("over").select("grp", "node", "parent", "label", "tail", "hops"), n["ended"]


def peel(records: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(rounds, rest): the chains of each round as of `_chains`, and what cannot be peeled (grp, node, parent, label)."""
    known = records.select(F.col("grp").alias("pg"), F.col("node").alias("pn"))
    rest, n0 = cut_counted(
        records.join(known, (F.col("grp") == F.col("pg")) & (F.col("parent") == F.col("pn")), "left")
        .select("grp", "node", F.col("pn").alias("parent"), "label"),
        rows=F.count("*"),
    )
    rounds: list[DataFrame] = []
    left = n0["rows"]
    while left:
        got, n = _chains(rest)  # a filter on a table written there
        if not n:
            break
        rounds.append(got)
        old, rest = rest, cut(rest.join(got.select("grp", "node"), ["grp", "node"], "left_anti"))
        discard(old)
        left -= n
    return rounds, rest


def hierarchy(records: DataFrame, with_nodes: bool = True, peeled: tuple[list[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(grp, node, root, depth, path, path_nodes) for every record of `links`; without path_nodes unless with_nodes.

    A parent that is null, empty or not a record makes a root at depth 0. path joins the labels from root
    to node with '.', path_nodes holds the keys. On a cycle (own parent included) depth is -1, below one
    -2, with root and path '' and path_nodes empty. An empty input gives an empty result. peeled: of `peel`, if it is there already.
    """
    rounds, rest = peeled or peel(records)
    none = F.array().cast("array<string>")
    keep = ["path_nodes"] if with_nodes else []
    cols = ["grp", "node", "root", "depth", "path", *keep]
    cycle = rest.select("grp", "node", F.lit("").alias("root"), F.lit(ON_CYCLE).cast("bigint").alias("depth"), F.lit("").alias("path"), none.alias("path_nodes")).select(*cols)
    placed = [cycle]
    for got in reversed(rounds):
        chain = Window.partitionBy("grp", "tail")
        down = chain.orderBy(F.desc("hops")).rowsBetween(Window.unboundedPreceding, 0)
        lists = [F.collect_list("node").over(down).alias("keys")] if with_nodes else []
        line = got.select(
            "grp", "node", "tail",
            F.first("parent").over(down).alias("hook"),
            F.first("node").over(down).alias("top"),
            (F.max("hops").over(chain) - F.col("hops")).alias("steps"),
            F.collect_list("label").over(down).alias("labels"), *lists,
        )
        above = reduce(DataFrame.unionByName, placed).select(
            F.col("grp").alias("ag"), F.col("node").alias("an"), F.col("root").alias("ar"), F.col("depth").alias("ad"), F.col("path").alias("ap"), *[F.col(c).alias("ak") for c in keep]
        )
        lost = F.col("ad") < 0
        own = [F.when(lost, none).otherwise(F.concat(F.coalesce("ak", none), "keys")).alias("path_nodes")] if with_nodes else []
        placed.append(
            cut(
                line.join(above, (F.col("grp") == F.col("ag")) & (F.col("hook") == F.col("an")), "left").select(
                    "grp", "node",
                    F.when(lost, "").otherwise(F.coalesce("ar", "top")).alias("root"),
                    F.when(lost, BELOW_CYCLE).otherwise(F.coalesce(F.col("ad") + 1, F.lit(0)) + F.col("steps")).cast("bigint").alias("depth"),
                    F.when(lost, "").otherwise(F.concat_ws(".", "ap", F.array_join("labels", "."))).alias("path"), *own,
                )
            )
        )
    return reduce(DataFrame.unionByName, placed)


def descendants(placed: DataFrame) -> DataFrame:
    """One row per (ancestor, descendant) of the placed records: (grp, ancestor, descendant, distance >= 1)."""
    return (
        placed.where("depth > 0")
        .select("grp", F.col("node").alias("descendant"), "depth", F.posexplode("path_nodes").alias("at", "ancestor"))
        .where("ancestor <> descendant")
        .select("grp", "ancestor", "descendant", (F.col("depth") - F.col("at")).cast("bigint").alias("distance"))
    )


def subtree_sizes(records: DataFrame, peeled: tuple[list[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(grp, node, subtree_size, height) of the records of `links`: the node itself counts, a leaf has height 0.

    Each round's chains add up what earlier rounds sent to their nodes, from the tail to the top, and send the top's sum to
    its parent. Records on a cycle have size 0 and height -1; those below one count what hangs below them.
    """
    rounds, rest = peeled or peel(records)
    spark = records.sparkSession
    sent = spark.createDataFrame([], "grp string, node string, below bigint, deep bigint")
    done = []
    for got in rounds:
        up = Window.partitionBy("grp", "tail").orderBy("hops").rowsBetween(Window.unboundedPreceding, 0)
        inbox = sent.groupBy("grp", "node").agg(F.sum("below").alias("below"), F.max("deep").alias("deep"))
        line = got.select("grp", "node", "parent", "tail", "hops").join(inbox, ["grp", "node"], "left")
        size = F.sum(1 + F.coalesce("below", F.lit(0))).over(up)
        height = F.col("hops") + F.max(F.greatest(F.lit(0), F.coalesce(F.col("deep") + 1, F.lit(0))) - F.col("hops")).over(up)
        top = F.col("hops") == F.max("hops").over(Window.partitionBy("grp", "tail"))
        line = cut(line.select("grp", "node", "parent", size.cast("bigint").alias("subtree_size"), height.cast("bigint").alias("height"), top.alias("top")))
        done.append(line.select("grp", "node", "subtree_size", "height"))
        sent = sent.unionByName(line.where("top and parent is not null").select("grp", F.col("parent").alias("node"), F.col("subtree_size").alias("below"), F.col("height").alias("deep")))
    none = (F.lit(0).cast("bigint").alias("subtree_size"), F.lit(-1).cast("bigint").alias("height"))
    return reduce(DataFrame.unionByName, [rest.select("grp", "node", *none), *done])
