"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.cutting import cut, new_path

__all__ = ["WHITE", "components", "cut", "ends", "let", "linked", "meetings", "new_path", "open_lists", "shared_lists", "with_earlier", "words_of"]

#: How many times as many hubs each round of ``linked`` takes as the one before.
MORE_HUBS = 32
#: Of how many lists of a node ``linked`` knows that a pair has met there; a pair of more may be a row twice.
KNOWN_LISTS = 64

WORD_BREAK = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"


def words_of(text):
    """Column: the words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives an empty array."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_BREAK))


def let(value, body):
    """Column: ``body`` applied to ``value``, which is evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b), as rows (node, root).

    ``root`` is the smallest node of the component. Alternates the large-star and small-star
    steps, each a grouped minimum and a join, until the edges stay the same; minima and edges of a
    round are tables in the shared folder, so a hub's rows meet in a plain join, which Spark
    splits. Nodes without an edge are not returned.
    """

    def state(df):
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    def oriented(df):
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges = cut(oriented(edges), "edges")
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "lowest")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(oriented(large), "edges")
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = cut(oriented(small), "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def shared_lists(members: DataFrame) -> DataFrame:
    """The distinct rows ``members`` (token, node) whose token several nodes have, as lists in which each node is
    a component (root) of its own."""
    several = members.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    return members.join(several.select("token"), "token").withColumn("root", F.col("node"))


def open_lists(lists: DataFrame) -> DataFrame:
    """The lists (token, node, root, ...) with nodes of more than one component."""
    several = lists.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return lists.join(several.select("token"), "token")


def with_earlier(lists: DataFrame) -> DataFrame:
    """The lists with ``earlier``: those of the node's ``KNOWN_LISTS`` smallest tokens that are smaller than the list's."""
    ranked = Window.partitionBy("node").orderBy("token")
    first = lists.select("node", "token").withColumn("i", F.row_number().over(ranked)).where(F.col("i") <= KNOWN_LISTS)
    of_node = cut(first.groupBy("node").agg(F.sort_array(F.collect_list("token")).alias("tokens")), "tokens")
    at = F.array_size(F.filter("tokens", lambda t: t < F.col("token")))
    return lists.join(of_node, "node").withColumn("earlier", F.slice("tokens", 1, at)).drop("tokens")


def meetings(lists: DataFrame, hub: DataFrame, fit: Column) -> DataFrame:
    """Nodes of the lists with hubs of other components, each two once: in the first list that they share, and of
    two hubs the smaller as the node."""
    once = (~F.col("is_hub") | (F.col("node") < F.col("hub_node"))) & ~F.arrays_overlap("earlier", "hub_earlier")
    return lists.join(hub, "token").where((F.col("root") != F.col("hub_root")) & fit & once)


def linked(lists: DataFrame, carried: list[str], fits: Callable[[], Column], verified: Callable[[DataFrame], DataFrame], known: DataFrame | None = None, finer: Callable[[DataFrame], tuple[DataFrame, list[str], Callable[[], Column]]] | None = None, once: bool = True) -> DataFrame:
    """Links (a, b), with those ``known``, that connect all similar nodes that share a list.

    ``lists``: (token, node, root, and the ``carried`` columns), as of ``open_lists``. In each round
    a hub of each list is compared with the list's other nodes and leaves it: ``fits`` is a condition
    of the join on the carried columns and those of the hub (``hub_...``), ``verified`` gives the pairs
    (a, b) that are links. A list whose nodes lie in one component is done, so a group of near copies
    takes one round and no pairs among its members. Each round takes more hubs of a list. Two nodes
    that share several lists are a row of the join only in that with the smallest token, where none of their
    ``earlier`` lists is the same. ``finer`` gives, for the nodes that are left after the first comparison, a table
    (node and columns) of what the rounds carry instead, the names of its columns and their condition.
    """
    hub = lists.groupBy("token").agg(F.min(F.struct("node", *carried)).alias("hub")).select("token", *[F.col("hub")[c].alias(f"hub_{c}") for c in ("node", *carried)])
    # First each node is compared with one hub only, the smallest of its lists, which most lists of
    # a group of near copies share: these links close nearly all of the group's lists.
    nearest = lists.join(hub, "token").where((F.col("node") != F.col("hub_node")) & fits()).groupBy("node").agg(F.min("hub_node").alias("hub"))
    compared = cut(nearest.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "pairs")
    found, hubs = cut(verified(compared), "links"), 1
    links = found if known is None else known.union(found)
    lists = cut(open_lists(_moved(lists, components(links))), "lists")
    if finer is not None and not lists.isEmpty():
        more, names, fits = finer(cut(lists.select("node").distinct(), "open-nodes"))
        lists, carried = lists.drop(*carried).join(cut(more, "finer"), "node"), names
    # Nodes of many lists carry long ``earlier`` arrays; without ``once`` a pair is a row in each list that it shares.
    lists = cut(with_earlier(lists) if once else lists.withColumn("earlier", F.array().cast("array<long>")), "lists")
    while not lists.isEmpty():
        slot = F.pmod(F.xxhash64("node"), F.lit(hubs))
        of_hub = ["node", "root", "earlier", *carried]
        chosen = cut(lists.groupBy("token", slot.alias("slot")).agg(F.min(F.struct(*of_hub)).alias("hub")).select("token", "hub.*"), "hubs")
        marked = lists.join(chosen.select("token", "node", F.lit(True).alias("is_hub")), ["token", "node"], "left")
        lists = cut(marked.withColumn("is_hub", F.coalesce("is_hub", F.lit(False))), "lists")
        pairs = meetings(lists, chosen.select("token", *[F.col(c).alias(f"hub_{c}") for c in of_hub]), fits())
        first = F.col("node") < F.col("hub_node")
        both = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("node", "hub_node", "a"), ("hub_node", "node", "b"), ("root", "hub_root", "root_a"), ("hub_root", "root", "root_b"))]
        pairs = pairs.select(*both).distinct()
        pairs = cut(pairs.join(compared, ["a", "b"], "left_anti"), "pairs")
        compared = compared.union(pairs.select("a", "b"))
        found = cut(verified(pairs.select("a", "b")), "links")
        links = links.union(found)
        lists = lists.where("NOT is_hub").drop("is_hub")
        if not found.isEmpty():
            # Components of the round's links between the components so far, a much smaller graph.
            lists = _moved(lists, components(pairs.join(found, ["a", "b"]).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))))
        lists = cut(open_lists(lists), "lists")
        hubs *= MORE_HUBS
    return links


def ends(pairs: DataFrame) -> DataFrame:
    """The nodes of ``pairs`` (a, b), once each."""
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def _moved(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists after components ``roots`` (node, root) have taken in others."""
    moved = lists.join(roots.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    return moved.withColumn("root", F.coalesce("to", "root")).drop("to")
