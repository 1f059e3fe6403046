"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def _trees(links: DataFrame) -> DataFrame:
    """node, root: each node under its least neighbour, and that under its own, up to one that is less than all of its."""
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("near"))
    )
    roots = ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("root"))
    while True:
        roots = cut_lineage(roots)
        above = roots.filter("root <> node").select(F.col("node").alias("root"), F.col("root").alias("above"))
        if not roots.join(above, "root", "left_semi").limit(1).count():
            return roots
        roots = roots.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"))


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node that can be reached over ``links`` (a, b).

    Every round hangs each node under its least neighbour and goes on with the
    roots of these trees, two nodes of a tree having become one: at most half
    of the nodes and the links between trees stay, so that all rounds together
    read little more than the first. Sums are taken before rows move, so a node
    with very many links costs no more than others; only a count reaches the
    driver. An empty table gives no rows; repeated links and links to oneself
    are allowed.
    """
    links = links.filter("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = cut_lineage(links.distinct())
    found = None
    while True:
        roots = _trees(links)
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        found = roots if found is None else cut_lineage(
            found.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        )
        between = links.filter("a <> b")
        for end in ("a", "b"):
            top = roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
            between = between.join(top, end)
        between = between.filter("a_root <> b_root")
        links = cut_lineage(
            between.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct()
        )
        if not links.limit(1).count():
            return found
