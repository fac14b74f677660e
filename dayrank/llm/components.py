"""Connected components of a graph given as a table of links, by contraction.

Each round points every node at its smallest neighbour (or itself), follows the pointers to their
ends, and replaces nodes by those ends. Links within an end vanish, so a star, however large, is
gone after one round, and the number of nodes at least halves. All tables are written to the shared
folder between steps. Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayrank.session import materialize


def _oriented(links: DataFrame) -> DataFrame:
    """Each link once, the larger node first, loops left out."""
    return (
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct()
    )


def _ends(pointers: DataFrame) -> DataFrame:
    """(node, root) with every root pointing at itself. Pointers lead to smaller nodes only."""
    while True:
        onward = pointers.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = materialize(
            pointers.join(onward, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")),
            "pointers",
        )
        pointers = moved.select("node", "root")
        if moved.filter("moved").isEmpty():
            return pointers


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): the smallest node reachable from it.
    Links may repeat; a link with a null end is left out. Without links there are no rows."""
    links = materialize(_oriented(links.filter("a IS NOT NULL AND b IS NOT NULL")), "links")
    found = None
    while found is None or not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointers = both.groupBy("a").agg(F.min("b").alias("b"))
        ends = _ends(
            materialize(
                pointers.select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "pointers"
            )
        )
        if found is None:
            found = ends
        else:
            onward = ends.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = materialize(
                found.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root")),
                "roots",
            )
        for end in ("a", "b"):
            there = ends.select(F.col("node").alias(end), F.col("root").alias("to"))
            other = "b" if end == "a" else "a"
            links = links.join(there, end).select(F.col("to").alias(end), other)
        links = materialize(_oriented(links), "links")
    return found.withColumnRenamed("root", "component")
