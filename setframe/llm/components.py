"""Connected components of a table of links, by alternating large and small stars.

Each round replaces links by links to smaller nodes without changing what is connected, until every
component is one star around its smallest node; the number of rounds grows with the logarithm of the
graph's size. A node's neighbours are never gathered: rounds are minima and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setframe.session import materialise


#: Links that one task handles without a shuffle; more are shuffled over the session's partitions.
LINKS_IN_ONE_TASK = 100_000


def _rows(*pairs: tuple[str, str]) -> Column:
    """Several links for every row, without reading it several times."""
    return F.inline(F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs)))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(_rows(("u", "v"), ("v", "u")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(_rows(("v", "m"), ("u", "m"))).where("u <> v")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node with a link; ``root`` is the smallest node of its component.

    Nodes may be of any type that Spark orders. Links may repeat, stand in either direction or join a
    node to itself (a node with no other link then has no row).
    """
    down = links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))

    def stored(df: DataFrame) -> tuple[DataFrame, tuple]:
        kept = materialise(df, "links")
        digest = F.xxhash64("u", "v")
        summary = tuple(kept.agg(F.count(F.lit(1)), F.bit_xor(digest),
                                 F.sum(F.shiftright(digest, 20))).first())
        return (kept.coalesce(1) if summary[0] <= LINKS_IN_ONE_TASK else kept), summary

    state, before = stored(down)
    while before[0]:
        state, now = stored(_small_star(_large_star(state)).distinct())
        if now == before:
            break
        before = now
    return state.select(_rows(("u", "v"), ("v", "v"))).distinct().withColumnsRenamed(
        {"u": "node", "v": "root"})
