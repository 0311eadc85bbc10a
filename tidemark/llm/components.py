"""Connected components of a link table, by alternating star contraction.

Each round replaces links by links to the smallest neighbour, once from larger neighbours (large
star) and once from smaller ones (small star), until every node points at its root. A round is two
grouped minima and two joins on the node; a hub's links are pre-aggregated before the shuffle and its
join is split by adaptive execution. Rounds are written tables: lineage stays short, and a lost
executor costs only the running round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import Table


def _sum(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND((1 << 40) - 1))).first()
    return tuple(r)


def components(links: DataFrame, rounds: int = 60) -> Table:
    """(node, root) of every node that has a link in ``links`` (columns a, b), root being the smallest node.

    The caller drops the returned table. Self-links and repeated links change nothing; no links give
    an empty table.
    """
    at = Table(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _sum(at.df)
    for _ in range(rounds):
        if not before[0]:
            break
        e = at.df
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = Table(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        at.drop()
        at, after = nxt, _sum(nxt.df)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = at.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    at.df = out.unionByName(at.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    return at
