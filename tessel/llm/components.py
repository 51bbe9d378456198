"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for each node of the links (``a``, ``b``).

    Large-star and small-star steps alternate until nothing changes; the number of rounds grows with the
    logarithm of the longest path.  Each step sends a node's neighbours to its smallest one; the minimum is
    aggregated map-side and joined back, so a node with very many neighbours isn't gathered anywhere.  Null
    nodes are no nodes; an empty table gives an empty result.
    """
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = written(pairs, "links")
    state = _state(pairs)
    while state[0]:
        # large star: each node's larger neighbours go to the smallest of itself and its neighbours
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node's smaller neighbours, and itself, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _state(new)
        pairs = new
        if now == state:
            break
        state = now
    roots = pairs.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _state(pairs: DataFrame) -> tuple:
    """Count and hash of a set of pairs."""
    row = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
