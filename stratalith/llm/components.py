"""Connected components of a link table, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import skew, storage

#: Iterations after which something must be wrong: star contraction halves paths each time.
MOST_ROUNDS = 60


def connected(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of ``links`` (a, b).

    Alternates large-star and small-star contraction until nothing changes. Minima are
    aggregated with map-side partials; where they are joined back the edges of a hub are
    salted, so a hub of any degree needs no task of its own. Every round is cut by a stored
    table. Self-links and repeated links are harmless; an empty table gives an empty table.
    """
    edges = storage.store(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = _state(edges)
    for _ in range(MOST_ROUNDS):
        with storage.scratch() as keep:
            # large star: every larger neighbour of a node is tied to the least of its neighbourhood
            both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = skew.join(both.where("v > u"), least, {"u": "k"}, total=before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            large = storage.store(large, "links")
            # small star: every node and its smaller neighbours are tied to the least of them
            least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
            tied = skew.join(large, least, {"u": "k"}, total=before[0])
            small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
            small = storage.store(small, "links")
            keep.append(small)
        storage.drop(edges)
        edges, after = small, _state(small)
        if after == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        before = after
    raise RuntimeError("star contraction did not settle")


def _state(edges: DataFrame) -> tuple:
    """A fingerprint of the edge set that does not depend on order."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftrightunsigned(h, 24)), F.sum(h.bitwiseAND(F.lit((1 << 30) - 1)))).first())
