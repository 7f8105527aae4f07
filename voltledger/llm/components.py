"""Connected components of links that no task sees as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voltledger.sources.staging import Staging


def _fingerprint(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row.n, row.h


def components(links: DataFrame, staging: Staging) -> DataFrame:
    """(node, component) for all ends of links (u, v), the component being its smallest node.

    Large stars and small stars by turns: in the first every larger neighbour of a node is linked to
    the smallest of its neighbourhood, in the second every smaller one. The links become stars around
    the smallest nodes after a number of rounds that grows with the logarithm of the longest chain.
    Neighbourhoods are only ever reduced to a minimum, so a node with very many links needs no task of
    its own; the joins on it can be split.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = staging.write(edges.where("u > v").distinct())
    before = _fingerprint(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staging.write(large.where("u > v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(
            F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        ).alias("e")).select("e.u", "e.v")
        edges = staging.write(small.where("u > v").distinct())
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
