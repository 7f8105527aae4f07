"""Joining values with the rules whose intervals hold them, by equal keys only.

All bounds of the rules cut the axis of a strategy into elementary segments: each bound, and each gap
above a bound. A rule covers a stretch of segments; a contract value lies in one. As wide rules would
cover very many segments, a stretch is written as its dyadic nodes, two per level at most: node n of level k
holds the segments whose number shifted right by k is n. A value is in a rule exactly when the node of its
segment, on one of the levels that rules use, is one of the rule's. So both sides meet by (facility type, axis,
level, node), and rules that ask for a product by the product as well. Rules alike in all of this are one row, a bundle.

The bounds are brought to the driver: two numbers per rule, of tables that hold at most 65 535 rules.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Product of rules that ask for none, and of the probes for them.
ANY_PRODUCT = -1
#: Axis and node key of the rules by product alone; value axes follow.
PRODUCT_AXIS, PRODUCT_KEY = 0, 0
NODE_BITS, LEVEL_BITS = 40, 8


class Axis(NamedTuple):
    number: int
    strategy: str
    bounds: list[float]

    @property
    def levels(self) -> int:
        """So many levels hold all segments in one node."""
        return (2 * len(self.bounds)).bit_length() + 1


def axes_of(rules: DataFrame, strategies: tuple[str, ...]) -> list[Axis]:
    """The value axes that have rules, with their sorted bounds."""
    pair = F.array("rule_lower", "rule_upper")
    rows = (
        rules.where(F.col("rule_strategy").isin(*strategies))
        .select("rule_strategy", F.explode(pair).alias("bound"))
        .where(F.col("bound").isNotNull())
        .groupBy("rule_strategy")
        .agg(F.sort_array(F.collect_set("bound")).alias("bounds"))
        .collect()
    )
    found = {row.rule_strategy: list(row.bounds) for row in rows}
    return [Axis(i, s, found[s]) for i, s in enumerate(strategies, start=1) if s in found]


def _literal(bounds: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, bounds))), ",").cast("array<double>")


def segment(value: Column, bounds: list[float]) -> Column:
    """The number of the segment a value lies in: 2 i is bound i, 2 i + 1 the gap above it; null below all
    bounds, and for null. A binary search over a literal."""
    array = _literal(bounds)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def step(at: Column, size: Column) -> Column:
        fits = (at + size <= len(bounds)) & (F.get(array, at + size - 1) <= value)
        return F.when(fits, at + size).otherwise(at)

    not_above = F.aggregate(steps, F.lit(0), step)
    of_bound = 2 * (not_above - 1)
    exactly = F.get(array, not_above - 1) == value
    return F.when(value.isNotNull() & (not_above > 0), F.when(exactly, of_bound).otherwise(of_bound + 1))


def _key(axis: int, level: Column, node: Column) -> Column:
    place = F.shiftleft(level.cast("long"), NODE_BITS) + node.cast("long")
    return F.lit(axis << (NODE_BITS + LEVEL_BITS)) + place


def _with_stretch(rules: DataFrame, axis: Axis) -> DataFrame:
    """The rules of an axis with their first segment and the one after their last.

    Their bounds are those of the axis, so the places are looked up by equal values.
    """
    spark = rules.sparkSession
    listed = spark.range(1).select(F.posexplode(_literal(axis.bounds)).alias("place", "bound"))
    of_axis = rules.where(F.col("rule_strategy") == axis.strategy)
    for side in ("lower", "upper"):
        places = listed.select(F.col("place").alias(f"_{side}"), F.col("bound").alias(f"rule_{side}"))
        of_axis = of_axis.join(places, f"rule_{side}", "left")
    first, last = 2 * F.col("_lower"), 2 * F.col("_upper")
    after = F.when(F.col("rule_upper_included"), last + 1).otherwise(last)
    return of_axis.select(
        *rules.columns,
        F.when(F.col("rule_lower_included"), first).otherwise(first + 1).alias("_first"),
        F.coalesce(after, F.lit(2 * len(axis.bounds))).alias("_after"),
    )


def rule_nodes(rules: DataFrame, axes: list[Axis], product_strategy: str) -> DataFrame:
    """The rules by product with a row each, and those of the axes with a row per dyadic node of their stretch: columns
    node_key and node_product."""
    product = F.coalesce("rule_product_id", F.lit(ANY_PRODUCT))
    by_product = rules.where(F.col("rule_strategy") == product_strategy)
    parts = [by_product.select(*rules.columns, F.lit(PRODUCT_KEY).cast("long").alias("node_key"))]
    for axis in axes:
        of_axis = _with_stretch(rules, axis).withColumn(
            "_level", F.explode(F.sequence(F.lit(0), F.lit(axis.levels)))
        )
        size = F.expr("shiftleft(1, _level)")
        low = F.ceil(F.col("_first") / size)
        high = F.floor(F.col("_after") / size)
        ends = F.array(F.when(low % 2 == 1, low), F.when(high % 2 == 1, high - 1))
        nodes = of_axis.where(low < high).withColumn("_node", F.explode(F.array_compact(ends)))
        parts.append(
            nodes.select(*rules.columns, _key(axis.number, F.col("_level"), F.col("_node")).alias("node_key"))
        )
    return reduce(DataFrame.unionByName, parts).withColumn("node_product", product)


def bundles(nodes: DataFrame, conditions: tuple[str, ...]) -> DataFrame:
    """The rules that share a node and all conditions in one row, their ids as the array rule_group_ids.

    A contract meets a bundle once, however many rules are in it. A null id stays one.
    """
    listed = F.collect_list(F.struct("rule_group_id")).getField("rule_group_id")
    return nodes.groupBy("node_key", "node_product", *conditions).agg(listed.alias("rule_group_ids"))


class Extent(NamedTuple):
    """How much there is of an axis, and the levels that rules have nodes on, by whether they ask for a product (1)
    or not (0)."""

    nr_bundles: int
    nr_ids: int
    levels: dict[int, list[int]]


def extents(bundled: DataFrame) -> dict[int, Extent]:
    """The extent of each axis that has bundles."""
    axis = F.shiftright("node_key", NODE_BITS + LEVEL_BITS)
    level = F.shiftright("node_key", NODE_BITS).bitwiseAND((1 << LEVEL_BITS) - 1)
    asks = (F.col("node_product") != ANY_PRODUCT).cast("int")
    counted = bundled.groupBy(axis.alias("axis"), asks.alias("asks"), level.alias("level")).agg(
        F.count("*").alias("nr_bundles"), F.sum(F.size("rule_group_ids")).alias("nr_ids")
    )
    out: dict[int, Extent] = {}
    for row in counted.collect():
        known = out.get(row.axis, Extent(0, 0, {0: [], 1: []}))
        known.levels[row.asks].append(row.level)
        out[row.axis] = Extent(known.nr_bundles + row.nr_bundles, known.nr_ids + row.nr_ids, known.levels)
    return out


def probes(axes: list[Axis], extents_of_axes: dict[int, Extent], product: Column) -> Column:
    """The (node_key, node_product) pairs under which rules for a contract are found, as an array.

    Value columns are named like the strategies.
    """
    found = []

    def add(key: Column, asks: int, present: Column) -> None:
        wanted = product if asks else F.lit(ANY_PRODUCT)
        usable = present & wanted.isNotNull()
        pair = F.struct(key.alias("node_key"), wanted.cast("int").alias("node_product"))
        found.append(F.when(usable, pair))

    for axis in axes:
        at = F.col(f"_segment_{axis.strategy}")
        levels = extents_of_axes[axis.number].levels if axis.number in extents_of_axes else {}
        for asks, used in levels.items():
            for level in sorted(used):
                add(_key(axis.number, F.lit(level), F.shiftright(at, level)), asks, at.isNotNull())
    if not found:
        nothing = F.struct(F.lit(0).cast("long").alias("node_key"), F.lit(0).alias("node_product"))
        return F.array_except(F.array(nothing), F.array(nothing))
    return F.array_compact(F.array(*found))
