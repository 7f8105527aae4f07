"""Assigning contracts to customer groups by the rules of the groups.

A customer group is a rule: a facility type, optionally a customer type, a product and a product to
stay clear of, and a strategy, which is either the product itself or an interval on the fuse size,
the subscribed power or the connection power of the contract. All rules are applied in one join, by equal keys
where there are many.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltledger import messages
from voltledger.operators import segments
from voltledger.operators.checks import duplicate_rows
from voltledger.operators.joins import fits_broadcast
from voltledger.results import OperationResult, Upsert
from voltledger.sources.staging import Staging

# The contract column each interval strategy looks at; a rule has min_ and max_ columns named alike.
INTERVAL_COLUMNS = ("fuse_size", "subscribed_power", "connection_power")
PRODUCT_STRATEGY = "product"
STRATEGIES = (PRODUCT_STRATEGY, *INTERVAL_COLUMNS)

# So many rules of a facility type are tried one by one.
DIRECT_MAX_RULES = 200
# A node with the conditions of its rules is six numbers: this many take some 100 MB in every executor, and so do
# this many ids of the rules at them.
BROADCAST_MAX_NODES = 1_000_000
BROADCAST_MAX_IDS = 12_000_000

LINK_KEY = ("facility_id", "date_id")


class RuleSet(NamedTuple):
    """Applicable rules, and a message for each group that cannot be applied, in id order."""

    rules: DataFrame
    skipped: tuple[str, ...]


def _by_strategy(prefix: str) -> Column:
    strategy = F.col("mapping_strategy_code")
    column = F.when(strategy == INTERVAL_COLUMNS[0], F.col(f"{prefix}{INTERVAL_COLUMNS[0]}"))
    for name in INTERVAL_COLUMNS[1:]:
        column = column.when(strategy == name, F.col(f"{prefix}{name}"))
    return column.cast("double")


def rule_rows(groups: DataFrame) -> DataFrame:
    """One row per customer group with the bounds its strategy uses and what it lacks, if anything."""
    lower = _by_strategy("min_")
    lacks = F.when(
        F.col("mapping_strategy_code") == PRODUCT_STRATEGY,
        F.when(F.col("product_id").isNull(), "product_id"),
    ).otherwise(F.when(lower.isNull(), "min_value"))
    return groups.select(
        F.col("customer_group_id").alias("rule_group_id"),
        F.col("mapping_strategy_code").alias("rule_strategy"),
        F.col("facility_type_id").alias("rule_facility_type_id"),
        F.col("customer_type_id").alias("rule_customer_type_id"),
        F.col("product_id").alias("rule_product_id"),
        F.col("not_product_id").alias("rule_not_product_id"),
        lower.alias("rule_lower"),
        _by_strategy("max_").alias("rule_upper"),
        F.col("min_bound_included").cast("boolean").alias("rule_lower_included"),
        F.col("max_bound_included").cast("boolean").alias("rule_upper_included"),
        lacks.alias("rule_lacks"),
    )


def prepare_rules(groups: DataFrame) -> RuleSet:
    """Check the strategies (an unknown one raises) and set aside groups that lack a parameter.

    Only the faulty groups are brought to the driver, for their messages.
    """
    rules = rule_rows(groups)
    unknown = ~F.col("rule_strategy").isin(*STRATEGIES)
    faulty = (
        rules.where(unknown | F.col("rule_lacks").isNotNull())
        .select("rule_group_id", "rule_strategy", "rule_lacks")
        .orderBy("rule_group_id")
    )
    skipped = []
    for row in faulty.toLocalIterator():
        if row.rule_strategy not in STRATEGIES:
            raise ValueError(messages.UNKNOWN_STRATEGY.format(strategy=row.rule_strategy))
        skipped.append(
            messages.GROUP_LACKS_PARAMETER.format(param=row.rule_lacks, group_id=row.rule_group_id)
        )
    return RuleSet(rules.where(F.col("rule_lacks").isNull()).drop("rule_lacks"), tuple(skipped))


def contract_filter() -> Column:
    """The part every strategy shares. Unknown stays unknown: a contract without a product does not
    satisfy ``product_id != x``."""
    return (
        (F.col("rule_customer_type_id").isNull() | (F.col("customer_type_id") == F.col("rule_customer_type_id")))
        & (F.col("rule_product_id").isNull() | (F.col("product_id") == F.col("rule_product_id")))
        & (F.col("rule_not_product_id").isNull() | (F.col("product_id") != F.col("rule_not_product_id")))
    )


def interval_filter() -> Column:
    """The contract value lies between the bounds of the rule; no upper bound means no limit."""
    value, lower, upper = _contract_value(), F.col("rule_lower"), F.col("rule_upper")
    above = F.when(F.col("rule_lower_included"), value >= lower).otherwise(value > lower)
    below = F.when(F.col("rule_upper_included"), value <= upper).otherwise(value < upper)
    return above & (upper.isNull() | below)


def _contract_value() -> Column:
    strategy = F.col("rule_strategy")
    column = F.when(strategy == INTERVAL_COLUMNS[0], F.col(INTERVAL_COLUMNS[0]).cast("double"))
    for name in INTERVAL_COLUMNS[1:]:
        column = column.when(strategy == name, F.col(name).cast("double"))
    return column


def assign_groups(
    contracts: DataFrame,
    rules: DataFrame,
    max_direct_rules: int = DIRECT_MAX_RULES,
    staging: Staging | None = None,
) -> DataFrame:
    """Contracts (unique by facility and month) with the id of every group they match, null where they
    match none.

    A few rules are broadcast after their number is checked and tried one by one, so the contracts are read
    once and not shuffled, and both the links and the unmapped contracts come from this one frame. More
    rules than that are found by equal keys, see ``segments``; their nodes are written to ``staging`` (by default a
    folder of their own), which must last as long as the frame.
    """
    if not fits_broadcast(rules, max_direct_rules):
        return _assign_by_segments(contracts, rules, staging or Staging(rules.sparkSession, "rules"))
    matches = contract_filter() & (
        (F.col("rule_strategy") == PRODUCT_STRATEGY) | interval_filter()
    )
    same_type = F.col("facility_type_id") == F.col("rule_facility_type_id")
    joined = contracts.join(F.broadcast(rules), same_type & matches, "left")
    return joined.select(*contracts.columns, F.col("rule_group_id").alias("customer_group_id"))


def _same_rule_type() -> Column:
    """What is left to compare of a contract and a rule that meet by product or node."""
    return (
        (F.col("facility_type_id") == F.col("rule_facility_type_id"))
        & (F.col("rule_customer_type_id").isNull() | (F.col("customer_type_id") == F.col("rule_customer_type_id")))
        & (F.col("rule_not_product_id").isNull() | (F.col("product_id") != F.col("rule_not_product_id")))
    )


def _fits(extents: list[segments.Extent]) -> bool:
    nr_bundles, nr_ids = sum(e.nr_bundles for e in extents), sum(e.nr_ids for e in extents)
    return nr_bundles <= BROADCAST_MAX_NODES and nr_ids <= BROADCAST_MAX_IDS


def _assign_by_segments(contracts: DataFrame, rules: DataFrame, staging: Staging) -> DataFrame:
    """Contracts meet rules by product by the product, and the others by the nodes that their values lie in.

    Links are as many as contracts times rules allow, so they are unfolded from bundles of rules as the last step, and
    never shuffled or kept. The contracts without a link are those of a class that meets no bundle.
    """
    conditions = ("rule_facility_type_id", "rule_customer_type_id", "rule_not_product_id")
    axes = segments.axes_of(rules, INTERVAL_COLUMNS)
    nodes = segments.rule_nodes(_dealt(rules), axes, PRODUCT_STRATEGY)
    bundled = staging.write(segments.bundles(nodes, conditions))
    extents = segments.extents(bundled)
    is_by_product = F.col("node_key") == segments.PRODUCT_KEY
    of_node = (
        (F.col("probe.node_key") == F.col("node_key"))
        & (F.col("probe.node_product") == F.col("node_product"))
        & _same_rule_type()
    )
    of_product = (F.col("product_id") == F.col("node_product")) & _same_rule_type()

    in_class = contracts.withColumns({
        _segment_name(axis): segments.segment(F.col(axis.strategy).cast("double"), axis.bounds) for axis in axes
    })
    class_columns = ["facility_type_id", "customer_type_id", "product_id", *map(_segment_name, axes)]
    open_classes = in_class.select(*class_columns).distinct()
    links = []
    if segments.PRODUCT_AXIS in extents:
        fits = _fits([extents[segments.PRODUCT_AXIS]])
        by_product = _placed(bundled.where(is_by_product), fits)
        links.append((_dealt(contracts) if fits else contracts).join(by_product, of_product))
        open_classes = open_classes.join(by_product, of_product, "left_anti")
    if of_axes := [extent for axis, extent in extents.items() if axis != segments.PRODUCT_AXIS]:
        fits = _fits(of_axes)
        nodes = _placed(bundled.where(~is_by_product), fits)
        probes = segments.probes(axes, extents, F.col("product_id"))
        probing = (_dealt(in_class) if fits else in_class).select(*contracts.columns, F.explode(probes).alias("probe"))
        links.append(probing.join(nodes, of_node))
        open_classes = _all_probes_fail(open_classes, probes, nodes, of_node)

    unfolded = F.explode("rule_group_ids").alias("customer_group_id")
    no_group = F.lit(None).cast(rules.schema["rule_group_id"].dataType).alias("customer_group_id")
    unmapped = _of_classes(in_class, open_classes).select(*contracts.columns, no_group)
    return reduce(DataFrame.unionByName, [*(p.select(*contracts.columns, unfolded) for p in links), unmapped])


def _segment_name(axis: segments.Axis) -> str:
    return f"_segment_{axis.strategy}"


def _placed(bundled: DataFrame, fits: bool) -> DataFrame:
    """Broadcast if there are few, else hashed where the shuffle puts them: probes need no sort then."""
    return F.broadcast(bundled) if fits else bundled.hint("shuffle_hash")


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows in equal parts. A contract is few bytes and many links, a rule many nodes: adaptive execution, which
    merges parts by their bytes, must not leave them to a few tasks, so the number of parts is given."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _all_probes_fail(classes: DataFrame, probes: Column, nodes: DataFrame, of_node: Column) -> DataFrame:
    """The classes (distinct) none of whose probes meets a node; a class without probes is one."""
    probing = _dealt(classes).select(
        "*", F.greatest(F.size(probes), F.lit(1)).alias("_nr_probes"), F.explode_outer(probes).alias("probe")
    )
    failed = probing.join(nodes, of_node, "left_anti").groupBy(*classes.columns, "_nr_probes").count()
    return failed.where(F.col("count") == F.col("_nr_probes")).select(*classes.columns)


def _of_classes(contracts: DataFrame, classes: DataFrame) -> DataFrame:
    """The contracts whose class is one of these; null is a value like others."""
    named = classes.select(*[F.col(c).alias(f"_of{c}") for c in classes.columns])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in classes.columns])
    return contracts.join(named, same, "left_semi")


def links_of(assigned: DataFrame) -> DataFrame:
    """The links; a contract that matches two groups has two."""
    return assigned.where(F.col("customer_group_id").isNotNull()).select(
        *LINK_KEY, "customer_group_id"
    )


def unmapped_of(assigned: DataFrame) -> DataFrame:
    """The contracts without a group."""
    return assigned.where(F.col("customer_group_id").isNull()).drop("customer_group_id")


def contracts_without_link(contracts: DataFrame, links: DataFrame) -> DataFrame:
    """Anti join against links from anywhere, for example stored ones."""
    return contracts.join(links.select(*LINK_KEY), list(LINK_KEY), "left_anti")


def duplicate_links(links: DataFrame) -> DataFrame:
    """Facilities that have more than one group in a month."""
    return duplicate_rows(links, LINK_KEY)


def validate_mapping_inputs(groups: DataFrame, contracts: DataFrame) -> OperationResult:
    if groups.isEmpty():
        return OperationResult.failed(messages.NO_CUSTOMER_GROUPS)
    if contracts.isEmpty():
        return OperationResult.failed(messages.NO_CONTRACTS)
    return OperationResult()


class Mapping(NamedTuple):
    """Links and unmapped contracts (lazy) and a result that is not ok when either groups were
    skipped or contracts are unmapped; both are warnings."""

    links: DataFrame
    unmapped: DataFrame
    result: OperationResult


def map_contracts(contracts: DataFrame, groups: DataFrame) -> Mapping:
    """Apply all customer groups to all contracts."""
    rule_set = prepare_rules(groups)
    assigned = assign_groups(contracts, rule_set.rules)
    unmapped = unmapped_of(assigned)
    return Mapping(links_of(assigned), unmapped, mapping_result(rule_set.skipped, unmapped.count()))


def mapping_result(skipped: tuple[str, ...], nr_unmapped: int) -> OperationResult:
    warnings = [*skipped]
    if nr_unmapped > 0:
        warnings.append(messages.UNMAPPED_CONTRACTS.format(n=nr_unmapped))
    return OperationResult.failed("\n".join(warnings)) if warnings else OperationResult()


def map_by_strategy(contracts: DataFrame, groups: DataFrame, strategy: str) -> DataFrame:
    """Links of the groups of one strategy only."""
    if strategy not in STRATEGIES:
        raise ValueError(f'Unknown mapping strategy "{strategy}"!')
    chosen = groups.where(F.col("mapping_strategy_code") == strategy)
    return links_of(assign_groups(contracts, prepare_rules(chosen).rules))


def split_links(links: DataFrame, existing: DataFrame) -> Upsert:
    """New links, and links that replace the stored one of the same facility and month."""
    stored = existing.select(
        F.col("facility_id").alias("_facility_id"), F.col("date_id").alias("_date_id")
    )
    same_key = (F.col("facility_id") == F.col("_facility_id")) & (
        F.col("date_id") == F.col("_date_id")
    )
    flagged = links.join(stored, same_key, "left").select(
        (F.col("_facility_id").isNull() & F.col("_date_id").isNull()).alias("to_insert"),
        F.col("facility_id").cast("int"),
        F.col("date_id").cast("date"),
        F.col("customer_group_id").cast("int"),
    )
    to_insert = F.col("to_insert")
    return Upsert(
        insert=flagged.where(to_insert).drop("to_insert"),
        update=flagged.where(~to_insert).drop("to_insert"),
    )
