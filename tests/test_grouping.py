"""The rule join: against brute force, by broadcast and by shuffle, and its plan."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests import golden
from voltledger.operators import grouping, segments
from voltledger.schemas import DOUBLE, INT, LONG, STRING, BOOLEAN, DATE, struct
from voltledger.seeds import local_table
from voltledger.sources.staging import Staging

CONTRACT = struct(
    facility_id=LONG,
    date_id=DATE,
    fuse_size=INT,
    subscribed_power=DOUBLE,
    connection_power=DOUBLE,
    customer_type_id=INT,
    product_id=INT,
    facility_type_id=INT,
)
GROUP = struct(
    customer_group_id=INT,
    mapping_strategy_code=STRING,
    facility_type_id=INT,
    customer_type_id=INT,
    product_id=INT,
    not_product_id=INT,
    min_fuse_size=INT,
    max_fuse_size=INT,
    min_subscribed_power=DOUBLE,
    max_subscribed_power=DOUBLE,
    min_connection_power=DOUBLE,
    max_connection_power=DOUBLE,
    min_bound_included=BOOLEAN,
    max_bound_included=BOOLEAN,
)


def maybe(rng, value, share=0.3):
    return None if rng.random() < share else value


def random_contracts(rng, n):
    return [
        {
            "facility_id": i,
            "date_id": golden.NOV,
            "fuse_size": maybe(rng, rng.choice([16, 20, 25, 80, 125])),
            "subscribed_power": maybe(rng, rng.choice([80.0, 100.0, 120.0, 500.5])),
            "connection_power": maybe(rng, rng.choice([0.0, 9.0, 1000.0])),
            "customer_type_id": rng.choice([1, 2]),
            "product_id": maybe(rng, rng.randint(1, 4)),
            "facility_type_id": rng.choice([1, 1, 1, 2]),
        }
        for i in range(n)
    ]


def random_groups(rng, n):
    return [
        {
            "customer_group_id": i,
            "mapping_strategy_code": rng.choice(grouping.STRATEGIES),
            "facility_type_id": rng.choice([1, 2]),
            "customer_type_id": maybe(rng, rng.choice([1, 2]), 0.6),
            "product_id": maybe(rng, rng.randint(1, 4), 0.5),
            "not_product_id": maybe(rng, rng.randint(1, 4), 0.6),
            "min_fuse_size": maybe(rng, rng.choice([16, 20, 80]), 0.1),
            "max_fuse_size": maybe(rng, rng.choice([20, 80, 125])),
            "min_subscribed_power": maybe(rng, rng.choice([80.0, 120.0]), 0.1),
            "max_subscribed_power": maybe(rng, rng.choice([120.0, 500.5])),
            "min_connection_power": maybe(rng, rng.choice([0.0, 9.0]), 0.1),
            "max_connection_power": maybe(rng, rng.choice([9.0, 1000.0])),
            "min_bound_included": rng.random() < 0.5,
            "max_bound_included": rng.random() < 0.5,
        }
        for i in range(1, n + 1)
    ]


def brute_force(contracts, groups):
    """Every contract against every group, the long way."""
    links = []
    for g in groups:
        strategy = g["mapping_strategy_code"]
        if g["product_id"] is None and strategy == "product":
            continue
        if strategy != "product" and g[f"min_{strategy}"] is None:
            continue
        for c in contracts:
            if c["facility_type_id"] != g["facility_type_id"]:
                continue
            if g["customer_type_id"] not in (None, c["customer_type_id"]):
                continue
            if g["product_id"] not in (None, c["product_id"]):
                continue
            if g["not_product_id"] is not None and c["product_id"] in (None, g["not_product_id"]):
                continue
            if strategy != "product":
                value, low, high = c[strategy], g[f"min_{strategy}"], g[f"max_{strategy}"]
                if value is None or value < low or (value == low and not g["min_bound_included"]):
                    continue
                if high is not None and (
                    value > high or (value == high and not g["max_bound_included"])
                ):
                    continue
            links.append((c["facility_id"], g["customer_group_id"]))
    return sorted(links)


@pytest.mark.parametrize("way", ["direct", "segments", "segments by shuffle"])
def test_against_brute_force(spark, monkeypatch, way):
    rng = random.Random(7)
    contracts, groups = random_contracts(rng, 400), random_groups(rng, 60)
    rules = grouping.prepare_rules(local_table(spark, groups, GROUP)).rules
    if way == "segments by shuffle":
        monkeypatch.setattr(grouping, "BROADCAST_MAX_NODES", 3)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assigned = grouping.assign_groups(
            local_table(spark, contracts, CONTRACT), rules, 200 if way == "direct" else 3
        )
        plan = assigned._jdf.queryExecution().executedPlan().toString()
        assert ("node_key" in plan) == (way != "direct")
        assert ("BroadcastHashJoin" in plan) == (way != "segments by shuffle")
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assigned = assigned.cache()
        assigned.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    expected = brute_force(contracts, groups)
    links = grouping.links_of(assigned).collect()
    assert sorted((r.facility_id, r.customer_group_id) for r in links) == expected
    unmapped = grouping.unmapped_of(assigned)
    assert unmapped.columns == CONTRACT.names
    assert {r.facility_id for r in unmapped.collect()} == {
        c["facility_id"] for c in contracts
    } - {facility for facility, _ in expected}
    assigned.unpersist()


def test_strategies_add_up(spark):
    rng = random.Random(11)
    contracts, groups = random_contracts(rng, 200), random_groups(rng, 30)
    df, rules = local_table(spark, contracts, CONTRACT), local_table(spark, groups, GROUP)
    found = []
    for strategy in grouping.STRATEGIES:
        found += [
            (r.facility_id, r.customer_group_id)
            for r in grouping.map_by_strategy(df, rules, strategy).collect()
        ]
    assert sorted(found) == brute_force(contracts, groups)
    with pytest.raises(ValueError, match="Unknown mapping strategy"):
        grouping.map_by_strategy(df, rules, "colour")


def test_messages_and_unknown_strategy(spark):
    groups = golden.rows(golden.CUSTOMER_GROUPS)
    groups[9]["min_subscribed_power"] = None
    groups[0]["product_id"] = None
    rule_set = grouping.prepare_rules(golden.frame(spark, groups))
    assert rule_set.skipped == (
        "Required product_id param is None for customer_group_id=1",
        "Required min_value param is None for customer_group_id=10",
    )
    groups[3]["mapping_strategy_code"] = "colour"
    with pytest.raises(ValueError, match='mapping strategy "colour"'):
        grouping.prepare_rules(golden.frame(spark, groups))


def test_map_contracts(spark):
    contracts = golden.rows(golden.CONTRACTS)
    for row, facility_type in zip(contracts, [1] * 7 + [2] * 4):
        row["facility_type_id"] = facility_type
    contracts[0]["fuse_size"] = 15
    contracts[0]["product_id"] = 2
    mapping = grouping.map_contracts(
        golden.frame(spark, contracts), golden.frame(spark, golden.rows(golden.CUSTOMER_GROUPS))
    )
    assert mapping.result.short_msg == (
        "Facility contracts (1) could not be mapped to a customer group!"
    )
    november = mapping.links.where(F.col("date_id") == golden.NOV).collect()
    assert {r.facility_id: r.customer_group_id for r in november} == {
        k: v for k, v in golden.LINKS.items() if k != 1
    }
    assert grouping.duplicate_links(mapping.links).isEmpty()


def test_contracts_are_not_shuffled(spark, tmp_path):
    """One broadcast of the rules, one scan of the contracts, nothing else."""
    rng = random.Random(3)
    path = str(tmp_path / "contracts")
    local_table(spark, random_contracts(rng, 50), CONTRACT).write.parquet(path)
    rules = grouping.prepare_rules(local_table(spark, random_groups(rng, 10), GROUP)).rules
    assigned = grouping.assign_groups(spark.read.parquet(path), rules)
    plan = assigned._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "BroadcastHashJoin [facility_type_id" in plan
    assert "Exchange hashpartitioning" not in plan and "NestedLoop" not in plan


def test_many_rules_meet_contracts_by_equal_keys(spark):
    """20 000 rules on one axis, narrow ones and wide ones that hold a third of all values: bounds, gaps
    and values beyond all bounds."""
    rng = random.Random(5)
    narrow = [(i * 10.0, i * 10.0 + 8, rng.random() < 0.5, rng.random() < 0.5) for i in range(19_990)]
    wide = [(1000.0 * i, None if i == 3 else 1000.0 * i + 66_000.5, False, True) for i in range(10)]
    groups = [
        {"customer_group_id": i, "mapping_strategy_code": "subscribed_power", "facility_type_id": 1,
         "min_subscribed_power": low, "max_subscribed_power": high, "min_bound_included": first,
         "max_bound_included": last}
        for i, (low, high, first, last) in enumerate(narrow + wide, start=1)
    ]
    rules = grouping.prepare_rules(local_table(spark, groups, GROUP)).rules
    values = [-1.0, 0.0, 1e7, 66_000.5, *(rng.randrange(2_010_000) / 10 for _ in range(3000))]
    values += [rng.randrange(20_100) * 10.0 + rng.choice([0, 8]) for _ in range(1000)]
    contracts = spark.createDataFrame(
        [(i, v) for i, v in enumerate(values)], "facility_id long, subscribed_power double"
    ).selectExpr(
        "facility_id", "DATE'2025-01-01' AS date_id", "CAST(NULL AS INT) AS fuse_size", "subscribed_power",
        "CAST(NULL AS DOUBLE) AS connection_power", "1 AS customer_type_id", "CAST(NULL AS INT) AS product_id",
        "1 AS facility_type_id")
    assigned = grouping.assign_groups(contracts, rules)
    plan = assigned._jdf.queryExecution().executedPlan().toString()
    assert "node_key" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    got = {}
    for row in assigned.collect():
        got.setdefault(row.facility_id, set()).add(row.customer_group_id)

    def rules_of(v):
        i = int(v // 10)
        near = [(j + 1, narrow[j]) for j in (i,) if 0 <= j < len(narrow)]
        for k, (low, high, first, last) in near + [(len(narrow) + 1 + j, w) for j, w in enumerate(wide)]:
            above = v > low or (first and v == low)
            if above and (high is None or v < high or (last and v == high)):
                yield k

    assert got == {i: set(rules_of(v)) or {None} for i, v in enumerate(values)}


@pytest.mark.parametrize("max_nodes", [3, 1_000_000])
def test_links_of_many_rules_are_never_kept(spark, monkeypatch, max_nodes):
    """Links outnumber contracts and rules: they are neither collected nor shuffled, and equal rows without a
    link stay as many as they are."""
    rng = random.Random(13)
    groups = random_groups(rng, 60)
    contracts = random_contracts(rng, 60) * 2
    contracts += [{**c, "product_id": None, "fuse_size": None, "subscribed_power": None, "connection_power": None}
                  for c in contracts[:5] * 2]
    monkeypatch.setattr(grouping, "BROADCAST_MAX_NODES", max_nodes)
    rules = grouping.prepare_rules(local_table(spark, groups, GROUP)).rules
    assigned = grouping.assign_groups(local_table(spark, contracts, CONTRACT), rules, 3)
    plan = assigned._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan
    links = sorted((r.facility_id, r.customer_group_id) for r in grouping.links_of(assigned).collect())
    assert links == brute_force(contracts, groups)
    direct = grouping.assign_groups(local_table(spark, contracts, CONTRACT), rules)
    unmapped, expected = (grouping.unmapped_of(x).exceptAll(grouping.unmapped_of(y))
                          for x, y in ((assigned, direct), (direct, assigned)))
    assert unmapped.isEmpty() and expected.isEmpty()
    assert not grouping.unmapped_of(assigned).isEmpty()


def test_rules_alike_meet_a_contract_at_once(spark):
    """Rules that share node and conditions are one row, whatever their ids, a null one too; same rows as one by one."""
    rng = random.Random(17)
    groups = random_groups(rng, 40)
    groups += [{**g, "customer_group_id": 1000 + 100 * k + i} for k in range(3) for i, g in enumerate(groups)]
    groups += [{**groups[i], "customer_group_id": None} for i in (0, 1)]
    contracts = random_contracts(rng, 80) * 2
    contracts += [{**c, "facility_type_id": None, "product_id": None} for c in contracts[:4]]
    df = local_table(spark, contracts, CONTRACT)
    rules = grouping.prepare_rules(local_table(spark, groups, GROUP)).rules
    conditions = ("rule_facility_type_id", "rule_customer_type_id", "rule_not_product_id")
    nodes = segments.rule_nodes(rules, segments.axes_of(rules, grouping.INTERVAL_COLUMNS), grouping.PRODUCT_STRATEGY)
    bundled = segments.bundles(nodes, conditions)
    assert 4 * bundled.count() <= nodes.count()
    assert bundled.agg(F.sum(F.size("rule_group_ids"))).first()[0] == nodes.count()
    assigned, direct = grouping.assign_groups(df, rules, 3), grouping.assign_groups(df, rules)
    assert assigned.exceptAll(direct).isEmpty() and direct.exceptAll(assigned).isEmpty()


def test_links_are_dealt_to_as_many_tasks_as_set(spark):
    """Contracts of few bytes and many links are not left to the few tasks that their bytes ask for."""
    groups = [
        {"customer_group_id": i, "mapping_strategy_code": strategy, "facility_type_id": 1, "product_id": product,
         "min_fuse_size": 10, "max_fuse_size": 30 + i, "min_bound_included": True, "max_bound_included": True}
        for i, (strategy, product) in enumerate([("product", 2)] * 20 + [("fuse_size", None)] * 20)
    ]
    contracts = spark.range(0, 800, 1, 1).selectExpr(
        "id AS facility_id", "DATE'2025-01-01' AS date_id", "20 AS fuse_size", "CAST(NULL AS DOUBLE) AS subscribed_power",
        "CAST(NULL AS DOUBLE) AS connection_power", "1 AS customer_type_id", "2 AS product_id", "1 AS facility_type_id")
    staging = Staging(spark, "test-rules")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rules = grouping.prepare_rules(local_table(spark, groups, GROUP)).rules
        links = grouping.links_of(grouping.assign_groups(contracts, rules, 3, staging))
        dealt = links.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        staging.drop()
    assert [r["count"] for r in dealt] == [20 * 50] * 32
