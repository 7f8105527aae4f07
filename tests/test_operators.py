"""Checks, casts, upserts, ids and constraints on small frames."""

from __future__ import annotations

import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from voltledger import schemas
from voltledger.functions.conversion import cast_present, conform, has_required_columns
from voltledger.functions.ordering import ordered
from voltledger.operators import checks, constraints, resolve, upsert
from voltledger.schemas import DATE, INT, LONG, SERIE_VALUE_TYPE, STRING, struct
from voltledger.sources.staging import Staging


def tuples(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


class TestConversion:
    def test_halves(self, spark):
        values = [16.5, 17.5, 16.6, -16.5, None]
        df = spark.createDataFrame([(v,) for v in values], "fuse_size double")
        assert tuples(cast_present(df, struct(fuse_size=INT))) == [
            (16,),
            (18,),
            (17,),
            (-16,),
            (None,),
        ]

    def test_decimal_halves(self, spark):
        df = spark.createDataFrame([(Decimal("14164.5"),), (Decimal("-2.5"),)], "a decimal(18,1)")
        assert tuples(cast_present(df, struct(a=INT))) == [(14165,), (-3,)]

    def test_double_to_decimal(self, spark):
        values = [1.0005, 2.0015, 8237.1925, 1034.0575, -1034.0575, 100.0625, 0.0005]
        expected = ["1.001", "2.002", "8237.192", "1034.057", "-1034.057", "100.063", "0.001"]
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert tuples(cast_present(df, struct(v=SERIE_VALUE_TYPE))) == [
            (Decimal(e),) for e in expected
        ]

    def test_absent_columns(self, spark):
        df = spark.createDataFrame([("2025-11-01",)], "date_id string")
        schema = struct(ean=LONG, date_id=DATE)
        assert cast_present(df, schema).columns == ["date_id"]
        assert tuples(conform(df, schema)) == [(None, date(2025, 11, 1))]

    def test_required_columns(self):
        assert has_required_columns(["b", "a"], ["a"]).ok
        result = has_required_columns(["x"], ["b", "a"])
        assert not result.ok and "Missing required columns : ('a', 'b')" in result.short_msg


class TestChecks:
    @pytest.fixture
    def df(self, spark):
        rows = [(1, "a", date(2025, 1, 1)), (1, "a", date(2025, 1, 1)), (None, "b", None)]
        rows += [(None, "b", None), (2, None, date(2025, 1, 2)), (3, "c", date(2025, 2, 1))]
        return spark.createDataFrame(rows, "k int, v string, d date")

    def test_missing_values_order(self, df):
        rows = tuples(checks.missing_values(df, ("k", "v"), (("k", "ASC"),)))
        assert rows == [(2, None), (None, "b"), (None, "b")]

    def test_duplicates_over_all_columns(self, df):
        rows = tuples(checks.duplicate_rows(df, order_by=(("k", "DESC"),)))
        assert rows == [(1, "a", date(2025, 1, 1), 2), (None, "b", None, 2)]

    def test_duplicates_without_nulls(self, df):
        assert tuples(checks.duplicate_rows(df, ("k",), exclude_nulls=("k",))) == [(1, 2)]
        # Any of the listed columns being there is enough.
        both = checks.duplicate_rows(df, ("k", "v"), "n", ("k", "v"), (("v", "ASC"),))
        assert tuples(both) == [(1, "a", 2), (None, "b", 2)]

    def test_month_start(self, df):
        assert tuples(checks.not_at_start_of_month(df, "d", ("k",))) == [(2,)]
        assert checks.validate_at_start_of_month(df.where("k = 3"), "d").result.ok

    def test_messages(self, df):
        assert checks.validate_missing_values(df, ("k",)).result.short_msg == (
            "Found rows (2) with missing values in required columns ('k',)!"
        )
        assert checks.validate_duplicate_rows(df, ("v",)).result.short_msg == (
            "Found duplicate rows (2) over columns: ('v',)!"
        )

    def test_import_interval(self, df):
        assert tuples(checks.import_interval(df, "d")) == [(date(2025, 1, 1), date(2025, 2, 1))]
        assert tuples(checks.import_interval(df.limit(0), "d")) == [(None, None)]

    def test_order_splits_one_key(self, spark):
        """All rows share the key; they are in order and still spread over the tasks."""
        df = spark.range(0, 4000, 1, 8).selectExpr("7 AS k", "id")
        result = ordered(df, (("k", "ASC"),)).withColumn("p", F.spark_partition_id())
        with_aqe_off = {"spark.sql.adaptive.enabled": "false"}
        for key, value in with_aqe_off.items():
            spark.conf.set(key, value)
        try:
            sizes = [r["count"] for r in result.groupBy("p").count().collect()]
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert sum(sizes) == 4000 and len(sizes) > 1


    def test_checks_read_the_columns_they_need(self, spark, tmp_path):
        path = str(tmp_path / "drop")
        spark.sql("SELECT 'c' AS serie_type_code, 1 AS ean, DATE'2025-01-01' AS date_id, 1D AS serie_value, 's' AS status_id").write.parquet(path)
        drop = spark.read.parquet(path)
        plan = checks.drop_profile(drop, checks.METER_RULES)._jdf.queryExecution().executedPlan()
        assert "status_id" not in plan.toString() and "serie_value" in plan.toString()
        plan = checks.duplicate_counts(drop, checks.METER_RULES)._jdf.queryExecution().executedPlan()
        assert "ReadSchema: struct<serie_type_code:string,ean:int,date_id:date>" in plan.toString()
        # Counted in the tasks that read before anything is shuffled.
        assert "partial_count(1)" in plan.toString()


class TestUpsert:
    TABLE = struct(id=INT, a=STRING, b=INT)

    @pytest.fixture
    def target(self, spark):
        return spark.createDataFrame([(1, "x", 1), (2, "y", 2), (3, "z", 3)], self.TABLE)

    def test_update_sets_given_columns_only(self, spark, target):
        updates = spark.createDataFrame([(1, None), (3, "new"), (9, "nobody")], "id int, a string")
        rows = sorted(tuples(upsert.update_by_key(target, updates, ("id",))))
        assert rows == [(1, None, 1), (2, "y", 2), (3, "new", 3)]

    def test_upsert(self, spark, target):
        changes = spark.createDataFrame([(1, None), (9, "new")], "id int, a string")
        rows = sorted(tuples(upsert.upsert_by_key(target, changes, ("id",))))
        assert rows == [(1, None, 1), (2, "y", 2), (3, "z", 3), (9, "new", None)]

    def test_random_upserts(self, spark):
        """Against a dict: a given value always wins, null included; other columns stay."""
        rng = random.Random(5)
        stored = {k: (rng.choice("xyz"), rng.randint(0, 9)) for k in rng.sample(range(300), 150)}
        given = {k: rng.choice(["p", "q", None]) for k in rng.sample(range(300), 150)}
        target = spark.createDataFrame([(k, *v) for k, v in stored.items()], self.TABLE)
        changes = spark.createDataFrame(list(given.items()), "id int, a string")
        expected = {**stored, **{k: (a, stored.get(k, (None, None))[1]) for k, a in given.items()}}
        rows = upsert.upsert_by_key(target, changes, ("id",)).collect()
        assert {r.id: (r.a, r.b) for r in rows} == expected and len(rows) == len(expected)

    def test_insert(self, spark, target):
        new = spark.createDataFrame([("w", 4.5)], "a string, b double")
        assert tuples(upsert.insert_rows(target.limit(0), new)) == [(None, "w", 4)]

    def test_unknown_column(self, spark, target):
        with pytest.raises(ValueError, match="no columns \\('c',\\)"):
            upsert.update_by_key(target, spark.createDataFrame([(1, 1)], "id int, c int"), ("id",))

    def test_required_columns(self, target):
        assert not upsert.check_insert_columns("product", target).ok
        assert upsert.check_update_columns("facility", target.withColumnRenamed("id", "facility_id")).ok

    def test_ids_follow_the_key_over_many_partitions(self, spark):
        df = spark.range(0, 5000, 1, 7).selectExpr("(id * 7919) % 5003 AS k", "id AS payload")
        staging = Staging(spark, "test-ids")
        rows = upsert.assign_ids(df, "k", "n", 100, staging).orderBy("k").collect()
        staging.drop()
        assert [r.n for r in rows] == list(range(100, 5100))
        assert [r.k for r in rows] == sorted((i * 7919) % 5003 for i in range(5000))

    def test_no_rows_get_no_ids(self, spark):
        staging = Staging(spark, "test-ids")
        df = spark.createDataFrame([], "k int")
        assert upsert.assign_ids(df, "k", "n", 1, staging).collect() == []
        assert upsert.max_id(df, "k") == 0


class TestConstraints:
    def test_unique_allows_nulls(self, spark):
        df = spark.createDataFrame([(1,), (1,), (None,), (None,)], "a int")
        assert tuples(constraints.unique_violations(df, ("a",))) == [(1, 2)]

    def test_foreign_keys(self, spark):
        child = spark.createDataFrame([(1,), (7,), (7,), (None,)], "p int")
        parent = spark.createDataFrame([(1,), (2,)], "id int")
        rows = tuples(constraints.foreign_key_violations(child, "p", parent, "id"))
        assert rows == [(7, 2)]

    def test_conflicts_with_stored(self, spark):
        new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
        stored = spark.createDataFrame([(2, "x")], "id int, v string")
        assert tuples(constraints.conflicts_with_stored(new, stored, ("id",))) == [(2, "b")]

    def test_declared_tables(self, spark):
        table = schemas.TARIFF_COMPONENT
        good = (1, 1, 1, Decimal(5), Decimal(0), Decimal(0), Decimal(0), Decimal(1), 11, 3)
        bad = (2, 1, 1, None, Decimal(0), Decimal(0), Decimal(0), Decimal(0), 0, 13)
        df = spark.createDataFrame([good, bad], table.schema)
        found = dict(tuples(constraints.table_violations(df, table)))
        assert found == {
            "price_not_null": 1,
            "validity_start_between_1_12": 1,
            "validity_end_between_1_12": 1,
            "overshoot_limit_gt_0": 1,
            "tariff_component_type_id_tariff_cost_group_id_unique": 1,
        }


class TestMeterProfile:
    FACILITIES = [(n, n) for n in range(1, 8)]
    TYPES = [(1, "a"), (2, "b")]

    def frames(self, spark):
        return (
            spark.createDataFrame(self.FACILITIES, "facility_id long, ean long"),
            spark.createDataFrame(self.TYPES, "serie_type_id int, code string"),
        )

    @pytest.mark.parametrize("seed", range(6))
    def test_equals_counting_row_by_row(self, spark, seed):
        rnd = random.Random(seed)
        days = [date(2024, 1, 1), date(2024, 2, 1), *([date(2024, 2, 9)] if seed % 2 else []), *([None] if seed > 3 else [])]
        rows = [
            (rnd.choice(["a", "b", "c", None][: 2 + seed % 3]), rnd.choice([*range(1, 10), None]), rnd.choice(days),
             rnd.choice([Decimal(1), Decimal(2), None]))
            for _ in range(0 if seed == 0 else 60)
        ]
        columns = struct(serie_type_code=STRING, ean=LONG, date_id=DATE, serie_value=SERIE_VALUE_TYPE)
        drop = spark.createDataFrame(rows, columns)
        got = resolve.meter_profile(drop, *self.frames(spark)).first()
        plain = checks.drop_profile(drop, checks.METER_RULES).first().asDict()
        assert {name: got[name] for name in plain} == plain
        keys = [row[:3] for row in rows]
        assert got.nr_repeated == len({key for key in keys if keys.count(key) > 1})
        known = {n for n, _ in self.FACILITIES}
        assert got.nr_unresolved == sum(ean not in known or code not in ("a", "b") for code, ean, *_ in rows)
        assert got.nr_unresolved == resolve.count_unresolved_meter_rows(drop, *self.frames(spark)).first().nr_invalid

    def test_reads_and_shuffles_the_drop_once(self, spark, tmp_path):
        path = str(tmp_path / "drop")
        row = ("a", 1, date(2024, 1, 1), Decimal(1))
        columns = struct(serie_type_code=STRING, ean=LONG, date_id=DATE, serie_value=SERIE_VALUE_TYPE)
        spark.createDataFrame([row] * 50, columns).write.parquet(path)
        drop = spark.read.parquet(path)
        plan = resolve.meter_profile(drop, *self.frames(spark))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1
        assert plan.count("Exchange hashpartitioning") == 1
        assert "Join" in plan and plan.count("BroadcastHashJoin") == 2


def test_doubles_are_rounded_without_becoming_decimals_first(spark):
    """Halves away from zero, whole numbers up to the last digits, and what is none stays none."""
    cases = {0.0005: "0.001", -0.0005: "-0.001", 0.00049999999999999994: "0.000", 1034.0575: "1034.057",
             -2.4: "-2.400", 4503599627370.4965: "4503599627370.496", 123456789012345.0: "123456789012344.992"}
    df = spark.createDataFrame([(x,) for x in [*cases, float("nan"), None]], "serie_value double")
    cast = cast_present(df, struct(serie_value=SERIE_VALUE_TYPE))
    assert "floor" in cast._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r.serie_value for r in cast.collect()] == [*map(Decimal, cases.values()), None, None]
