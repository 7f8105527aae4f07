"""Table schemas, keys and stored constraints."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

LONG, INT, SHORT, BYTE = T.LongType(), T.IntegerType(), T.ShortType(), T.ByteType()
STRING, DOUBLE, DATE, BOOLEAN = T.StringType(), T.DoubleType(), T.DateType(), T.BooleanType()
SERIE_VALUE_TYPE = T.DecimalType(18, 3)
MONEY_PRICE = T.DecimalType(20, 6)
MONEY_TOTAL = T.DecimalType(20, 3)
RATIO = T.DecimalType(9, 6)

# Surrogate ids of code tables, products and customer groups are unsigned 16-bit numbers in the
# data model, so such a table cannot hold more rows than this. Facilities have no such bound.
CODE_TABLE_MAX_ROWS = 65_535


def struct(**columns: T.DataType) -> T.StructType:
    """A StructType from ``name=type`` pairs; every column is nullable, as in a parquet read."""
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in columns.items()])


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class Table:
    """A stored table: its columns, its primary key and the constraints kept at write time."""

    name: str
    schema: T.StructType
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    not_null: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    month_start: str | None = None
    checks: dict[str, str] = field(default_factory=dict)
    partition_by: str | None = None


def _code_table(name: str) -> Table:
    id_col = f"{name}_id"
    schema = T.StructType(
        [T.StructField(id_col, INT, True)] + struct(code=STRING, name=STRING, description=STRING).fields
    )
    return Table(name, schema, key=(id_col,), unique=(("code",),), not_null=("code",))


FACILITY_TYPE = _code_table("facility_type")
CUSTOMER_TYPE = _code_table("customer_type")
CUSTOMER_GROUP_MAPPING_STRATEGY = _code_table("customer_group_mapping_strategy")
CALC_STRATEGY = _code_table("calc_strategy")
PERIODIZE_STRATEGY = _code_table("periodize_strategy")

SERIE_TYPE = Table(
    "serie_type",
    struct(serie_type_id=INT, code=STRING, name=STRING, external_id=STRING, description=STRING),
    key=("serie_type_id",),
    unique=(("code",),),
    not_null=("code",),
)

CURRENCY = Table(
    "currency",
    struct(
        currency_id=INT,
        iso_code=STRING,
        name=STRING,
        minor_unit_name=STRING,
        minor_per_major=INT,
        display_decimals=INT,
        symbol=STRING,
        symbol_minor_unit=STRING,
        description=STRING,
    ),
    key=("currency_id",),
    unique=(("iso_code",),),
    not_null=("iso_code", "name"),
)

UNIT = Table(
    "unit",
    struct(unit_id=INT, code=STRING, display_name=STRING, description=STRING),
    key=("unit_id",),
    unique=(("code",),),
    not_null=("code", "display_name"),
)

PRODUCT = Table(
    "product",
    struct(product_id=INT, external_id=STRING, name=STRING, description=STRING),
    key=("product_id",),
    unique=(("external_id",), ("name",)),
    not_null=("external_id", "name"),
)

FACILITY = Table(
    "facility",
    struct(
        facility_id=LONG,
        ean=LONG,
        ean_prod=LONG,
        facility_type_id=INT,
        name=STRING,
        description=STRING,
    ),
    key=("facility_id",),
    unique=(("ean",),),
    not_null=("ean", "facility_type_id"),
    foreign_keys=(ForeignKey("facility_type_id", "facility_type", "facility_type_id"),),
)

FACILITY_CONTRACT = Table(
    "facility_contract",
    struct(
        facility_id=LONG,
        date_id=DATE,
        fuse_size=INT,
        subscribed_power=DOUBLE,
        connection_power=DOUBLE,
        account_nr=INT,
        customer_type_id=INT,
        product_id=INT,
    ),
    key=("facility_id", "date_id"),
    not_null=("facility_id", "date_id", "customer_type_id"),
    foreign_keys=(
        ForeignKey("facility_id", "facility", "facility_id"),
        ForeignKey("customer_type_id", "customer_type", "customer_type_id"),
        ForeignKey("product_id", "product", "product_id"),
    ),
    month_start="date_id",
    partition_by="date_id",
)

CUSTOMER_GROUP = Table(
    "customer_group",
    struct(
        customer_group_id=INT,
        code=STRING,
        name=STRING,
        min_fuse_size=INT,
        max_fuse_size=INT,
        min_subscribed_power=DOUBLE,
        max_subscribed_power=DOUBLE,
        min_connection_power=DOUBLE,
        max_connection_power=DOUBLE,
        min_bound_included=BOOLEAN,
        max_bound_included=BOOLEAN,
        facility_type_id=INT,
        customer_type_id=INT,
        product_id=INT,
        not_product_id=INT,
        mapping_strategy_id=INT,
        description=STRING,
    ),
    key=("customer_group_id",),
    unique=(("code",),),
    not_null=(
        "code",
        "name",
        "min_bound_included",
        "max_bound_included",
        "facility_type_id",
        "mapping_strategy_id",
    ),
    foreign_keys=(
        ForeignKey("facility_type_id", "facility_type", "facility_type_id"),
        ForeignKey("customer_type_id", "customer_type", "customer_type_id"),
        ForeignKey("product_id", "product", "product_id"),
        ForeignKey("not_product_id", "product", "product_id"),
        ForeignKey(
            "mapping_strategy_id",
            "customer_group_mapping_strategy",
            "customer_group_mapping_strategy_id",
        ),
    ),
)

LINK = Table(
    "facility_customer_group_link",
    struct(facility_id=LONG, date_id=DATE, customer_group_id=INT),
    key=("facility_id", "date_id"),
    not_null=("facility_id", "date_id", "customer_group_id"),
    foreign_keys=(
        ForeignKey("facility_id", "facility", "facility_id"),
        ForeignKey("customer_group_id", "customer_group", "customer_group_id"),
    ),
    month_start="date_id",
    partition_by="date_id",
)

# Tariff tables: the price lists that plans/costs.py computes with, filled by the user.
TARIFF = Table(
    "tariff",
    struct(
        tariff_id=INT,
        name=STRING,
        currency_id=INT,
        validity_start=DATE,
        validity_end=DATE,
        high_load_period_start=DATE,
        high_load_period_end=DATE,
        description=STRING,
    ),
    key=("tariff_id",),
    unique=(("name",),),
    not_null=("name", "currency_id"),
    foreign_keys=(ForeignKey("currency_id", "currency", "currency_id"),),
)

TARIFF_COST_GROUP = Table(
    "tariff_cost_group",
    struct(tariff_cost_group_id=INT, tariff_id=INT, name=STRING, description=STRING),
    key=("tariff_cost_group_id",),
    unique=(("tariff_id", "name"),),
    not_null=("tariff_id", "name"),
    foreign_keys=(ForeignKey("tariff_id", "tariff", "tariff_id"),),
)

TARIFF_COMPONENT_TYPE = Table(
    "tariff_component_type",
    struct(
        tariff_component_type_id=INT,
        name=STRING,
        unit_id=INT,
        calc_strategy_id=INT,
        periodize_strategy_id=INT,
        serie_type_id=INT,
        comparison_serie_type_id=INT,
        is_revenue=BOOLEAN,
        description=STRING,
    ),
    key=("tariff_component_type_id",),
    unique=(("name",),),
    not_null=("name", "unit_id", "calc_strategy_id", "periodize_strategy_id", "is_revenue"),
    foreign_keys=(
        ForeignKey("unit_id", "unit", "unit_id"),
        ForeignKey("calc_strategy_id", "calc_strategy", "calc_strategy_id"),
        ForeignKey("periodize_strategy_id", "periodize_strategy", "periodize_strategy_id"),
        ForeignKey("serie_type_id", "serie_type", "serie_type_id"),
        ForeignKey("comparison_serie_type_id", "serie_type", "serie_type_id"),
    ),
)

TARIFF_COMPONENT = Table(
    "tariff_component",
    struct(
        tariff_component_id=INT,
        tariff_component_type_id=INT,
        tariff_cost_group_id=INT,
        price=MONEY_PRICE,
        authority_fee=MONEY_PRICE,
        price_outside_validity=MONEY_PRICE,
        authority_fee_outside_validity=MONEY_PRICE,
        overshoot_limit=RATIO,
        validity_start=INT,
        validity_end=INT,
    ),
    key=("tariff_component_id",),
    unique=(("tariff_component_type_id", "tariff_cost_group_id"),),
    not_null=("tariff_component_type_id", "tariff_cost_group_id", "price"),
    foreign_keys=(
        ForeignKey("tariff_component_type_id", "tariff_component_type", "tariff_component_type_id"),
        ForeignKey("tariff_cost_group_id", "tariff_cost_group", "tariff_cost_group_id"),
    ),
    checks={
        "validity_start_between_1_12": "validity_start BETWEEN 1 AND 12",
        "validity_end_between_1_12": "validity_end BETWEEN 1 AND 12",
        "overshoot_limit_gt_0": "overshoot_limit > 0",
    },
)

TARIFF_COMPONENT_TYPE_LINK = Table(
    "tariff_tariff_component_type_link",
    struct(tariff_id=INT, tariff_component_type_id=INT),
    key=("tariff_id", "tariff_component_type_id"),
    foreign_keys=(
        ForeignKey("tariff_id", "tariff", "tariff_id"),
        ForeignKey("tariff_component_type_id", "tariff_component_type", "tariff_component_type_id"),
    ),
)

COST_GROUP_LINK = Table(
    "tariff_cost_group_customer_group_link",
    struct(tariff_cost_group_id=INT, customer_group_id=INT),
    key=("tariff_cost_group_id", "customer_group_id"),
    foreign_keys=(
        ForeignKey("tariff_cost_group_id", "tariff_cost_group", "tariff_cost_group_id"),
        ForeignKey("customer_group_id", "customer_group", "customer_group_id"),
    ),
)

# What the imports remember: the files whose rows are stored, and the files of rejected streamed drops.
IMPORTED_FILE = Table(
    "imported_file",
    struct(job=STRING, file=STRING, modified=LONG, nr_bytes=LONG),
    key=("job", "file", "modified", "nr_bytes"),
)
REJECTED_FILE = Table(
    "rejected_file",
    struct(source_dir=STRING, drop_nr=LONG, file=STRING),
    key=("source_dir", "drop_nr", "file"),
)
# Partitions of a rejected drop (named by its first file) that a newer drop wrote in the meantime.
TAKEN_PARTITION = Table(
    "taken_partition",
    struct(source_dir=STRING, file=STRING, serie_type_code=STRING, date_id=DATE),
    key=("source_dir", "file", "serie_type_code", "date_id"),
)

TABLES: dict[str, Table] = {
    table.name: table
    for table in (
        IMPORTED_FILE,
        REJECTED_FILE,
        TAKEN_PARTITION,
        FACILITY_TYPE,
        CUSTOMER_TYPE,
        CUSTOMER_GROUP_MAPPING_STRATEGY,
        CALC_STRATEGY,
        PERIODIZE_STRATEGY,
        SERIE_TYPE,
        CURRENCY,
        UNIT,
        PRODUCT,
        FACILITY,
        FACILITY_CONTRACT,
        CUSTOMER_GROUP,
        LINK,
        TARIFF,
        TARIFF_COST_GROUP,
        TARIFF_COMPONENT_TYPE,
        TARIFF_COMPONENT,
        TARIFF_COMPONENT_TYPE_LINK,
        COST_GROUP_LINK,
    )
}

# Import drops. Every column may be absent; which ones a job insists on is said in its DropRules.
PRODUCT_DROP = struct(external_id=STRING, name=STRING, description=STRING)
FACILITY_DROP = struct(
    ean=LONG, ean_prod=LONG, facility_type_code=STRING, name=STRING, description=STRING
)
CONTRACT_DROP = struct(
    ean=LONG,
    date_id=DATE,
    fuse_size=INT,
    subscribed_power=DOUBLE,
    connection_power=DOUBLE,
    account_nr=INT,
    customer_type_code=STRING,
    ext_product_id=STRING,
)
METER_DROP = struct(
    serie_type_code=STRING, ean=LONG, date_id=DATE, serie_value=SERIE_VALUE_TYPE, status_id=STRING
)

# The meter store is a parquet hive root/serie_type_code=.../date_id=...
SERIE_VALUE = struct(
    facility_id=LONG,
    ean=LONG,
    serie_value=SERIE_VALUE_TYPE,
    status_id=STRING,
    serie_type_code=STRING,
    date_id=DATE,
)
METER_PARTITIONS = ("serie_type_code", "date_id")
