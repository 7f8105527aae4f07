from __future__ import annotations

import shutil

import pytest
from pyspark.sql import SparkSession

from tests import golden
from voltledger.seeds import init_tables
from voltledger.session import get_session
from voltledger.sources.tables import TableStore


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = get_session(
        "voltledger-tests",
        master="local[4]",
        shuffle_partitions=4,
        **{
            "spark.driver.memory": "4g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.session.timeZone": "UTC",
            # Many small queries: compiling quickly beats compiling well.
            "spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1 -XX:+UseParallelGC",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def seeded_root(spark, tmp_path_factory) -> str:
    root = str(tmp_path_factory.mktemp("seeded") / "store")
    assert init_tables(TableStore(spark, root)).ok
    return root


@pytest.fixture
def store(spark, seeded_root, tmp_path) -> TableStore:
    """A table store with the seed rows."""
    return TableStore(spark, shutil.copytree(seeded_root, str(tmp_path / "store")))


@pytest.fixture
def write_drop(spark, tmp_path):
    """Write dicts as the parquet drop of a new directory and return its path."""
    count = 0

    def write(dicts: list[dict], columns: list[str] | None = None, path: str | None = None) -> str:
        nonlocal count
        count += 1
        path = path or str(tmp_path / f"drop{count}")
        golden.frame(spark, dicts, columns).coalesce(1).write.mode("append").parquet(path)
        return path

    return write


def commit_rows(store: TableStore, name: str, dicts: list[dict]) -> None:
    store.commit(name, golden.frame(store.spark, dicts))


@pytest.fixture
def fill():
    """Commit golden rows to a table of a store."""
    return commit_rows


@pytest.fixture(scope="session")
def full_root(spark, seeded_root, tmp_path_factory) -> str:
    root = shutil.copytree(seeded_root, str(tmp_path_factory.mktemp("full") / "store"))
    store = TableStore(spark, root)
    commit_rows(store, "product", golden.rows(golden.PRODUCTS))
    commit_rows(store, "facility", golden.rows(golden.FACILITIES, "facility_type_code"))
    commit_rows(
        store,
        "facility_contract",
        golden.rows(golden.CONTRACTS, "ean", "customer_type_code", "ext_product_id"),
    )
    commit_rows(
        store, "customer_group", golden.rows(golden.CUSTOMER_GROUPS, "mapping_strategy_code")
    )
    return root


@pytest.fixture
def full_store(spark, full_root, tmp_path) -> TableStore:
    """Products, facilities, contracts and customer groups in place."""
    return TableStore(spark, shutil.copytree(full_root, str(tmp_path / "full")))
