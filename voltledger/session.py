"""Session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

from voltledger.functions.intervals import BUSINESS_TIMEZONE

# Adaptive execution carries the scaling: it coalesces small shuffle partitions, splits skewed
# join partitions and rebalanced partitions by size, and switches to broadcast joins when the
# measured size of a side is below Spark's own threshold.
SCALE_SETTINGS = {
    # Months of zoned drops begin at midnight of the business zone.
    "spark.sql.session.timeZone": BUSINESS_TIMEZONE,
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
}


def get_session(
    app: str = "voltledger",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **settings: str,
) -> SparkSession:
    """A session with the settings above. On a cluster give about 2-3 shuffle partitions per core
    as the upper limit; adaptive execution merges what turns out to be small."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SCALE_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
