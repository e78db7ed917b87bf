"""Session settings the jobs are written for."""

from pyspark.sql import SparkSession

SETTINGS = {
    # Shuffles start wide and are merged to the advisory size at run time, so one
    # setting serves a laptop and a cluster.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Files are read compressed and by column, so a small file can be a large hash
    # table: only dimensions are broadcast on file size alone, the rest once their
    # real size has been seen.
    "spark.sql.autoBroadcastJoinThreshold": "1m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "16m",
    # A join whose partitions all fit is hashed, not sorted.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "128m",
    # Hot join keys are split into several tasks.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # An overflow stops the job instead of wrapping.
    "spark.sql.ansi.enabled": "true",
}


def build_session(name="fleetmeter", master=None, shuffle_partitions=None, extra=None):
    """A session with `SETTINGS`; `master` None leaves the choice to spark-submit."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = dict(SETTINGS, **(extra or {}))
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
