"""A fact as a table laid out for its readers.

Rows are parted by source and dealt to buckets by asset, in order of date. Grouping by
asset, with whatever other keys, then needs no shuffle; a read of one source opens no file
of the other; and a range of dates skips the row groups outside it.

A bucket is one task. An asset that holds a large share of the rows would make one task
as large as that share, which no later step can split. So the shares are looked at first,
and where one is too large the fact is parted by source and sorted by date alone.
"""

from pyspark.sql import functions as F

ASSET_KEY = "asset_code"

#: How many times the rows of an even bucket an asset may have.
MOST_OF_BUCKET = 4


def largest_share(fact):
    """Rows of the largest asset as a share of all rows; NULL is an asset, too. 0 without rows."""
    sizes = fact.groupBy(ASSET_KEY).agg(F.count("*").alias("rows"))
    return sizes.agg(F.coalesce(F.try_divide(F.max("rows"), F.sum("rows")), F.lit(0.0))).first()[0]


def write_fact(fact, name, buckets):
    """Writes the fact as the catalog table `name`; returns whether it has buckets.

    Choose `buckets` so that one holds a few hundred MB. Each task writes the rows of its
    own buckets, so there is one file for each bucket and source.
    """
    bucketed = largest_share(fact) * buckets <= MOST_OF_BUCKET
    if bucketed:
        writer = fact.repartition(buckets, ASSET_KEY).write.bucketBy(buckets, ASSET_KEY).sortBy("date")
    else:
        writer = fact.repartitionByRange(buckets, "source", F.asc_nulls_last("date")).sortWithinPartitions("source", "date").write
    writer.partitionBy("source").saveAsTable(name)
    return bucketed
