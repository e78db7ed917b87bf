"""Dense numbers along an order, without a task that sees all rows.

Rows are sorted over as many tasks as there are partitions. Each task writes its share, a
stretch, with the place of each row in it; the sizes of the stretches, a row for each,
then say where every stretch begins.
"""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import Window

from fleetmeter.sources.staging import staged

_PLACE = (1 << 33) - 1


def in_order(df, order, label, stretches=None, apart=False):
    """`df` written in order, with `stretch` and `place`: where in its stretch a row stands, from 0.

    `order` is a list of sort expressions. Rows it does not tell apart come in any order.
    `stretches` is how many there are, by default as many as the size asks for; `apart`
    gives each a folder of its own, so that a reader of one opens no file of another.
    """
    # The number holds the partition in its upper bits and the row in its lower 33.
    place = F.monotonically_increasing_id().bitwiseAND(_PLACE)
    ordered = df.repartitionByRange(*[stretches] * bool(stretches), *order).sortWithinPartitions(*order)
    placed = ordered.select("*", F.spark_partition_id().alias("stretch"), place.alias("place"))
    if apart:
        # Written by folder; a stated order spares the writer a sort that would lose ours.
        return staged(placed.sortWithinPartitions("stretch", "place"), label, by=["stretch"])
    return staged(placed, label)


def beginnings(written, groups=(), size=None):
    """(*groups, stretch, begins, first, rows): for each stretch of a group the number of rows of
    the group before it, its first place and its rows; with `size`, that column is added up instead.
    """
    amount = F.count("*") if size is None else F.coalesce(F.sum(size), F.lit(0))
    sizes = written.groupBy(*groups, "stretch").agg(
        amount.cast("long").alias("rows"), F.min("place").alias("first"))
    earlier = Window.partitionBy(*groups).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("begins", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))


def numbered(written, groups=(), name="number", total=None):
    """Rows of `in_order` with their number from 0 in their group; the order must begin with the groups.

    A group may be NULL. `total` names a column for the rows of the group. A stretch holds
    an even share of the rows, so the join has no hot key.
    """
    begins = beginnings(written, groups)
    every = [F.sum("rows").over(Window.partitionBy(*groups)).alias(total)] if total else []
    begins = begins.select(*[F.col(g).alias(f"begins_{g}") for g in groups],
                           F.col("stretch").alias("begins_stretch"), "begins", "first", *every)
    same = [written["stretch"] == begins["begins_stretch"]]
    same += [written[g].eqNullSafe(begins[f"begins_{g}"]) for g in groups]
    number = F.col("begins") + F.col("place") - F.col("first")
    return written.join(begins, reduce(lambda a, b: a & b, same)).select(
        *[F.col(f"`{c}`") for c in written.columns if c not in ("stretch", "place")], number.alias(name),
        *[total] * bool(total))
