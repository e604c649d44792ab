"""Running sums within groups of any size, and rolling counts by changes.

Rows are cut into ranges of (group, order), so that a group with a third of all rows is many ranges. Each range is
summed, the ranges' sums are prefix-summed, and a row's own sum is found within its range.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serialis.sources.io import kept_table

_RANGE = "__range"


def ranged(df: DataFrame, group: str, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """df with the number of each row's range of (group, order), written as a table so that it stays. Rows alike in both
    are in one range."""
    keys = [group, *order]
    dealt = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    return kept_table(dealt.withColumn(_RANGE, F.spark_partition_id()))


def running(df: DataFrame, group: str, order: Sequence[str | Column], **sums: Column) -> DataFrame:
    """A table of `ranged` with the running sum, own row included, of every named value within the group."""
    parts = df.groupBy(group, _RANGE).agg(*(F.sum(v).alias(f"__{n}") for n, v in sums.items()))
    ahead = Window.partitionBy(group).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col(group).alias("__group"), F.col(_RANGE).alias("__of"), *(F.coalesce(F.sum(f"__{n}").over(ahead), F.lit(0)).alias(f"__{n}") for n in sums))
    inside = Window.partitionBy(group, _RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = df.join(starts, df[group].eqNullSafe(F.col("__group")) & (df[_RANGE] == F.col("__of")))
    named = {n: F.col(f"__{n}") + F.sum(v).over(inside) for n, v in sums.items()}
    return joined.withColumns(named).drop("__group", "__of", *(f"__{n}" for n in sums))


def rolling_counts(uses: DataFrame, user: str, time: str, hours: int = 22, ranges: int | None = None) -> DataFrame:
    """(user, time, uses, used): at every time of a user's uses, how many there are then, and how many in the closed
    range of so many hours up to it.

    Uses of one time are one change up at that time and one down after the hours have passed; a running sum of
    the changes is what is used. At equal times ups come before downs, as the range is closed. Two
    rows a time are all that is made, whatever the hours. Uses without a time count nowhere; a null user is
    one of its own; an empty table gives no rows."""
    ups = uses.where(F.col(time).isNotNull()).groupBy(F.col(user).alias("user"), F.col(time).alias("time")).agg(F.count(F.lit(1)).alias("uses"))
    kind = ups.schema["time"].dataType
    downs = ups.select("user", (F.col("time") + F.make_dt_interval(hours=F.lit(hours))).cast(kind).alias("time"), F.lit(1).alias("down"), (-F.col("uses")).alias("uses"))
    changes = ups.select("user", "time", F.lit(0).alias("down"), "uses").unionByName(downs)
    summed = running(ranged(changes, "user", ["time", "down"], ranges), "user", ["time", "down"], used=F.col("uses"))
    return summed.where("down = 0").select(F.col("user").alias(user), F.col("time").alias(time), "uses", "used")
